"""Where schemas, findings and events go."""
