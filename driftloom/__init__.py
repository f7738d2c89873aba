"""Event-stream schema, drift and lineage analytics on Spark DataFrames."""
