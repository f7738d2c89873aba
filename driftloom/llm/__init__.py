"""Training-data operators: ten corpus operations over whole tables.

Nothing outside this subpackage imports it; :mod:`driftloom.llm.catalog`
lists the queries.
"""
