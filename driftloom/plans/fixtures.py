"""Varied events derived from the clean ``events`` table, the same in both engines.

``raw`` is built by concatenation; CELLS is what flattening it must give, written
from the columns without any JSON function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators.cells import cells, parse_events

SPLIT = "2024-01-16 00:00:00"
DEPTH = 2

# SQL that both engines read alike; members of the JSON object, in parts.
_PARTS = [
    "'{\"event_id\":' || CAST(event_id AS %STRING%)",
    "',\"event_type\":\"' || event_type || '\"'",
    "',\"user\":{\"id\":' || CAST(user_id AS %STRING%) || ',\"email\":\"u' || CAST(user_id AS %STRING%) || '@example.com\"}'",
    "CASE WHEN event_id % 7 = 0 OR (half = 'observed' AND event_id % 3 = 0) THEN '' WHEN event_id % 11 = 0 THEN ',\"amount\":\"' || amount || '\"' ELSE ',\"amount\":' || amount END",
    "',\"currency\":\"' || currency || '\"'",
    "',\"ts\":' || CASE WHEN half = 'observed' AND event_id % 2 = 0 THEN '\"2024-01-20T00:00:00Z\"' ELSE CAST(1704067200000 + event_id * 1000 AS %STRING%) END",
    "',\"note\":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '\"ok\"' END",
    "',\"tags\":' || tags",
    "',\"flag\":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END",
    "CASE WHEN half = 'observed' THEN ',\"card\":\"' || card || '\"' ELSE ',\"legacy\":1' END",
    "'}'",
]
_COLUMNS = """event_id AS seq, event_id, event_type, user_id, ts AS at, CAST(ts AS DATE) AS day,
  CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'baseline' ELSE 'observed' END AS half,
  CAST(event_id % 997 AS %STRING%) || '.' || CAST(1 + event_id % 9 AS %STRING%) AS amount,
  CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' AND event_id % 13 = 0 THEN 'XXX' WHEN event_id % 3 = 0 THEN 'USD' WHEN event_id % 3 = 1 THEN 'EUR' ELSE 'GBP' END AS currency,
  CASE WHEN event_id % 4 = 0 THEN '[]' WHEN event_id % 4 = 1 THEN '[{"k":' || CAST(event_id % 5 AS %STRING%) || '}]' ELSE '["a"]' END AS tags,
  '4111 1111 1111 ' || lpad(CAST(event_id % 10000 AS %STRING%), 4, '0') AS card"""


def raw_sql(string: str) -> str:
    """SELECT of the columns and raw, for Spark ('STRING') or DuckDB ('VARCHAR')."""
    sql = f"SELECT *, {' || '.join(_PARTS)} AS raw FROM (SELECT {_COLUMNS} FROM events)"
    return sql.replace("%STRING%", string)


#: CTEs ev (events) and cells (seq, half, day, event_type, path, kind, text) in DuckDB.
CELLS = (
    "WITH ev AS ("
    + raw_sql("VARCHAR")
    + """), cells AS (
SELECT seq, half, day, event_type, path, kind, text FROM (
  SELECT ev.*, unnest([
    {'path': 'event_id', 'kind': 'integer', 'text': event_id::VARCHAR},
    {'path': 'event_type', 'kind': 'string', 'text': event_type},
    {'path': 'user.id', 'kind': 'integer', 'text': user_id::VARCHAR},
    {'path': 'user.email', 'kind': 'string', 'text': 'u' || user_id || '@example.com'},
    CASE WHEN event_id % 7 = 0 OR (half = 'observed' AND event_id % 3 = 0) THEN NULL ELSE {'path': 'amount', 'kind': CASE WHEN event_id % 11 = 0 THEN 'string' ELSE 'float' END, 'text': amount} END,
    {'path': 'currency', 'kind': 'string', 'text': currency},
    {'path': 'ts', 'kind': CASE WHEN half = 'observed' AND event_id % 2 = 0 THEN 'string' ELSE 'integer' END, 'text': CASE WHEN half = 'observed' AND event_id % 2 = 0 THEN '2024-01-20T00:00:00Z' ELSE (1704067200000 + event_id * 1000)::VARCHAR END},
    {'path': 'note', 'kind': CASE WHEN event_id % 2 = 0 THEN 'null' ELSE 'string' END, 'text': CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'ok' END},
    {'path': 'tags', 'kind': 'array', 'text': tags},
    CASE WHEN event_id % 4 = 1 THEN {'path': 'tags[].k', 'kind': 'integer', 'text': (event_id % 5)::VARCHAR} END,
    {'path': 'flag', 'kind': 'boolean', 'text': CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END},
    CASE WHEN half = 'observed' THEN {'path': 'card', 'kind': 'string', 'text': card} ELSE {'path': 'legacy', 'kind': 'integer', 'text': '1'} END
  ], recursive := false) AS c FROM ev) x, LATERAL (SELECT c.path AS path, c.kind AS kind, c.text AS text) WHERE path IS NOT NULL)
"""
)

#: The semantic type of (kind, text) in DuckDB.
SEMANTIC = r"""CASE WHEN kind = 'integer' AND text::BIGINT BETWEEN 1000000000000 AND 9999999999999 THEN 'timestamp_epoch_ms' WHEN kind <> 'string' THEN kind
  WHEN regexp_matches(trim(text), '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN 'uuid' WHEN regexp_matches(text, '^[^@]+@[^@]+\.[^@]+$') THEN 'email'
  WHEN regexp_matches(text, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}') THEN 'timestamp_iso8601' WHEN regexp_matches(text, '^\d{4}-\d{2}-\d{2}$') THEN 'date' ELSE 'string' END"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The varied events, parsed."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    return parse_events(spark.sql(_spark_sql(), source=source))


def _spark_sql() -> str:
    sql = raw_sql("STRING").replace("{", "{{").replace("}", "}}")
    return sql.replace("FROM events)", "FROM {source})")


def event_cells(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("seq", "half", "day", "event_type")) -> DataFrame:
    """The cells, kept as most queries read them several times; equal plans share one copy."""
    whole = cells(events(spark, sf_dir), keep=("seq", "half", "day", "event_type"), depth=DEPTH).drop("value").persist()
    return whole.select(*keep, "path", "kind", "text")
