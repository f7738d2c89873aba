"""Queries: sources, exports and read-side summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import text
from driftloom.operators import inference, lineage, profile, reports
from driftloom.operators.cells import rebuild
from driftloom.plans import detection_sql
from driftloom.plans.fixtures import CELLS, event_cells, events
from driftloom.plans.registry import Book
from driftloom.sources import parse

_b = Book()


def _lines(spark, sf_dir):
    """Clean, embedded, truncated and useless lines, by event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id").cast("string")
    obj = F.concat(F.lit('{"id":'), i, F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    line = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("2024-01-01 INFO "), obj, F.lit(" done")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"id":'), i, F.lit(',"type":"x","broken":{"a":')))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("no json "), i))
        .otherwise(obj)
    )
    return e.select(F.col("event_id").alias("seq"), line.alias("line"))


@_b.query("SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 0.7 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS parse_conf, CASE WHEN event_id % 5 <> 2 THEN event_id::VARCHAR END AS id FROM events")
def resilient_parse(spark, sf_dir):
    p = parse.resilient(_lines(spark, sf_dir))
    return p.select("seq", F.col("parse_conf").cast("double").alias("parse_conf"), F.try_variant_get("v", "$.id", "string").alias("id"))


@_b.query("SELECT count(*) AS total_lines, count(*) FILTER (event_id % 5 >= 3) AS parsed_clean, count(*) FILTER (event_id % 5 <= 1) AS parsed_partial, count(*) FILTER (event_id % 5 = 2) AS skipped FROM events")
def parse_stats(spark, sf_dir):
    return parse.parse_stats(parse.resilient(_lines(spark, sf_dir)))


@_b.query("SELECT event_id AS id, (CASE event_id % 3 WHEN 0 THEN (event_id % 9 + 1) || '.' || (event_id % 4) || '.' || (event_id % 5 + 1) WHEN 1 THEN (event_id % 9) || '.' || (event_id % 4 + 1) || '.0' WHEN 2 THEN (event_id % 9 + 1) || '.0.0' END) AS version FROM events")
def version_bumps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    old = F.concat_ws(".", (i % 9 + F.when(i % 3 == 0, 1).otherwise(0)).cast("string"), (i % 4).cast("string"), (i % 5).cast("string"))
    return e.select(i.alias("id"), text.bump_version(old, i % 3 + 1).alias("version"))


@_b.query(
    CELLS
    + ", first AS (SELECT event_type, path, text FROM (SELECT event_type, path, kind, text, row_number() OVER (PARTITION BY event_type, path ORDER BY seq) AS nth FROM cells WHERE kind <> 'null') WHERE nth <= 20 AND kind = 'string'), own AS (SELECT DISTINCT event_type || ':' || path AS path, event_type, path AS plain FROM cells), "
    + detection_sql.personal("f", "cells", "first").replace("SELECT DISTINCT path, '", "SELECT DISTINCT event_type, path, '")
    + """ SELECT category, count(*) AS fields, count(DISTINCT event_type) AS streams FROM (SELECT event_type, path, category FROM f_shows UNION SELECT event_type, plain, category FROM own JOIN f_name n ON n.path = plain) GROUP BY category"""
)
def pii_summary(spark, sf_dir):
    """Each event type is a stream."""
    c, e = event_cells(spark, sf_dir, ("seq", "event_type")), events(spark, sf_dir)
    f = inference.statistical(c, e.select("seq", "event_type"), ["event_type"])
    return lineage.pii_summary(f.withColumnRenamed("event_type", "stream"))


@_b.query(CELLS + "SELECT path FROM cells WHERE lower(path) LIKE '%user%' GROUP BY path")
def search_fields(spark, sf_dir):
    f = inference.statistical(event_cells(spark, sf_dir, ("seq",)), events(spark, sf_dir))
    return lineage.search_fields(f, "user").select("path")


@_b.query(CELLS + "SELECT path, array_to_string(list(text ORDER BY seq)[1:5], '|') AS samples FROM cells WHERE kind <> 'null' GROUP BY path")
def sample_values(spark, sf_dir):
    return profile.sample_values(event_cells(spark, sf_dir, ("seq",))).select("path", F.array_join("samples", "|").alias("samples"))


@_b.query(
    """WITH s AS (SELECT user_id % 50 AS p, event_type, count(*) AS k, max(ts::DATE) AS d FROM events GROUP BY 1, 2), r AS (SELECT p, sum(k)::BIGINT AS seen, max(d) AS d FROM s GROUP BY 1), l AS (SELECT max(ts::DATE) AS now FROM events)
SELECT 'f' || p AS path, CASE WHEN seen >= 3 AND now - d <= 90 THEN 'integer' END AS known_type FROM r, l"""
)
def registry_lookup(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("path", F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")))
    empty = spark.createDataFrame([], "path string, field_type string, confidence double, seen long, last_seen date, streams array<string>")
    seen = e.select("path", F.lit("integer").alias("field_type"), F.lit(0.9).alias("confidence"), F.to_date("ts").alias("last_seen"), F.col("event_type").alias("stream"))
    registry = inference.registry_record(empty, seen)
    now = e.agg(F.max(F.to_date("ts")).alias("now")).first()["now"]
    return inference.registry_lookup(e.select("path").distinct(), registry, F.lit(now)).select("path", "known_type")


@_b.query(
    CELLS
    + """, n AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1)
SELECT event_type AS cluster_id, path, count(*) AS seen, round(count(*) / any_value(n), 6) AS presence, count(*) FILTER (kind = 'null') AS nulls, count(DISTINCT text) AS distinct FROM cells JOIN n USING (event_type) GROUP BY 1, 2"""
)
def profile_clusters(spark, sf_dir):
    p = reports.profile_stream(events(spark, sf_dir), event_cells(spark, sf_dir, ("seq",)))
    return p.select("cluster_id", "path", "seen", F.round("presence", 6).alias("presence"), "nulls", "distinct")


@_b.query(
    """WITH s AS (SELECT event_type, count(*) AS size FROM events GROUP BY 1), a AS (SELECT event_type, least(size, least(size, 10) + floor(greatest(0, 1000 - count(*) OVER () * 10) * size / sum(size) OVER ())::BIGINT) AS n FROM s)
SELECT event_type AS event_kind, n, round(n / sum(n) OVER (), 6) AS frequency, n >= 30 AS valid FROM a"""
)
def multi_schema(spark, sf_dir):
    conf, _ = reports.multi_schema(events(spark, sf_dir))
    return conf.select("event_kind", "n", F.round("frequency", 6).alias("frequency"), "valid")


@_b.query(
    CELLS
    + """SELECT seq, '{' || string_agg(member, ',' ORDER BY member) || '}' AS raw FROM (SELECT seq, '"' || path || '":' || CASE WHEN kind = 'null' THEN 'null' WHEN kind = 'string' THEN '"' || text || '"' ELSE text END AS member FROM cells WHERE path NOT LIKE '%.%'
UNION ALL SELECT seq, '"user":{' || string_agg('"' || substr(path, 6) || '":' || CASE WHEN kind = 'string' THEN '"' || text || '"' ELSE text END, ',' ORDER BY path) || '}' FROM cells WHERE path LIKE 'user.%' GROUP BY seq) GROUP BY seq"""
)
def rebuilt_events(spark, sf_dir):
    return rebuild(event_cells(spark, sf_dir, ("seq",)))


@_b.query("SELECT event_id AS seq, 'user_' || substr(sha256('u' || user_id || '@example.com'), 1, 8) || '@example.com' AS email FROM events")
def scrubbed_emails(spark, sf_dir):
    c = event_cells(spark, sf_dir, ("seq",)).filter(F.col("path") == "user.email")
    found = spark.createDataFrame([("user.email", "email")], "path string, category string")
    return reports.scrub(c, found).select("seq", F.col("text").alias("email"))


QUERIES, SQL = _b.queries, _b.sql
