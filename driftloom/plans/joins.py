"""Queries: lineage, history, incidents, evaluation, windows of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.operators import drift, evaluation, history, incidents, lineage, profile
from driftloom.plans import detection_sql
from driftloom.plans.fixtures import CELLS, SEMANTIC, event_cells, events
from driftloom.plans.registry import Book

_b = Book()
r6 = lambda c: F.round(c, 6)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# Declared consumers of the tables' fields: (stream, name, criticality, path, required).
CONSUMERS = (
    ("orders", "billing", "high", "o_totalprice", True),
    ("orders", "billing", "high", "o_custkey", True),
    ("orders", "reports", "low", "o_orderdate", False),
    ("customer", "billing", "high", "c_custkey", True),
    ("documents", "search", "medium", "text", True),
    ("pages", "search", "medium", "url", False),
    ("labels", "training", "high", "doc_id", True),
    ("documents", "training", "high", "doc_id", True),
)
DRIFTS = (("o_totalprice", 3), ("o_orderdate", 2), ("doc_id", 2), ("doc_id", 3), ("url", 1))
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x) for x in r) + ")" for r in rows)
_USED = f"used AS (SELECT * FROM (VALUES {_values(CONSUMERS)}) t(stream, consumer, criticality, path, required)), drifts AS (SELECT * FROM (VALUES {_values(DRIFTS)}) t(path, tier))"
_FIELDS = "fields AS (SELECT table_name AS stream, column_name AS path FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + "))"


def _fields(spark, sf_dir):
    rows = [(t, f.name, f.dataType.simpleString()) for t in TABLES for f in spark.read.parquet(f"{sf_dir}/{t}.parquet").schema]
    return spark.createDataFrame(rows, "stream string, path string, field_type string")


def _used(spark):
    return spark.createDataFrame([(s, c, "team", k, p, r) for s, c, k, p, r in CONSUMERS], "stream string, consumer string, team string, criticality string, path string, required boolean")


def _drifts(spark):
    return spark.createDataFrame(list(DRIFTS), "path string, tier int")


@_b.query(f"WITH {_FIELDS} SELECT path, string_agg(DISTINCT stream, ',' ORDER BY stream) AS streams, count(DISTINCT stream)::INT AS n_streams FROM fields GROUP BY path")
def field_graph(spark, sf_dir):
    return lineage.field_graph(_fields(spark, sf_dir)).select("path", F.array_join("streams", ",").alias("streams"), "n_streams")


@_b.query(
    CELLS
    + f""", f AS (SELECT half, path, {SEMANTIC} AS t FROM cells WHERE kind <> 'null' QUALIFY row_number() OVER (PARTITION BY half, path ORDER BY seq) <= 50),
t AS (SELECT half, path, CASE WHEN count(DISTINCT f.t) = 0 THEN 'null' WHEN count(DISTINCT f.t) = 1 THEN min(f.t) ELSE 'mixed' END AS t FROM (SELECT DISTINCT half, path FROM cells) LEFT JOIN f USING (half, path) GROUP BY 1, 2)
SELECT path, count(*)::INT AS n_streams, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM t GROUP BY path HAVING count(DISTINCT t) > 1"""
)
def inconsistencies(spark, sf_dir):
    """The halves of the events are two streams."""
    t = profile.field_types(event_cells(spark, sf_dir, ("seq", "half")), ["half"])
    return lineage.inconsistencies(t.withColumnRenamed("half", "stream")).select("path", "n_streams", F.array_join("types", ",").alias("types"))


@_b.query(f"WITH {_FIELDS} SELECT path FROM fields WHERE stream = 'documents' INTERSECT SELECT path FROM fields WHERE stream = 'conversations'")
def shared_fields(spark, sf_dir):
    return lineage.shared_fields(_fields(spark, sf_dir), "documents", "conversations")


@_b.query(
    f"""WITH {_USED}, w AS (SELECT path, max(tier) AS tier FROM drifts GROUP BY 1)
SELECT consumer, criticality, max(tier) AS highest_tier, count(*) AS fields, count(*) FILTER (required AND tier = 3) AS hard_breaks, (CASE criticality WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * max(tier))::INT AS score FROM used JOIN w USING (path) GROUP BY 1, 2"""
)
def blast_radius(spark, sf_dir):
    return lineage.blast_radius(_drifts(spark), _used(spark))


@_b.query(f"WITH {_USED} SELECT DISTINCT consumer FROM used WHERE consumer NOT IN (SELECT consumer FROM used WHERE path IN (SELECT path FROM drifts WHERE tier = 3))")
def unaffected_consumers(spark, sf_dir):
    return lineage.unaffected(_drifts(spark).filter("tier = 3"), _used(spark))


@_b.query(f"WITH {_USED} SELECT stream, consumer, criticality, required FROM used WHERE path = 'doc_id'")
def field_blast_radius(spark, sf_dir):
    return lineage.field_blast_radius(_used(spark), "doc_id")


@_b.query(f"WITH {_USED}, {_FIELDS} SELECT f.stream, f.path, coalesce(string_agg(DISTINCT consumer, ',' ORDER BY consumer), '') AS consumers FROM fields f LEFT JOIN used u ON u.stream = f.stream AND u.path = f.path WHERE f.path = 'doc_id' AND f.stream <> 'documents' GROUP BY 1, 2")
def graph_blast_radius(spark, sf_dir):
    g = lineage.graph_blast_radius(_fields(spark, sf_dir), _used(spark), "documents", "doc_id")
    return g.select("stream", "path", F.array_join("consumers", ",").alias("consumers"))


@_b.query("SELECT event_type AS consumer, 'f' || (user_id % 4) AS field, count(*) AS count, max(event_id) AS last_seen FROM events GROUP BY 1, 2")
def observed_consumers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    touched = e.select(F.lit("events").alias("stream"), F.col("event_type").alias("consumer"), F.concat(F.lit("f"), (F.col("user_id") % 4).cast("string")).alias("field"), F.col("event_id").alias("seen"))
    return lineage.access_edges(touched).drop("stream")


@_b.query(f"WITH {_USED}, o AS (SELECT 'documents' AS stream, 'text' AS path, 'search' AS consumer, count(*) AS n FROM documents UNION ALL SELECT 'documents', 'lang', 'router', count(lang) FROM documents) SELECT coalesce(u.stream, o.stream) AS stream, coalesce(u.path, o.path) AS path, coalesce(u.consumer, o.consumer) AS consumer, u.stream IS NOT NULL AS declared, coalesce(n, 0) AS count FROM used u FULL JOIN o ON u.stream = o.stream AND u.path = o.path AND u.consumer = o.consumer")
def declared_and_observed(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    touch = lambda who, f: d.filter(F.col(f).isNotNull()).agg(F.count("*").alias("count")).select(F.lit("documents").alias("stream"), F.lit(who).alias("consumer"), F.lit(f).alias("field"), "count", F.lit(0).alias("last_seen"))
    both = lineage.declared_and_observed(_used(spark), touch("search", "text").union(touch("router", "lang")))
    return both.select("stream", "path", "consumer", "declared", "count")


# -- history -----------------------------------------------------------------

_SNAP = (
    CELLS
    + """, wk AS (SELECT *, day - ((dayofmonth(day) - 1) % 7)::INT AS week FROM cells), n AS (SELECT week, count(DISTINCT seq) AS n FROM wk GROUP BY 1),
snap AS (SELECT week AS snapshot_date, path, count(*) / any_value(n) AS presence, count(*) FILTER (kind = 'string') AS strings FROM wk JOIN n USING (week) GROUP BY 1, 2)"""
)


_GROWN = """, first_seen AS (SELECT text, min(week) AS d FROM wk WHERE path = 'currency' GROUP BY 1), span AS (SELECT min(week) AS d0, greatest(max(week) - min(week), 1) AS days FROM wk WHERE path = 'currency'),
grown AS (SELECT round(count(*) FILTER (d > d0) / any_value(days) * 30, 2) AS growth FROM first_seen, span)"""


def _snapshots(spark, sf_dir):
    week = F.date_sub("day", (F.dayofmonth("day") - 1) % 7)
    c = event_cells(spark, sf_dir, ("seq", "day")).withColumn("snapshot_date", week)
    e = events(spark, sf_dir).withColumn("snapshot_date", week)
    p = profile.presence(c, e, ["snapshot_date"])
    cur = c.filter(F.col("path") == "currency").groupBy("snapshot_date", "path").agg(F.array_sort(F.collect_set("text")).alias("enum"))
    t = profile.field_types(c, ["snapshot_date"], None)
    s = p.join(cur, ["snapshot_date", "path"], "left").join(t, ["snapshot_date", "path"])
    return s.select("snapshot_date", F.lit("main").alias("cluster_id"), "path", "presence", "field_type", F.coalesce("enum", F.array().cast("array<string>")).alias("enum"))


@_b.query(
    _SNAP
    + _GROWN
    + """, x AS (SELECT *, (snapshot_date - min(snapshot_date) OVER (PARTITION BY path))::DOUBLE AS d FROM snap),
g AS (SELECT path, count(*) AS n, arg_min(presence, snapshot_date) AS f, arg_max(presence, snapshot_date) AS l, regr_sxx(presence, d) AS sxx, regr_syy(presence, d) AS syy, regr_sxy(presence, d) AS sxy FROM x GROUP BY path),
v AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0 END AS slope FROM g), z AS (SELECT *, sqrt(greatest(0, (syy - slope * slope * sxx) / n)) AS sigma FROM v)
SELECT path, n, round(f, 6) AS first_presence, round(l, 6) AS last_presence, round(slope, 6) AS slope, round(sigma, 6) AS sigma,
trend, growth AS enum_growth, CASE WHEN trend = 'declining' AND l < 0.4 THEN 'removal_risk' WHEN trend = 'declining' AND slope < -0.01 THEN 'fast_decline' WHEN trend = 'volatile' AND l < 0.35 THEN 'unstable' WHEN growth > 1 THEN 'enum_growth' END AS alert
FROM (SELECT *, CASE WHEN n < 3 THEN 'insufficient_data' WHEN sigma > 0.10 THEN 'volatile' WHEN slope > 0.002 THEN 'rising' WHEN slope < -0.002 THEN 'declining' ELSE 'stable' END AS trend, CASE WHEN path = 'currency' THEN (SELECT growth FROM grown) END AS growth FROM z)"""
)
def velocity(spark, sf_dir):
    v = history.velocity(_snapshots(spark, sf_dir))
    return v.select("path", "n", r6("first_presence").alias("first_presence"), r6("last_presence").alias("last_presence"), "slope", "sigma", "trend", "enum_growth", "alert")


@_b.query(_SNAP + _GROWN + " SELECT 'currency' AS path, growth AS enum_growth FROM grown")
def enum_growth(spark, sf_dir):
    return history.enum_growth(_snapshots(spark, sf_dir)).select("path", "enum_growth")


@_b.query(
    CELLS
    + detection_sql.HALVES
    + """, n AS (SELECT half, count(*) AS n FROM ev GROUP BY 1), p AS (SELECT path, count(*) FILTER (half = 'baseline') / (SELECT n FROM n WHERE half = 'baseline') AS a, count(*) FILTER (half = 'observed') / (SELECT n FROM n WHERE half = 'observed') AS b FROM cells GROUP BY 1)
SELECT path, change, significance FROM (SELECT path, 'field_added' AS change, CASE WHEN b >= 0.8 THEN 'breaking' ELSE 'non_breaking' END AS significance FROM p WHERE a = 0 UNION ALL SELECT path, 'field_removed', CASE WHEN a >= 0.8 THEN 'breaking' ELSE 'non_breaking' END FROM p WHERE b = 0
UNION ALL SELECT path, 'presence_changed', CASE WHEN abs(b - a) >= 0.15 THEN 'non_breaking' ELSE 'informational' END FROM p WHERE a > 0 AND b > 0 AND abs(b - a) >= 0.02
UNION ALL SELECT path, 'required_changed', CASE WHEN b >= 0.8 THEN 'breaking' ELSE 'non_breaking' END FROM p WHERE a > 0 AND b > 0 AND (a >= 0.8) <> (b >= 0.8)
UNION ALL SELECT path, 'type_changed', CASE WHEN b.ty IN ('integer', 'float', 'string') AND o.ty = 'mixed' OR o.ty IN ('integer', 'float', 'string') AND b.ty = 'mixed' OR least(b.ty, o.ty) = 'float' AND greatest(b.ty, o.ty) = 'integer' THEN 'non_breaking' ELSE 'breaking' END FROM b_p b JOIN o_p o USING (path) WHERE b.ty <> o.ty
UNION ALL SELECT DISTINCT 'currency', 'enum_added', 'non_breaking' FROM oc WHERE path = 'currency' AND text NOT IN (SELECT text FROM bc WHERE path = 'currency')
UNION ALL SELECT DISTINCT 'currency', 'enum_removed', 'breaking' FROM bc WHERE path = 'currency' AND text NOT IN (SELECT text FROM oc WHERE path = 'currency')
UNION ALL SELECT DISTINCT path, 'pii_added', 'breaking' FROM o_pii x WHERE path IN (SELECT path FROM b_p) AND category NOT IN (SELECT category FROM b_pii y WHERE y.path = x.path))"""
)
def profile_diff(spark, sf_dir):
    c, e = event_cells(spark, sf_dir, ("seq", "half")), events(spark, sf_dir)
    side = []
    for half in ("baseline", "observed"):
        b = drift.baseline_of(c.filter(F.col("half") == half), e.filter(F.col("half") == half), enums=False)
        cur = c.filter((F.col("half") == half) & (F.col("path") == "currency")).groupBy("path").agg(F.array_sort(F.collect_set("text")).alias("values"))
        b = b.join(cur, "path", "left").withColumn("enum", F.coalesce("values", "enum"))
        side.append(b.select(F.lit("main").alias("cluster_id"), "path", "field_type", "presence", (F.col("presence") >= 0.8).alias("required"), "enum", "pii"))
    return history.diff(*side).select("path", "change", "significance")


@_b.query(
    """WITH c AS (SELECT event_type AS path, dayofmonth(ts) AS cycle, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT path, cycle, 1 - sum(n) OVER (PARTITION BY path ORDER BY cycle) / sum(n) OVER (PARTITION BY path) AS rate FROM c),
d AS (SELECT *, rate - lag(rate) OVER (PARTITION BY path ORDER BY cycle) AS delta, row_number() OVER (PARTITION BY path ORDER BY cycle DESC) AS age FROM (SELECT * FROM r WHERE cycle <= 20 QUALIFY row_number() OVER (PARTITION BY path ORDER BY cycle DESC) <= 10)),
w AS (SELECT *, max(delta) OVER x AS worst, avg(delta) OVER x AS step, count(delta) OVER x AS k FROM d WINDOW x AS (PARTITION BY path ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT path, round(rate, 6) AS rate, round(step, 6) AS mean_delta, round((rate - 0.25) / abs(step), 6) AS cycles_left FROM w WHERE age = 1 AND k = 3 AND worst < 0 AND abs(step) >= 0.005 AND rate > 0.25 AND (rate - 0.25) / abs(step) <= 3"""
)
def pre_drift_trend(spark, sf_dir):
    """The share of each type's events still to come falls by the day; seen from day 20."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = e.groupBy(F.col("event_type").alias("path"), F.dayofmonth("ts").alias("cycle")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("path")
    r = c.select("path", "cycle", (1 - F.sum("n").over(whole.orderBy("cycle")) / F.sum("n").over(whole)).alias("rate")).filter("cycle <= 20")
    t = history.trend_warnings(r, 0.25)
    return t.select("path", r6("rate").alias("rate"), r6("mean_delta").alias("mean_delta"), r6("cycles_left").alias("cycles_left"))


DECLARED = (("amount", True, "float"), ("legacy", True, "integer"), ("card", False, "string"), ("flag", True, "boolean"), ("currency", False, "string"), ("note", False, "string"))


@_b.query(
    _SNAP
    + ", every AS (SELECT week AS snapshot_date, path, coalesce(presence, 0) AS presence FROM (SELECT DISTINCT week FROM wk) CROSS JOIN (SELECT DISTINCT path FROM wk) LEFT JOIN (SELECT snapshot_date AS week, path, presence FROM snap) USING (week, path))"
    + f""", x AS (SELECT *, (snapshot_date - min(snapshot_date) OVER (PARTITION BY path))::DOUBLE AS d FROM every),
g AS (SELECT path, count(*) AS n, arg_min(presence, snapshot_date) AS f, arg_max(presence, snapshot_date) AS l, regr_sxx(presence, d) AS sxx, regr_syy(presence, d) AS syy, regr_sxy(presence, d) AS sxy FROM x GROUP BY path),
v AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0 END AS slope FROM g), z AS (SELECT *, sqrt(greatest(0, (syy - slope * slope * sxx) / n)) AS sigma FROM v WHERE n >= 4),
declared AS (SELECT * FROM (VALUES {_values(DECLARED)}) t(path, required, field_type)),
a AS (SELECT z.*, coalesce(required, false) AS required, round(sigma, 6) AS s6, CASE WHEN sigma > 0.10 THEN 'volatile' WHEN slope > 0.002 THEN 'rising' WHEN slope < -0.002 THEN 'declining' ELSE 'stable' END AS trend FROM z LEFT JOIN declared USING (path)),
r AS (SELECT path, 'promote_to_required' AS action, l AS clarity, 0.95 AS cap, n, s6 FROM a WHERE NOT required AND l >= 0.85 AND f >= 0.8 UNION ALL SELECT path, 'demote_to_optional', 1 - l, 0.95, n, s6 FROM a WHERE required AND l < 0.65
  UNION ALL SELECT path, 'remove_field', 1 - l, 0.8, n, s6 FROM a WHERE l < 0.2 AND trend = 'declining'),
c AS (SELECT path, action, least(cap, round(least(0.95, greatest(0, 0.6 * least(n / 8.0, 1) + 0.4 * least(1, clarity) - CASE WHEN s6 > 0.15 THEN 0.1 ELSE 0 END)), 3))::DOUBLE AS confidence FROM r)
SELECT path, action, confidence, confidence >= 0.9 AND action NOT IN ('remove_field', 'widen_type') AS automatic FROM c"""
)
def proposals(spark, sf_dir):
    v = history.velocity(history.fill_absent(_snapshots(spark, sf_dir)))
    declared = spark.createDataFrame(list(DECLARED), "path string, required boolean, field_type string")
    return history.proposals(v, declared).select("path", "action", "confidence", "automatic")


# -- incidents ---------------------------------------------------------------


@_b.query(
    """WITH f AS (SELECT DISTINCT event_type AS cluster_id, 'f' || (user_id % 3) AS path, hour(ts) + 24 * dayofyear(ts) AS poll FROM events WHERE value > 0),
i AS (SELECT *, poll - row_number() OVER (PARTITION BY cluster_id, path ORDER BY poll) AS island FROM f)
SELECT cluster_id, path, min(poll)::INT AS first_poll, max(poll)::INT AS last_poll, count(*) AS occurrences FROM i GROUP BY cluster_id, path, island"""
)
def incident_lifecycle(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("value") > 0)
    f = e.select(F.col("event_type").alias("cluster_id"), F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("path"), F.lit("type_changed").alias("drift_type"), (F.hour("ts") + 24 * F.dayofyear("ts")).alias("poll"), F.lit(2).alias("tier"))
    return incidents.lifecycle(f).select("cluster_id", "path", F.col("first_poll").cast("int").alias("first_poll"), F.col("last_poll").cast("int").alias("last_poll"), "occurrences")


@_b.query(
    """WITH k AS (SELECT ts < TIMESTAMP '2024-01-16' AS old, event_type AS cluster_id, 'f' || (user_id % 29) AS path, CASE user_id % 2 WHEN 0 THEN 'type_changed' ELSE 'new_pii' END AS drift_type, event_id, user_id, ts FROM events WHERE event_id % 7 < 3),
state AS (SELECT cluster_id, path, drift_type, max(user_id % 3 + 1)::INT AS tier, CASE min(event_id) % 4 WHEN 2 THEN 'resolved' WHEN 3 THEN 'suppressed' ELSE 'open' END AS status, min(ts)::DATE AS first_detected, max(ts)::DATE AS last_seen, count(*) AS occurrences FROM k WHERE old GROUP BY 1, 2, 3),
found AS (SELECT cluster_id, path, drift_type, max(user_id % 3 + 1)::INT AS tier FROM k WHERE NOT old AND event_id % 7 = 0 GROUP BY 1, 2, 3)
SELECT coalesce(s.cluster_id, f.cluster_id) AS cluster_id, coalesce(s.path, f.path) AS path, coalesce(s.drift_type, f.drift_type) AS drift_type, coalesce(s.tier, f.tier) AS tier, CASE WHEN s.path IS NULL THEN 'open' WHEN s.status = 'open' AND f.path IS NULL THEN 'resolved' ELSE s.status END AS status,
  coalesce(s.first_detected, DATE '2024-02-01') AS first_detected, CASE WHEN s.path IS NULL OR (s.status = 'open' AND f.path IS NOT NULL) THEN DATE '2024-02-01' ELSE s.last_seen END AS last_seen, CASE WHEN s.path IS NULL THEN 1 WHEN s.status = 'open' AND f.path IS NOT NULL THEN s.occurrences + 1 ELSE s.occurrences END AS occurrences
FROM (SELECT * FROM state WHERE status <> 'resolved') s FULL JOIN found f ON s.cluster_id = f.cluster_id AND s.path = f.path AND s.drift_type = f.drift_type
UNION ALL SELECT * FROM state WHERE status = 'resolved'"""
)
def incident_merge(spark, sf_dir):
    """Incidents of the first half of the events meet findings of the second."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_id") % 7 < 3)
    e = e.select((F.col("ts") < "2024-01-16").alias("old"), F.col("event_type").alias("cluster_id"), F.concat(F.lit("f"), (F.col("user_id") % 29).cast("string")).alias("path"), F.when(F.col("user_id") % 2 == 0, "type_changed").otherwise("new_pii").alias("drift_type"), "event_id", (F.col("user_id") % 3 + 1).cast("int").alias("tier"), F.to_date("ts").alias("day"))
    keys, first = ["cluster_id", "path", "drift_type"], F.min("event_id") % 4
    state = e.filter("old").groupBy(*keys).agg(F.max("tier").alias("tier"), F.when(first == 2, "resolved").when(first == 3, "suppressed").otherwise("open").alias("status"), F.min("day").alias("first_detected"), F.max("day").alias("last_seen"), F.count("*").alias("occurrences"))
    found = e.filter(~F.col("old") & (F.col("event_id") % 7 == 0)).select(*keys, "tier")
    return incidents.merge(state, found, F.to_date(F.lit("2024-02-01")))


@_b.query(
    """WITH s AS (SELECT event_id % 3 + 1 AS tier, event_id % 2 = 0 AS done, ts AS a, ts + INTERVAL 1 HOUR * (event_id % 10) AS b FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT count(*) AS incidents, count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2, count(*) FILTER (tier = 3) AS tier_3, count(*) FILTER (done) AS resolved, count(*) FILTER (tier = 3) * 4.0::DOUBLE + count(*) FILTER (tier = 2) * 1.0::DOUBLE AS hours_saved,
round(avg(CASE WHEN done THEN (epoch(date_trunc('second', b)) - epoch(date_trunc('second', a))) / 3600.0 END), 6) AS mttr_hours FROM s"""
)
def roi(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    state = e.select((F.col("event_id") % 3 + 1).cast("int").alias("tier"), F.when(F.col("event_id") % 2 == 0, "resolved").otherwise("open").alias("status"), F.col("ts").alias("first_detected"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 10).cast("int"))).alias("last_seen"))
    return incidents.roi(state, F.lit("2024-01-10").cast("timestamp")).withColumn("mttr_hours", r6("mttr_hours"))


# -- evaluation --------------------------------------------------------------


INJECTED = (("enum_add", "currency", 1.0), ("field_removed", "flag", 1.0), ("type_flip", "event_type", 1.0), ("pii_add", "user.id", 1.0), ("presence_drop", "event_id", 0.5), ("field_added", "channel", 1.0), ("nesting_change", "user.id", 1.0))


def _scorecard_sql() -> str:
    """Every injection done and detected again in SQL."""
    clean = ", bc AS (SELECT seq, path, kind, text FROM cells WHERE half = 'baseline'), bn AS (SELECT count(*) AS n FROM ev WHERE half = 'baseline'), " + detection_sql.side("b", "bc", "(SELECT n FROM bn)")
    parts, rows = [clean], []
    for k, (kind, path, rate) in enumerate(INJECTED):
        hit = f"(path = '{path}' AND ('0x' || substr(md5(seq::VARCHAR || '-42-{kind}-{path}'), 1, 8))::BIGINT / 4294967296.0 < {rate})"
        if kind in ("field_removed", "presence_drop"):
            cells = f"SELECT * FROM bc WHERE NOT {hit}"
        elif kind == "type_flip":
            cells = f"SELECT seq, path, CASE WHEN NOT {hit} THEN kind WHEN kind = 'string' THEN 'integer' ELSE 'string' END AS kind, CASE WHEN NOT {hit} THEN text WHEN kind = 'string' THEN length(text)::VARCHAR ELSE 'v' || text END AS text FROM bc"
        elif kind in ("enum_add", "pii_add"):
            new = "NEW_VALUE" if kind == "enum_add" else "someone@example.com"
            cells = f"SELECT seq, path, CASE WHEN {hit} THEN 'string' ELSE kind END AS kind, CASE WHEN {hit} THEN '{new}' ELSE text END AS text FROM bc"
        elif kind == "field_added":
            cells = f"SELECT * FROM bc UNION ALL SELECT DISTINCT seq, '{path}', 'string', 'new' FROM bc"
        else:
            cells = f"SELECT seq, CASE WHEN {hit} THEN path || '.value' ELSE path END AS path, kind, text FROM bc"
        parts.append(f", i{k} AS ({cells}), " + detection_sql.side(f"i{k}", f"i{k}", "(SELECT n FROM bn)") + ", " + detection_sql.drift(f"i{k}", "b", f"i{k}", f"i{k}", "bc", "(SELECT n FROM bn)"))
        wanted = ", ".join(f"('{p}', '{d}')" for p, d in evaluation.labels(kind, path))
        rows.append(f"SELECT '{kind}' AS kind, path, drift_type, w.hit IS NOT NULL AS expected, f.hit IS NOT NULL AS found FROM (SELECT *, 1 AS hit FROM (VALUES {wanted}) v(path, drift_type)) w FULL JOIN (SELECT DISTINCT path, drift_type, 1 AS hit FROM i{k}_found) f USING (path, drift_type)")
    return CELLS + "".join(parts) + " " + " UNION ALL ".join(rows)


def _clean(spark, sf_dir):
    c = event_cells(spark, sf_dir, ("seq", "half")).filter(F.col("half") == "baseline").drop("half")
    return c, events(spark, sf_dir).filter(F.col("half") == "baseline")


@_b.query(_scorecard_sql())
def scorecard(spark, sf_dir):
    """Each kind of drift injected into the clean half: what should be found, what is,
    and false alarms."""
    c, e = _clean(spark, sf_dir)
    base = drift.baseline_of(c, e, enums=True).persist()  # a row a field
    out = None
    for kind, path, rate in INJECTED:
        found = drift.detect(base, evaluation.inject(c, kind, path, rate), e).select("path", "drift_type").distinct().withColumn("found", F.lit(True))
        want = spark.createDataFrame(evaluation.labels(kind, path), "path string, drift_type string").withColumn("expected", F.lit(True))
        row = want.join(found, ["path", "drift_type"], "full").select(F.lit(kind).alias("kind"), "path", "drift_type", *(F.coalesce(x, F.lit(False)).alias(x) for x in ("expected", "found")))
        out = row if out is None else out.union(row)
    return out


@_b.query(CELLS + ", bc AS (SELECT seq, path, kind, text FROM cells WHERE half = 'baseline'), bn AS (SELECT count(*) AS n FROM ev WHERE half = 'baseline'), " + detection_sql.side("b", "bc", "(SELECT n FROM bn)") + ", " + detection_sql.drift("d", "b", "b", "bc", "bc", "(SELECT n FROM bn)", enums=False) + " SELECT count(DISTINCT path) AS flagged, (SELECT count(DISTINCT path) FROM bc) AS fields, round(count(DISTINCT path) / (SELECT count(DISTINCT path) FROM bc), 6) AS fpr FROM d_found")
def false_positives(spark, sf_dir):
    """The clean half against itself: whatever is found is false."""
    c, e = _clean(spark, sf_dir)
    found = drift.detect(drift.baseline_of(c, e), c, e)
    return evaluation.false_positive_rate(found, c.select("path").distinct()).select("flagged", "fields", r6("fpr").alias("fpr"))


@_b.query(
    """WITH q AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS guess, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), c AS (SELECT count(*) FILTER (guess = 1 AND quality = 1) AS tp, count(*) FILTER (guess = 1 AND quality = 0) AS fp, count(*) FILTER (guess = 0 AND quality = 1) AS fn FROM q)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def prf(spark, sf_dir):
    d, lab = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.col("quality").isNotNull())
    j = lab.join(d.select("doc_id", "n_chars"), "doc_id")
    s = evaluation.score(j.filter("n_chars > 500"), j.filter("quality = 1"), ["doc_id"])
    return s.select("tp", "fp", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@_b.query(
    """WITH u AS (SELECT i // 50 AS sim, i % 50 AS test, (('0x' || substr(md5('7-' || (i // 50) || '-' || (i % 50)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM range(10000) r(i)),
t AS (SELECT sim, test, test < 5 AS real, CASE WHEN test < 5 THEN pow(u, 12) ELSE u END AS p FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY p, test) AS rk FROM t),
a AS (SELECT *, least(1, min(p * 50 / rk) OVER (PARTITION BY sim ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) < 0.05 AS hit FROM k),
s AS (SELECT sim, count(*) FILTER (hit) AS found, count(*) FILTER (hit AND NOT real) AS wrong, count(*) FILTER (hit AND real) AS right_ FROM a GROUP BY sim)
SELECT round(avg(CASE WHEN found > 0 THEN wrong / found ELSE 0 END), 6) AS fdr, round(avg(right_ / 5), 6) AS power, count(*) AS simulations FROM s"""
)
def fdr_simulation(spark, sf_dir):
    """Monte Carlo of Benjamini-Hochberg: the false discovery rate stays below q."""
    return evaluation.simulate_fdr(spark).select(r6("fdr").alias("fdr"), r6("power").alias("power"), "simulations")


@_b.query()
def generated_events(spark, sf_dir):
    schema = spark.createDataFrame([("id", "uuid", 1.0, []), ("amount", "float", 0.9, []), ("kind", "string", 1.0, ["a", "b"]), ("at", "timestamp_iso8601", 0.5, [])], "path string, field_type string, presence double, enum array<string>")
    return evaluation.generate(spark, schema, 1000)


# -- windows of time -----------------------------------------------------------


@_b.query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total")).select("event_type", F.col("window.start").alias("window_start"), "n", "total")


@_b.query("SELECT event_type, s AS window_start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY ALL")
def sliding_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type", F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("window_start"), "n")


@_b.query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def session_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


QUERIES, SQL = _b.queries, _b.sql
