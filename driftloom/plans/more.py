"""Queries: the operators beside the main paths, each on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import pii, stats, text
from driftloom.operators import drift, evaluation, history, incidents, inference, lineage, profile, sampling
from driftloom.operators.cells import cells
from driftloom.plans.fixtures import CELLS, DEPTH, SEMANTIC, event_cells, events
from driftloom.plans.joins import _SNAP, _drifts, _fields, _snapshots, _used
from driftloom.plans.joins import _FIELDS, _USED
from driftloom.plans.registry import Book
from driftloom.plans.tables import _lines
from driftloom.sources import parse

_b = Book()
r6 = lambda c: F.round(c, 6)
_read = lambda spark, sf_dir, t: spark.read.parquet(f"{sf_dir}/{t}.parquet")


@_b.query(CELLS + "SELECT path, kind, count(*) AS n FROM cells WHERE path NOT LIKE '%[]%' GROUP BY ALL")
def flatten_without_arrays(spark, sf_dir):
    c = cells(events(spark, sf_dir), depth=DEPTH, arrays=False)
    return c.groupBy("path", "kind").agg(F.count("*").alias("n"))


@_b.query("SELECT event_type, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '-42'), event_id) <= 20")
def cluster_samples(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("seq"))
    return sampling.reservoir_by(e, ["event_type"], 20)


@_b.query("SELECT event_id AS seq FROM events ORDER BY md5(event_id::VARCHAR || '-42'), event_id LIMIT (SELECT greatest(1, round_even(0.03 * count(*), 0))::BIGINT FROM events)")
def exact_choice(spark, sf_dir):
    return sampling.choose(_read(spark, sf_dir, "events").select(F.col("event_id").alias("seq")), 0.03)


@_b.query(
    """SELECT event_type AS cluster_id, 'cluster_removed' AS change FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type IN (SELECT min(event_type) FROM events) GROUP BY 1
UNION ALL SELECT event_type, 'cluster_added' FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type IN (SELECT max(event_type) FROM events) GROUP BY 1"""
)
def cluster_changes(spark, sf_dir):
    """The first type is taken out of the later half, the last one out of the earlier."""
    e = _read(spark, sf_dir, "events").select(F.col("event_type").alias("cluster_id"), (F.col("ts") < "2024-01-16").alias("old"))
    ends = e.agg(F.min("cluster_id").alias("first"), F.max("cluster_id").alias("last"))
    e = e.crossJoin(F.broadcast(ends))  # one row
    return history.cluster_changes(e.filter(F.col("old") & (F.col("cluster_id") != F.col("last"))), e.filter(~F.col("old") & (F.col("cluster_id") != F.col("first"))))


@_b.query(f"WITH {_FIELDS}, r AS (SELECT path, unnest(['orders', 'documents', 'labels']) AS stream FROM (VALUES ('doc_id'), ('o_custkey')) t(path)) SELECT r.stream, r.path, f.path IS NOT NULL AS declared FROM r LEFT JOIN fields f ON f.stream = r.stream AND f.path = r.path")
def registry_streams(spark, sf_dir):
    r = spark.createDataFrame([("doc_id", ["orders", "documents", "labels"]), ("o_custkey", ["orders", "documents", "labels"])], "path string, streams array<string>")
    return lineage.registry_streams(r, _fields(spark, sf_dir)).select("stream", "path", F.col("field_type").isNotNull().alias("declared"))


@_b.query("WITH p AS (SELECT DISTINCT substr(sha256(event_type || '|' || user_id), 1, 16) AS fingerprint, event_type, user_id FROM events), c AS (SELECT fingerprint, count(*) AS fields FROM p WHERE user_id % 3 = 0 GROUP BY 1) SELECT p.fingerprint, fields, fields IS NOT NULL AS hit FROM p LEFT JOIN c USING (fingerprint)")
def fingerprint_cache(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.substring(F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256), 1, 16).alias("fingerprint"), "event_type", "user_id").distinct()
    cache = e.filter(F.col("user_id") % 3 == 0).groupBy("fingerprint").agg(F.count("*").alias("fields"))
    return inference.cache_probe(e.select("fingerprint"), cache)


@_b.query("SELECT CASE WHEN count(DISTINCT event_type) <= 1 THEN 'single' ELSE 'event_type_field' END AS method, 'event_type' AS field FROM events")
def routing(spark, sf_dir):
    e = events(spark, sf_dir)
    c = profile.clusters(e)
    return profile.detection_method(c).crossJoin(profile.routing_field(e, c))  # one row each


@_b.query(
    """WITH f AS (SELECT event_type AS path, CASE WHEN user_id % 2 = 0 THEN 'type_changed' ELSE 'new_pii' END AS drift_type, event_id AS size FROM events)
SELECT min(size) AS latency FROM f WHERE drift_type = 'new_pii' AND path IN (SELECT max(event_type) FROM events)"""
)
def detection_latency(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    timeline = e.select(F.col("event_type").alias("path"), F.when(F.col("user_id") % 2 == 0, "type_changed").otherwise("new_pii").alias("drift_type"), F.col("event_id").alias("size"))
    return evaluation.detection_latency(timeline, e.agg(F.max("event_type").alias("path")).withColumn("drift_type", F.lit("new_pii")))


@_b.query(
    _SNAP
    + """, x AS (SELECT *, (snapshot_date - min(snapshot_date) OVER (PARTITION BY path))::DOUBLE AS d FROM snap), g AS (SELECT path, count(*) AS n, arg_max(presence, snapshot_date) AS l, regr_sxx(presence, d) AS sxx, regr_syy(presence, d) AS syy, regr_sxy(presence, d) AS sxy FROM x GROUP BY path),
v AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0 END AS slope FROM g), f AS (SELECT text, min(week) AS d FROM wk WHERE path = 'currency' GROUP BY 1),
w AS (SELECT CASE WHEN n < 3 THEN true WHEN sqrt(greatest(0, (syy - slope * slope * sxx) / n)) > 0.1 OR abs(slope) > 0.002 THEN false WHEN path = 'currency' THEN (SELECT round(count(*) FILTER (d > (SELECT min(week) FROM wk)) / (SELECT max(week) - min(week) FROM wk) * 30, 2) FROM f) <= 1 ELSE true END AS good FROM v)
SELECT round(avg(good::INT), 3) AS stability FROM w"""
)
def stability(spark, sf_dir):
    return history.stability(history.velocity(_snapshots(spark, sf_dir)))


@_b.query(
    _SNAP
    + f""", t AS (SELECT week, path, count(DISTINCT {SEMANTIC}) AS k, min({SEMANTIC}) AS one FROM wk WHERE kind <> 'null' GROUP BY 1, 2), u AS (SELECT week AS snapshot_date, path, CASE WHEN k > 1 THEN 'mixed' ELSE one END AS field_type FROM t),
l AS (SELECT *, lag(field_type) OVER (PARTITION BY path ORDER BY snapshot_date) AS was FROM u) SELECT path, snapshot_date, was, field_type FROM l WHERE was <> field_type"""
)
def type_changes(spark, sf_dir):
    return history.type_changes(_snapshots(spark, sf_dir)).drop("cluster_id")


@_b.query(_SNAP + "SELECT 'main' AS cluster_id, min(week) AS oldest, max(week) AS latest, count(DISTINCT week) AS n FROM wk")
def snapshot_dates(spark, sf_dir):
    return history.snapshot_dates(_snapshots(spark, sf_dir))


@_b.query(
    _SNAP
    + """, o AS (SELECT * FROM snap WHERE snapshot_date = (SELECT min(week) FROM wk)), l AS (SELECT * FROM snap WHERE snapshot_date = (SELECT max(week) FROM wk))
SELECT coalesce(o.path, l.path) AS path, round(o.presence, 6) AS oldest, round(l.presence, 6) AS latest FROM o FULL JOIN l ON o.path = l.path"""
)
def first_and_last_snapshot(spark, sf_dir):
    a, b = history.ends(_snapshots(spark, sf_dir))
    return a.select("path", r6("presence").alias("oldest")).join(b.select("path", r6("presence").alias("latest")), "path", "full")


@_b.query(
    f"""WITH {_FIELDS}, i AS (SELECT event_id % 3 + 1 AS tier, event_id % 2 = 0 AS open FROM events)
SELECT (SELECT count(DISTINCT stream) FROM fields) AS streams, (SELECT count(*) FROM fields) AS fields, (SELECT count(*) FROM fields WHERE path LIKE '%name') AS pii_fields, count(*) FILTER (open) AS open_incidents, count(*) FILTER (open AND tier = 3) AS open_breaking FROM i"""
)
def metrics_summary(spark, sf_dir):
    f = _fields(spark, sf_dir).withColumn("pii", F.when(F.endswith("path", F.lit("name")), F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")))
    i = _read(spark, sf_dir, "events").select((F.col("event_id") % 3 + 1).alias("tier"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("resolved").alias("status"))
    return lineage.metrics_summary(f, i)


@_b.query("SELECT event_type AS stream, event_id AS at FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 10")
def drift_history(spark, sf_dir):
    return lineage.latest_reports(_read(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("at")))


@_b.query("SELECT CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, (event_id % 3 + 1)::INT AS tier, count(*) AS n, sum(user_id)::BIGINT AS occurrences FROM events GROUP BY 1, 2")
def incident_status(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return incidents.status(e.select(F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("open").alias("status"), (F.col("event_id") % 3 + 1).cast("int").alias("tier"), F.col("user_id").alias("occurrences")))


@_b.query(
    """SELECT event_id AS id FROM events WHERE event_id % 4 < 2 OR date_diff('day', ts::DATE, DATE '2024-01-31') <= 7"""
)
def pruned_incidents(spark, sf_dir):
    """Old incidents that are resolved or accepted go; the others stay."""
    e = _read(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("open", "suppressed", "resolved", "accepted"))), (F.col("event_id") % 4 + 1).cast("int"))
    s = e.select(F.col("event_id").alias("id"), status.alias("status"), F.to_date("ts").alias("last_seen"), F.col("event_type").alias("path"), F.lit("x").alias("drift_type"))
    return incidents.prune(s, F.to_date(F.lit("2024-01-31")), most=1 << 30).select("id")


@_b.query(
    """WITH o AS (SELECT event_type AS path, count(*) AS n FROM events GROUP BY 1), f AS (SELECT path, n, CASE ascii(path) % 2 WHEN 0 THEN 'integer' ELSE 'string' END AS t FROM o)
SELECT path, CASE WHEN t = 'integer' AND n >= 3 THEN 'float' ELSE t END AS field_type, t = 'integer' AND n >= 3 AS corrected FROM f"""
)
def corrected_types(spark, sf_dir):
    o = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("n"))
    f = o.select("path", F.when(F.ascii("path") % 2 == 0, "integer").otherwise("string").alias("field_type"))
    return inference.correct_types(f, o.withColumn("observed_type", F.lit("float"))).select("path", "field_type", "corrected")


@_b.query("SELECT CASE event_id % 5 WHEN 3 THEN 'clean' WHEN 4 THEN 'clean' ELSE 'partial' END AS quality, count(*) AS n FROM events WHERE event_id % 5 <> 2 GROUP BY 1")
def parse_quality(spark, sf_dir):
    clean, partial = parse.split_by_quality(parse.resilient(_lines(spark, sf_dir)))
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("quality"), "n")
    return count(clean, "clean").union(count(partial, "partial")).filter("n > 0")


@_b.query(
    """WITH q AS (SELECT event_id AS seq, CASE WHEN event_id % 5 >= 3 THEN 'clean' ELSE 'partial' END AS quality FROM events WHERE event_id % 5 <> 2)
SELECT seq, quality FROM q QUALIFY row_number() OVER (PARTITION BY quality ORDER BY md5(seq::VARCHAR || '-42')) <= 50"""
)
def quality_samples(spark, sf_dir):
    return parse.quality_sample(parse.resilient(_lines(spark, sf_dir)), 50).select("seq", "quality")


@_b.query(r"SELECT event_id AS id, 'call sk-*** api_key=***' AS line FROM events")
def masked_lines(spark, sf_dir):
    i = F.lpad(F.col("event_id").cast("string"), 12, "0")
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), pii.mask_keys(F.concat(F.lit("call sk-"), i, F.lit(" api_key="), i)).alias("line"))


@_b.query(
    r"""WITH v AS (SELECT event_id, user_id % 256 AS a, event_id % 300 AS b FROM events), t AS (SELECT event_id AS id, a, b, '+1 555' || lpad((event_id % 1000)::VARCHAR, 4, '0') AS phone FROM v)
SELECT id, b <= 255 AND (a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR greatest(a, b) > 100) AS ip, regexp_matches(phone, '\+\d{1,3}[\s-]?\d{3,14}') AS phone FROM t"""
)
def value_checks(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    ip = F.concat_ws(".", (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 300).cast("string"), F.lit("1"), F.lit("1"))
    phone = F.concat(F.lit("+1 555"), F.lpad((F.col("event_id") % 1000).cast("string"), 4, "0"))
    return e.select(F.col("event_id").alias("id"), pii.looks_like_ip(ip).alias("ip"), pii.looks_like_phone(phone).alias("phone"))


@_b.query(
    """WITH t AS (SELECT event_type AS field, event_id % 4 AS test, (event_id % 97) / 97.0 AS effect, event_id % 10 = 0 AND user_id % 2 = 0 AS significant FROM events)
SELECT field, bool_or(significant) AS drifted, arg_min('t' || test, (-effect, test)) FILTER (significant) AS dominant, round(coalesce(max(effect) FILTER (significant), max(effect)), 6) AS max_effect FROM t GROUP BY field"""
)
def field_tests(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    t = e.select(F.col("event_type").alias("field"), F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string")).alias("test"), (F.col("event_id") % 97 / 97.0).alias("effect"), ((F.col("event_id") % 10 == 0) & (F.col("user_id") % 2 == 0)).alias("significant"))
    return stats.summarise_tests(t, ["field"]).withColumn("max_effect", r6("max_effect"))


@_b.query(
    """WITH t AS (SELECT event_id AS id, (event_id * 37 % 1009) / 100900.0 AS p, event_id % 5 AS fam FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, id) AS rk, count(*) OVER (PARTITION BY fam) AS m FROM t),
a AS (SELECT *, least(1, min(p * m / rk) OVER (PARTITION BY fam ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) < 0.005 AS hit FROM r)
SELECT fam, count(*) AS tests, count(*) FILTER (hit) AS significant, count(*) FILTER (p < 0.005 AND NOT hit) AS suppressed, round(coalesce(count(*) FILTER (p < 0.005 AND NOT hit) / nullif(count(*) FILTER (p < 0.005 OR hit), 0), 0), 6) AS rate FROM a GROUP BY fam"""
)
def suppression(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    t = e.select(F.col("event_id").alias("id"), (F.col("event_id") * 37 % 1009 / 100900.0).alias("p"), (F.col("event_id") % 5).alias("fam"))
    return stats.suppression_rate(stats.benjamini_hochberg(t, "p", ["id"], ["fam"], 0.005), ["fam"]).withColumn("rate", r6("rate"))


@_b.query(
    f"""WITH {_FIELDS}, i AS (SELECT event_type AS stream, count(*) AS k FROM events WHERE event_id % 2 = 0 GROUP BY 1), t AS (SELECT DISTINCT event_type AS topic FROM events UNION SELECT DISTINCT '_' || event_type FROM events UNION SELECT DISTINCT stream FROM fields)
SELECT topic, topic LIKE '%s' AS known, CASE WHEN topic LIKE '%s' THEN '1.0.0' END AS version, coalesce(k, 0) AS open_incidents FROM t LEFT JOIN i ON i.stream = t.topic WHERE topic NOT LIKE '\\_%' ESCAPE '\\' AND topic LIKE '%e%'"""
)
def discovered_topics(spark, sf_dir):
    e, streams = _read(spark, sf_dir, "events"), _fields(spark, sf_dir).select("stream").distinct()
    topics = e.select(F.col("event_type").alias("topic")).union(e.select(F.concat(F.lit("_"), "event_type"))).union(streams).distinct()
    schemas = topics.filter(F.endswith("topic", F.lit("s"))).select(F.col("topic").alias("stream"), F.lit("1.0.0").alias("version"))
    found = e.select(F.col("event_type").alias("stream"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("resolved").alias("status"))
    return lineage.discover(topics, schemas, found, "*e*")


@_b.query(
    f"""WITH {_USED}, w AS (SELECT path, max(tier) AS tier FROM drifts GROUP BY 1)
SELECT consumer, path, CASE WHEN tier = 3 AND required THEN 'stop the release until the consumer is changed' WHEN tier = 3 THEN 'tell the consumer''s team before the release' WHEN tier = 2 AND criticality = 'high' THEN 'test the consumer against the new shape' WHEN tier = 2 THEN 'tell the consumer''s team' ELSE 'nothing to do' END AS advice FROM used JOIN w USING (path)"""
)
def consumer_advice(spark, sf_dir):
    j = _used(spark).join(_drifts(spark).groupBy("path").agg(F.max("tier").alias("tier")), "path")
    return j.select("consumer", "path", lineage.recommendation(F.col("criticality"), F.col("required"), F.col("tier")).alias("advice"))


@_b.query(f"WITH {_FIELDS}, {_USED}, s AS (SELECT path, string_agg(DISTINCT stream, ',' ORDER BY stream) AS others FROM fields WHERE stream <> 'documents' GROUP BY 1), c AS (SELECT path, string_agg(DISTINCT consumer, ',' ORDER BY consumer) AS consumers FROM used GROUP BY 1) SELECT path, tier, others, consumers FROM drifts LEFT JOIN s USING (path) LEFT JOIN c USING (path)")
def enriched_findings(spark, sf_dir):
    e = lineage.enrich(_drifts(spark), _fields(spark, sf_dir), _used(spark), "documents")
    return e.select("path", "tier", F.array_join("other_streams", ",").alias("others"), F.array_join("consumers", ",").alias("consumers"))


@_b.query("SELECT count(DISTINCT event_type) AS streams, count(DISTINCT user_id) AS consumers, count(DISTINCT event_id % 7) AS fields, count(*) AS accesses FROM events")
def access_totals(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("user_id").cast("string").alias("consumer"), (F.col("event_id") % 7).cast("string").alias("field"), F.col("event_id").alias("seen"))
    return lineage.access_stats(lineage.access_edges(e))


@_b.query(
    CELLS
    + """, s AS (SELECT path, CASE WHEN kind = 'float' THEN 'number' ELSE kind END AS t FROM cells), k AS (SELECT path, count(*) FILTER (t <> 'null') AS present, count(DISTINCT t) FILTER (t <> 'null') AS kinds, min(t) FILTER (t <> 'null') AS one FROM s GROUP BY path)
SELECT path, CASE kinds WHEN 0 THEN 'null' WHEN 1 THEN one ELSE 'mixed' END AS field_type, round(present / (SELECT count(*) FROM ev), 6) AS presence, present / (SELECT count(*) FROM ev) >= 0.8 AS required FROM k"""
)
def sketch_profile(spark, sf_dir):
    c = event_cells(spark, sf_dir, ("seq",))
    whole = profile.merge_sketches(profile.sketch(c.filter("seq % 2 = 0")), profile.sketch(c.filter("seq % 2 = 1")))
    return profile.from_sketch(whole, events(spark, sf_dir).count()).select("path", "field_type", r6("presence").alias("presence"), "required")


@_b.query("SELECT DISTINCT regexp_replace('a.' || event_type || '[].x-' || user_id % 5, '\\[\\]', '', 'g').regexp_replace('[^A-Za-z0-9_]', '_', 'g') AS column_name, event_type || '-value' AS subject FROM events")
def safe_names(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    path = F.concat(F.lit("a."), "event_type", F.lit("[].x-"), (F.col("user_id") % 5).cast("string"))
    return e.select(text.safe_column(path).alias("column_name"), text.subject_for_topic(F.col("event_type")).alias("subject")).distinct()


@_b.query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'incident' WHEN 1 THEN 'proposal' ELSE 'log' END AS destination FROM events")
def class_routing(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("drift", "evolution", "noise"))), (F.col("event_id") % 3 + 1).cast("int"))
    return drift.destinations(_read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("class"))).drop("class")


@_b.query(
    """WITH f AS (SELECT event_type AS path, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS k FROM events GROUP BY 1), r AS (SELECT path, row_number() OVER (ORDER BY path) % 4 AS m, k FROM f)
SELECT path, CASE WHEN m = 1 THEN 'integer' ELSE 'string' END AS field_type, CASE WHEN m = 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS presence, CASE WHEN m = 3 THEN 'email' ELSE '' END AS pii FROM r WHERE m <> 0"""
)
def accepted_schema(spark, sf_dir):
    """The types are fields of a schema; each has one kind of finding, accepted."""
    p = _read(spark, sf_dir, "events").select(F.col("event_type").alias("path")).distinct()
    m = p.select("path", (F.row_number().over(_by_path()) % 4).alias("m"))
    none = F.array().cast("array<string>")
    schema = m.select("path", F.lit("string").alias("field_type"), F.lit(1.0).alias("presence"), none.alias("pii"))
    kind = F.element_at(F.array(*map(F.lit, ("field_removed", "type_changed", "presence_drop", "new_pii"))), (F.col("m") + 1).cast("int"))
    found = m.select("path", kind.alias("drift_type"), F.lit(0.5).alias("after"), F.lit("integer").alias("new_type"), F.when(F.col("m") == 3, F.array(F.lit("email"))).otherwise(none).alias("pii"))
    return history.accept(schema, found).withColumn("pii", F.array_join("pii", ","))


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")  # a row a field


@_b.query(
    """WITH s AS (SELECT DISTINCT event_type AS path, true AS required FROM events), r AS (SELECT path, required, row_number() OVER (ORDER BY path) % 3 AS m FROM s)
SELECT path, m <> 1 AS required FROM r WHERE m <> 2"""
)
def applied_proposals(spark, sf_dir):
    p = _read(spark, sf_dir, "events").select(F.col("event_type").alias("path")).distinct().withColumn("required", F.lit(True))
    m = p.withColumn("m", F.row_number().over(_by_path()) % 3)
    taken = m.select("path", F.when(F.col("m") == 1, "demote_to_optional").when(F.col("m") == 2, "remove_field").otherwise("promote_to_required").alias("action"))
    return history.apply_proposals(p, taken)


@_b.query("SELECT event_type AS path, CASE WHEN user_id % 2 = 0 THEN 'suppressed' ELSE 'open' END AS status, count(*) AS n FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL UNION ALL SELECT event_type, 'open', count(*) FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY ALL")
def suppressed_incidents(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    first = e.agg(F.min("event_type")).first()[0]
    state = e.select(F.col("event_type").alias("path"), F.when(F.col("user_id") % 2 == 0, "type_changed").otherwise("new_pii").alias("drift_type"), F.lit("open").alias("status"))
    return incidents.suppress(state, first, "type_changed").groupBy("path", "status").agg(F.count("*").alias("n"))


QUERIES, SQL = _b.queries, _b.sql
