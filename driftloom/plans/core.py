"""Queries: cells, profiles, statistics, inference, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import pii, stats, types
from driftloom.operators import drift, inference, profile, sampling
from driftloom.plans import detection_sql
from driftloom.plans.fixtures import CELLS, SEMANTIC, event_cells, events
from driftloom.plans.registry import Book

_b = Book()
r6 = lambda c: F.round(c, 6)

_TYPED = CELLS + f", typed AS (SELECT *, {SEMANTIC} AS t FROM cells WHERE kind <> 'null')"
_P = lambda x: f"(1 - list_sum(list_transform(range(0, 400), lambda n: exp(-({x})/2 + (0.5+n)*ln(({x})/2) - lgamma(1.5+n)))))"


@_b.query(CELLS + "SELECT path, count(*) AS seen, (SELECT count(*) FROM ev) AS total, round(count(*) / (SELECT count(*) FROM ev), 6) AS presence FROM cells GROUP BY path")
def field_presence(spark, sf_dir):
    p = profile.presence(event_cells(spark, sf_dir, ("seq",)), events(spark, sf_dir))
    return p.select("path", "seen", "total", r6("presence").alias("presence"))


@_b.query(CELLS + "SELECT seq, path, kind, text FROM cells")
def flatten_events(spark, sf_dir):
    return event_cells(spark, sf_dir, ("seq",)).select("seq", "path", "kind", "text")


@_b.query(
    _TYPED
    + """, f AS (SELECT path, t FROM typed QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq) <= 50)
SELECT c.path, CASE WHEN count(DISTINCT f.t) = 0 THEN 'null' WHEN count(DISTINCT f.t) = 1 THEN min(f.t) ELSE 'mixed' END AS field_type FROM (SELECT DISTINCT path FROM cells) c LEFT JOIN f USING (path) GROUP BY c.path"""
)
def field_types(spark, sf_dir):
    return profile.field_types(event_cells(spark, sf_dir, ("seq",)))


@_b.query(_TYPED + "SELECT path, t AS type, count(*) AS n FROM (SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq) <= 200) GROUP BY path, t")
def type_histogram(spark, sf_dir):
    return profile.type_histogram(event_cells(spark, sf_dir, ("seq",)))


@_b.query(
    CELLS
    + """SELECT path, count(*) FILTER (kind <> 'null') AS n, count(*) FILTER (kind = 'null') AS nulls, count(DISTINCT text) AS cardinality,
min(CASE WHEN kind IN ('integer', 'float') THEN text::DOUBLE END) AS low, max(CASE WHEN kind IN ('integer', 'float') THEN text::DOUBLE END) AS high FROM cells GROUP BY path"""
)
def value_stats(spark, sf_dir):
    return profile.value_stats(event_cells(spark, sf_dir, ("seq",)))


@_b.query("SELECT event_type AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2) AS percent, count(*) < 30 AS warning FROM events GROUP BY event_type")
def type_distribution(spark, sf_dir):
    return profile.distribution(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


@_b.query(
    CELLS
    + """, v AS (SELECT path, text AS value, count(*) AS n FROM cells WHERE kind = 'string' GROUP BY ALL)
SELECT path, value, n, round(n / sum(n) OVER (PARTITION BY path), 4) AS share FROM v QUALIFY count(*) OVER (PARTITION BY path) <= 30"""
)
def value_distribution(spark, sf_dir):
    return profile.value_distribution(event_cells(spark, sf_dir, ("seq",)))


@_b.query(
    CELLS
    + """, d AS (SELECT path, text AS value, min(seq) AS s FROM cells WHERE kind <> 'null' AND length(text) <= 100 GROUP BY ALL)
SELECT path, value, (row_number() OVER (PARTITION BY path ORDER BY s, value))::INT AS nth FROM d QUALIFY nth <= 8"""
)
def distinct_samples(spark, sf_dir):
    return profile.distinct_samples(event_cells(spark, sf_dir, ("seq",)))


@_b.query(
    CELLS
    + """, v AS (SELECT path, text AS value, count(*) AS n, count(*) FILTER (kind <> 'string') AS o FROM cells WHERE kind <> 'null' GROUP BY ALL)
SELECT path, string_agg(value, '|' ORDER BY n DESC, value) AS enum FROM v GROUP BY path HAVING count(*) <= 20 AND sum(o) = 0"""
)
def field_enums(spark, sf_dir):
    return profile.enums(event_cells(spark, sf_dir, ("seq",))).select("path", F.array_join("enum", "|").alias("enum"))


@_b.query(
    """SELECT key, n FROM (SELECT unnest(['event_id', 'event_type', 'user', 'currency', 'ts', 'note', 'tags', 'flag']) AS key, (SELECT count(*) FROM events) AS n
UNION ALL SELECT 'amount', count(*) FROM events WHERE NOT (event_id % 7 = 0 OR (ts >= TIMESTAMP '2024-01-16' AND event_id % 3 = 0))
UNION ALL SELECT CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 'card' ELSE 'legacy' END, count(*) FROM events GROUP BY 1) ORDER BY n DESC, key LIMIT 15"""
)
def top_keys(spark, sf_dir):
    return profile.top_keys(events(spark, sf_dir))


@_b.query(
    """WITH c AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1)
SELECT sum(n)::BIGINT AS n, count(*) AS cardinality, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c"""
)
def entropy(spark, sf_dir):
    e = stats.entropy(events(spark, sf_dir), [], "event_type")
    return e.select("n", "cardinality", r6("entropy").alias("entropy"))


@_b.query(
    """WITH c AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1), e AS (SELECT count(*) AS cardinality, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c)
SELECT 'event_type' AS field, cardinality, 1.0::DOUBLE AS coverage, round(h, 6) AS entropy, round(h / log2(cardinality), 6) AS score, true AS chosen FROM e"""
)
def discriminator_scores(spark, sf_dir):
    d = profile.discriminator_scores(events(spark, sf_dir))
    return d.select("field", "cardinality", r6("coverage").alias("coverage"), r6("entropy").alias("entropy"), r6("score").alias("score"), "chosen")


@_b.query("SELECT event_type AS cluster_id, count(*) AS n FROM events GROUP BY 1")
def cluster_discovery(spark, sf_dir):
    return profile.clusters(events(spark, sf_dir))


@_b.query(
    """SELECT 'struct:' || substr(sha256(array_to_string(list_sort(list_filter(['currency', 'event_id', 'flag', 'note', 'tags', 'ts', 'user', CASE WHEN NOT (event_id % 7 = 0 OR (o AND event_id % 3 = 0)) THEN 'amount' ELSE '' END, CASE WHEN o THEN 'card' ELSE 'legacy' END], lambda x: x <> '')), '|')), 1, 12) AS fingerprint,
count(*) AS n FROM (SELECT *, ts >= TIMESTAMP '2024-01-16' AS o FROM events) GROUP BY 1"""
)
def struct_fingerprint(spark, sf_dir):
    keys = F.filter(profile.visible_keys(F.col("v")), lambda k: k != "event_type")
    return events(spark, sf_dir).groupBy(F.concat(F.lit("struct:"), F.substring(F.sha2(F.array_join(keys, "|"), 256), 1, 12)).alias("fingerprint")).agg(F.count("*").alias("n"))


_W = lambda k, n, s: f"greatest(0, least(1, ((({k})/({n})) + 3.8416/(2*({n})) {s} 1.96*sqrt(({k})/({n})*(1-({k})/({n}))/({n}) + 3.8416/(4*({n})*({n}))))/(1+3.8416/({n}))))"


@_b.query(CELLS + f"SELECT path, count(*) AS k, round({_W('count(*)', '(SELECT count(*) FROM ev)', '-')}, 6) AS low, round({_W('count(*)', '(SELECT count(*) FROM ev)', '+')}, 6) AS high FROM cells GROUP BY path")
def wilson_ci(spark, sf_dir):
    p = profile.presence(event_cells(spark, sf_dir, ("seq",)), events(spark, sf_dir))
    low, high = stats.wilson(F.col("seen"), F.col("total"))
    return p.select("path", F.col("seen").alias("k"), r6(low).alias("low"), r6(high).alias("high"))


@_b.query(
    f"""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM c)
SELECT event_type, n, round(n / total, 6) AS frequency, round({_W('n', 'total', '-')}, 6) AS low, round(least(0.99, 0.5 + 0.1 * log10(n)), 6) AS schema_confidence, n >= 30 AS valid FROM t"""
)
def type_confidence(spark, sf_dir):
    c = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    t = profile.type_confidence(c)
    return t.select("event_type", "n", r6("frequency").alias("frequency"), r6("low").alias("low"), r6("schema_confidence").alias("schema_confidence"), "valid")


# -- statistics --------------------------------------------------------------


@_b.query(
    f"""WITH h AS (SELECT ts >= TIMESTAMP '2024-01-16' AS o, event_type, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT o, sum(n) AS total FROM h GROUP BY o), b AS (SELECT event_type, n / total AS p0 FROM h JOIN t USING (o) WHERE NOT o), x AS (SELECT event_type, n AS k, total AS n FROM h JOIN t USING (o) WHERE o),
z AS (SELECT event_type, k, n::BIGINT AS n, (k / n - p0) / sqrt(p0 * (1 - p0) / n) AS z FROM b JOIN x USING (event_type))
SELECT event_type, k, n, round(z, 6) AS z, round(CASE WHEN z = 0 THEN 1 ELSE {_P('z*z')} END, 6) AS p FROM z"""
)
def presence_ztest(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("event_type").pivot("half", ["baseline", "observed"]).count().na.fill(0)
    t = e.agg(F.sum("baseline").alias("b"), F.sum("observed").alias("o"))
    j = e.crossJoin(F.broadcast(t))  # one row
    z = stats.binomial_z(F.col("baseline") / F.col("b"), F.col("observed"), F.col("o"))
    return j.select("event_type", F.col("observed").alias("k"), F.col("o").alias("n"), r6(z["z"]).alias("z"), r6(z["p"]).alias("p"))


@_b.query(
    """WITH h AS (SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS b, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS o FROM events GROUP BY 1),
e AS (SELECT *, b / sum(b) OVER () * sum(o) OVER () AS x FROM h)
SELECT 'event_type' AS field, round(sum((o - x) * (o - x) / x), 6) AS statistic, (count(*) - 1)::INT AS df, round(sqrt(sum((o - x) * (o - x) / x) / (sum(o) * (count(*) - 1))), 6) AS effect FROM e"""
)
def type_chi2(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.col("event_type").alias("category")).pivot("half", ["baseline", "observed"]).count().na.fill(0)
    pairs = e.select(F.lit("event_type").alias("field"), "category", F.col("baseline").alias("base"), "observed")
    return stats.chi2_test(pairs, ["field"]).select("field", r6("statistic").alias("statistic"), "df", r6("effect").alias("effect"))


@_b.query(
    """WITH b AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' AND value IS NOT NULL),
e AS (SELECT event_type, list_sort(list_distinct(list(v))) AS edges, max(n) AS n FROM b WHERE list_contains(list_transform(range(0, least(10, n) + 1), lambda j: floor(j * (n - 1) / least(10, n))::BIGINT), i) GROUP BY 1),
s AS (SELECT event_type, value AS v, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS side FROM events WHERE value IS NOT NULL),
c AS (SELECT event_type, len(list_filter(edges[2:len(edges)-1], lambda x: x <= v)) AS bin, count(*) FILTER (side = 0) AS b, count(*) FILTER (side = 1) AS o, max(n) AS n, max(len(edges)) AS k FROM s JOIN e USING (event_type) GROUP BY 1, 2),
p AS (SELECT event_type, greatest(b / sum(b) OVER (PARTITION BY event_type), 1.0 / (n * k)) AS pb, greatest(o / sum(o) OVER (PARTITION BY event_type), 1.0 / (n * k)) AS po FROM c)
SELECT event_type, round(sum((po - pb) * ln(po / pb)), 6) AS psi, sum((po - pb) * ln(po / pb)) >= 0.2 AS significant FROM p GROUP BY 1"""
)
def psi_value(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    old, new = e.filter(F.col("ts") < "2024-01-16"), e.filter(F.col("ts") >= "2024-01-16")
    return stats.psi(old, new, ["event_type"], "value").select("event_type", r6("psi").alias("psi"), "significant")


@_b.query(
    """WITH t AS (SELECT event_id AS id, (event_id * 37 % 1009) / 10090.0 AS p, event_id % 5 AS fam FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, id) AS rk, count(*) OVER (PARTITION BY fam) AS m FROM t),
a AS (SELECT *, least(1, min(p * m / rk) OVER (PARTITION BY fam ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj FROM r)
SELECT id, fam, round(adj, 6) AS p_adjusted, adj < 0.01 AS significant, p < 0.01 AND NOT adj < 0.01 AS suppressed FROM a"""
)
def bh_fdr(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")  # a test an event
    t = e.select(F.col("event_id").alias("id"), ((F.col("event_id") * 37 % 1009) / 10090.0).alias("p"), (F.col("event_id") % 5).alias("fam"))
    return stats.benjamini_hochberg(t, "p", ["id"], ["fam"]).select("id", "fam", r6("p_adjusted").alias("p_adjusted"), "significant", "suppressed")


_ECE = """WITH s AS (SELECT least(1.0, n_chars / 6000.0) AS c, quality AS y FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
b AS (SELECT least(floor(c * 10), 9)::INT AS bin, count(*) AS n, avg(c) AS confidence, avg(y::DOUBLE) AS accuracy FROM s GROUP BY 1) """


def _scored(spark, sf_dir):
    d, lab = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lab.filter(F.col("quality").isNotNull()).join(d.select("doc_id", "n_chars"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 6000.0).alias("c"), F.col("quality").alias("y"))


@_b.query(_ECE + "SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b")
def ece(spark, sf_dir):
    return stats.expected_calibration_error(_scored(spark, sf_dir), "c", "y").select(r6("ece").alias("ece"), "n")


@_b.query(_ECE + "SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(abs(confidence - accuracy), 6) AS gap FROM b")
def calibration_bins(spark, sf_dir):
    c = stats.calibration(_scored(spark, sf_dir), "c", "y")
    return c.select("bin", "n", r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"), r6("gap").alias("gap"))


# -- inference ---------------------------------------------------------------


@_b.query(
    CELLS
    + f""", k AS (SELECT path, kind, count(*) AS c FROM cells WHERE kind <> 'null' GROUP BY ALL), a AS (SELECT path, max(c) AS k, sum(c) AS n, count(*) AS kinds, min(kind) AS one FROM k GROUP BY path),
s AS (SELECT path, count(*) / (SELECT count(*) FROM ev) AS presence FROM cells GROUP BY path),
first AS (SELECT path, text FROM (SELECT path, kind, text, row_number() OVER (PARTITION BY path ORDER BY seq) AS nth FROM cells WHERE kind <> 'null') WHERE nth <= 20 AND kind = 'string'), {detection_sql.personal("f", "cells", "first")},
t AS (SELECT path, presence, CASE WHEN n IS NULL THEN 'null' WHEN kinds > 1 THEN 'mixed' ELSE one END AS field_type, CASE WHEN n IS NULL THEN 0.3 ELSE round({_W('k', 'n', '-')}, 4) END AS c FROM s LEFT JOIN a USING (path))
SELECT path, field_type, round(presence, 6) AS presence, presence >= 0.8 AS required, CASE WHEN field_type IN ('string', 'integer') THEN least(c, 0.7) WHEN field_type = 'mixed' THEN least(c, 0.5) ELSE c END AS confidence,
coalesce((SELECT string_agg(category, ',' ORDER BY category) FROM f_pii p WHERE p.path = t.path), '') AS pii FROM t"""
)
def statistical_inference(spark, sf_dir):
    f = inference.statistical(event_cells(spark, sf_dir, ("seq",)), events(spark, sf_dir))
    return f.select("path", "field_type", r6("presence").alias("presence"), "required", "confidence", F.array_join("pii", ",").alias("pii"))


@_b.query(
    _TYPED
    + """, v AS (SELECT unnest(range(0, 5)) AS vote), ch AS (SELECT seq, vote FROM ev, v QUALIFY row_number() OVER (PARTITION BY vote ORDER BY md5(seq::VARCHAR || '-' || vote::VARCHAR), seq) <= 200),
sn AS (SELECT c.path, ch.vote, count(DISTINCT t) AS k, min(t) AS one FROM (SELECT seq, path, kind FROM cells) c JOIN ch USING (seq) LEFT JOIN typed USING (seq, path) GROUP BY ALL),
tt AS (SELECT path, CASE WHEN k = 0 THEN 'null' WHEN k = 1 THEN one ELSE 'mixed' END AS t, count(*) AS c FROM sn GROUP BY ALL)
SELECT path, t AS field_type, round(c / sum(c) OVER (PARTITION BY path), 6) AS agreement, (sum(c) OVER (PARTITION BY path))::BIGINT AS votes_seen FROM tt QUALIFY row_number() OVER (PARTITION BY path ORDER BY c DESC, t) = 1"""
)
def quorum_types(spark, sf_dir):
    q = inference.quorum(event_cells(spark, sf_dir, ("seq",)), events(spark, sf_dir))
    return q.select("path", "field_type", r6("agreement").alias("agreement"), "votes_seen")


_PII_SQL = {
    "email": r"regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')",
    "card_number": r"regexp_matches(text, '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b')",
    "passport": r"regexp_matches(text, '\b[A-Z]{1,2}\d{7,9}\b')",
    "national_id": r"(regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') OR regexp_matches(text, '\b\d{4}\s\d{4}\s\d{4}\b'))",
    "phone": r"(regexp_matches(text, '\+\d{1,3}[\s-]?\d{3,14}') OR regexp_matches(text, '\(\d{3}\)\s?\d{3}[\s-]?\d{4}') OR regexp_matches(text, '\b\d{3}[\s-]\d{3}[\s-]\d{4}\b'))",
}


@_b.query("SELECT " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _PII_SQL.items()) + ", count(*) AS documents FROM documents")
def pii_scan(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return d.agg(*(F.count_if(pii.value_hit(F.lit("text"), F.col("text"), k)).alias(k) for k in _PII_SQL), F.count("*").alias("documents"))


@_b.query(CELLS + ", first AS (SELECT path, text FROM cells WHERE kind = 'string' QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq) <= 20), " + detection_sql.personal("f", "first", "first") + " SELECT path, category, confidence, source FROM f_pii")
def pii_fields(spark, sf_dir):
    c = event_cells(spark, sf_dir, ("seq",)).filter(F.col("kind") == "string")
    few = profile.first_n(c, ["path"], pii.FIRST, ["seq"]).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("strings"))
    return few.select("path", F.explode(pii.detect(F.col("path"), F.col("strings"))).alias("x")).select("path", "x.category", F.col("x.confidence").cast("double").alias("confidence"), "x.source")


@_b.query(
    CELLS
    + r""", v AS (SELECT path, text FROM cells WHERE kind IN ('string', 'integer', 'float')), s AS (SELECT path, avg(regexp_matches(text, '^1[3-9]\d{11}$')::INT) AS a, avg(regexp_matches(text, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}')::INT) AS b, avg(regexp_matches(text, '^[^@\s]+@[^@\s]+\.[^@\s]{2,}$')::INT) AS e FROM v GROUP BY path)
SELECT path, CASE WHEN a >= 0.6 THEN 'timestamp_epoch_ms' WHEN b >= 0.6 THEN 'timestamp_iso8601' ELSE 'email' END AS hinted_type FROM s WHERE a >= 0.6 OR b >= 0.6 OR e >= 0.6"""
)
def schema_hints(spark, sf_dir):
    return inference.hints(event_cells(spark, sf_dir, ("seq",))).select("path", "hinted_type")


@_b.query(CELLS + ", f AS (SELECT path, count(*) / (SELECT count(*) FROM ev) >= 0.8 AS r, CASE WHEN count(DISTINCT kind) FILTER (kind <> 'null') > 1 THEN 'mixed' ELSE min(kind) FILTER (kind <> 'null') END AS t FROM cells GROUP BY path) SELECT substr(sha256(string_agg(path || '|' || t || '|' || r::VARCHAR, ';' ORDER BY path || '|' || t || '|' || r::VARCHAR)), 1, 16) AS fingerprint FROM f")
def schema_fingerprint(spark, sf_dir):
    return inference.fingerprint(inference.statistical(event_cells(spark, sf_dir, ("seq",)), events(spark, sf_dir)))


# -- drift -------------------------------------------------------------------


@_b.query(
    CELLS
    + f""", n AS (SELECT half, count(*) AS n FROM ev GROUP BY half), p AS (SELECT path, count(*) FILTER (half = 'baseline') / (SELECT n FROM n WHERE half = 'baseline') AS p0, count(*) FILTER (half = 'observed') AS k, (SELECT n FROM n WHERE half = 'observed') AS n FROM cells GROUP BY path HAVING count(*) FILTER (half = 'baseline') > 0),
z AS (SELECT path, p0, k / n AS p1, CASE WHEN p0 >= 1 THEN CASE WHEN k = n THEN 1.0 ELSE 0.0 END ELSE {_P('(k/n-p0)*(k/n-p0)/(p0*(1-p0)/n)')} END AS p, CASE WHEN p0 >= 1 THEN 0 ELSE (k / n - p0) * (k / n - p0) / (p0 * (1 - p0) / n) END AS zz FROM p)
SELECT path, round(p0, 6) AS before, round(p1, 6) AS after, CASE WHEN p1 < 0.05 AND p0 >= 0.2 THEN 'field_removed' WHEN p1 < p0 THEN 'presence_drop' ELSE 'presence_increase' END AS drift_type FROM z WHERE (p1 < 0.05 AND p0 >= 0.2) OR (CASE WHEN zz > 57 THEN 0 ELSE p END) < 0.01"""
)
def drift_presence(spark, sf_dir):
    f = _findings(spark, sf_dir, family="candidates")
    return f.filter(F.col("drift_type").isin("field_removed", "presence_drop", "presence_increase")).select("path", r6("before").alias("before"), r6("after").alias("after"), "drift_type")


def _findings(spark, sf_dir, **how):
    c = event_cells(spark, sf_dir, ("seq", "half"))
    e = events(spark, sf_dir)
    old, new = F.col("half") == "baseline", F.col("half") == "observed"
    base = drift.baseline_of(c.filter(old), e.filter(old), enums=True)
    return drift.detect(base, c.filter(new), e.filter(new), **how)


@_b.query(CELLS + detection_sql.DRIFT + " SELECT path, drift_type, round(before, 6) AS before, round(after, 6) AS after, tier, class FROM d_found")
def drift_report(spark, sf_dir):
    """Every drift between the two halves."""
    return _findings(spark, sf_dir).select("path", "drift_type", r6("before").alias("before"), r6("after").alias("after"), "tier", "class")


@_b.query(CELLS + detection_sql.DRIFT + " SELECT count(*) AS findings, max(tier) AS highest_tier, count(*) FILTER (class = 'drift') AS drifts, count(*) FILTER (class = 'evolution') AS evolutions, CASE max(tier) WHEN 3 THEN 'block' WHEN 2 THEN 'alert' ELSE 'log' END AS action FROM d_found")
def drift_summary(spark, sf_dir):
    return drift.report(_findings(spark, sf_dir))


@_b.query(CELLS + detection_sql.DRIFT + " SELECT path, old_type, new_type, tier FROM d_found WHERE drift_type = 'type_changed'")
def drift_type(spark, sf_dir):
    return _findings(spark, sf_dir).filter(F.col("drift_type") == "type_changed").select("path", "old_type", "new_type", "tier")


@_b.query(CELLS + detection_sql.DRIFT + " SELECT path, tier, class FROM d_found WHERE drift_type = 'enum_changed'")
def drift_enum(spark, sf_dir):
    return _findings(spark, sf_dir).filter(F.col("drift_type") == "enum_changed").select("path", "tier", "class")


@_b.query(CELLS + detection_sql.DRIFT + " SELECT path, drift_type, round(after, 6) AS after, new_type, tier FROM d_found WHERE drift_type IN ('field_added', 'new_pii')")
def drift_new_fields(spark, sf_dir):
    f = _findings(spark, sf_dir).filter(F.col("drift_type").isin("field_added", "new_pii"))
    return f.select("path", "drift_type", r6("after").alias("after"), "new_type", "tier")


@_b.query(
    f"""WITH g AS (SELECT min(event_type) AS gone FROM events), b AS (SELECT event_type AS c, count(*) / (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-16') AS s FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
left_ AS (SELECT event_type AS c FROM events, g WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> gone), t AS (SELECT count(*) AS n FROM left_), o AS (SELECT c, count(*) AS k FROM left_ GROUP BY c),
j AS (SELECT c, s, coalesce(k, 0) AS k, coalesce(k, 0) / n AS a, n FROM b LEFT JOIN o USING (c), t), z AS (SELECT *, CASE WHEN s >= 1 THEN 0 ELSE (a - s) * (a - s) / (s * (1 - s) / n) END AS zz FROM j)
SELECT c AS cluster_id, 'cluster_routing_regression' AS drift_type, round(s, 6) AS before, round(a, 6) AS after FROM z WHERE s >= 0.1 AND n >= 30 AND (k = 0 OR ((s - a) / s >= 0.2 AND (zz > 57 OR {_P("zz")} < 0.01)))"""
)
def cluster_regression(spark, sf_dir):
    """One family is taken out of the observed half: only its regression is found."""
    e = events(spark, sf_dir)
    base, seen = e.filter(F.col("half") == "baseline"), e.filter(F.col("half") == "observed")
    shares = base.groupBy(F.col("event_type").alias("cluster_id")).agg(F.count("*").alias("n"))
    shares = shares.crossJoin(F.broadcast(base.agg(F.count("*").alias("all")))).select("cluster_id", (F.col("n") / F.col("all")).alias("share"))  # one row
    first = F.broadcast(e.agg(F.min("event_type").alias("gone")))
    left = seen.join(first, F.col("event_type") == F.col("gone"), "left_anti")
    d = drift.cluster_drift(shares, drift.route(left, shares))
    return d.filter(F.col("drift_type") == "cluster_routing_regression").select("cluster_id", "drift_type", r6("before").alias("before"), r6("after").alias("after"))


@_b.query("SELECT '_unknown' AS cluster_id, 'new_cluster' AS drift_type, round(count(*) FILTER (event_type = (SELECT max(event_type) FROM events)) / count(*), 6) AS after FROM events WHERE ts >= TIMESTAMP '2024-01-16'")
def new_cluster(spark, sf_dir):
    """The baseline doesn't know one family: it is found as new."""
    e = events(spark, sf_dir)
    base, seen = e.filter(F.col("half") == "baseline"), e.filter(F.col("half") == "observed")
    last = F.broadcast(e.agg(F.max("event_type").alias("unknown")))
    known = base.join(last, F.col("event_type") == F.col("unknown"), "left_anti")
    shares = known.groupBy(F.col("event_type").alias("cluster_id")).agg(F.count("*").alias("n"))
    shares = shares.crossJoin(F.broadcast(base.agg(F.count("*").alias("all")))).select("cluster_id", (F.col("n") / F.col("all")).alias("share"))  # one row
    d = drift.cluster_drift(shares, drift.route(seen, shares))
    return d.filter(F.col("drift_type") == "new_cluster").select("cluster_id", "drift_type", r6("after").alias("after"))


@_b.query(
    CELLS
    + """SELECT seq, path, problem FROM (SELECT seq, 'amount' AS path, 'missing' AS problem FROM ev WHERE seq NOT IN (SELECT seq FROM cells WHERE path = 'amount')
UNION ALL SELECT seq, path, 'not_in_enum' FROM cells WHERE path = 'currency' AND text NOT IN ('USD', 'EUR', 'GBP') UNION ALL SELECT seq, path, 'wrong_type' FROM cells WHERE path = 'amount' AND kind = 'string'
UNION ALL SELECT seq, path, 'unknown' FROM cells WHERE path NOT IN ('amount', 'currency', 'event_id'))"""
)
def validate_events(spark, sf_dir):
    schema = spark.createDataFrame([("amount", "float", True, []), ("currency", "string", True, ["USD", "EUR", "GBP"]), ("event_id", "integer", True, [])], "path string, field_type string, required boolean, enum array<string>")
    return drift.validate(event_cells(spark, sf_dir, ("seq",)), events(spark, sf_dir), schema, strict=True)


@_b.query(CELLS + f"SELECT path, count(*) AS n, count(*) FILTER (kind = 'null' OR CASE path WHEN 'amount' THEN kind IN ('integer', 'float') WHEN 'ts' THEN kind = 'integer' ELSE true END) AS valid FROM cells WHERE path IN ('amount', 'ts', 'note') GROUP BY path")
def value_validity(spark, sf_dir):
    schema = spark.createDataFrame([("amount", "float"), ("ts", "timestamp_epoch_ms"), ("note", "string")], "path string, field_type string")
    return inference.value_matches(event_cells(spark, sf_dir, ("seq",)), schema)


# -- sampling ----------------------------------------------------------------


@_b.query("SELECT event_id AS seq FROM events ORDER BY md5(event_id::VARCHAR || '-42'), event_id LIMIT 200")
def reservoir_sample(spark, sf_dir):
    return sampling.reservoir(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq")), 200)


@_b.query(
    """WITH s AS (SELECT event_type, count(*) AS size FROM events GROUP BY 1), a AS (SELECT event_type, least(size, least(size, 10) + floor(greatest(0, 300 - count(*) OVER () * 10) * size / sum(size) OVER ())::BIGINT) AS alloc FROM s)
SELECT event_id AS seq, event_type FROM events JOIN a USING (event_type) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '-42'), event_id) <= any_value(alloc) OVER (PARTITION BY event_type)"""
)
def stratified_sample(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), "event_type")
    return sampling.stratified(e, "event_type", 300, 10)


@_b.query("SELECT event_type, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 2000")
def last_n_window(spark, sf_dir):
    return sampling.last_n(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("event_id").alias("seq")), ["event_type"], 2000)


@_b.query(
    """WITH e AS (SELECT event_id AS seq, event_type || '-' || user_id % 40 AS cluster FROM events), f AS (SELECT cluster FROM e GROUP BY cluster ORDER BY min(seq), cluster LIMIT 100)
SELECT * FROM (SELECT cluster, true AS routed, seq FROM e SEMI JOIN f USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY seq DESC) <= 20) UNION ALL SELECT cluster, false, seq FROM e ANTI JOIN f USING (cluster)"""
)
def cluster_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string")).alias("cluster"), F.col("event_id").alias("seq"))
    kept, unrouted = sampling.cluster_windows(e, "cluster", n=20)
    return kept.select("cluster", F.lit(True).alias("routed"), "seq").union(unrouted.select("cluster", F.lit(False), "seq"))


@_b.query("SELECT event_type, user_id, count(*) AS n, (row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id))::INT AS rank FROM events GROUP BY 1, 2 QUALIFY rank <= 5")
def topk_users(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return sampling.top_k(c, ["event_type"], [F.desc("n"), F.asc("user_id")], 5)


@_b.query(
    CELLS
    + """SELECT path, count(*) FILTER (kind <> 'null') AS present, count(*) FILTER (kind = 'null') AS nulls, count(*) FILTER (kind = 'float') AS numbers FROM cells GROUP BY path"""
)
def sketch_presence(spark, sf_dir):
    c = event_cells(spark, sf_dir, ("seq",))
    parts = [profile.sketch(c.filter(F.col("seq") % 3 == k)) for k in range(3)]
    whole = profile.merge_sketches(profile.merge_sketches(parts[0], parts[1]), parts[2])
    return whole.select("path", F.col("present").cast("long").alias("present"), F.col("nulls").cast("long").alias("nulls"), F.coalesce(F.try_element_at("types", F.lit("number")), F.lit(0)).cast("long").alias("numbers"))


QUERIES, SQL = _b.queries, _b.sql
