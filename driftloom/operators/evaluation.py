"""Evaluation: inject labelled drift, score findings, simulate false discoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import stats
from driftloom.operators.sampling import draw

FIELDS = 1000
KINDS = ("type_flip", "enum_add", "presence_drop", "field_added", "field_removed", "pii_add", "nesting_change")


def inject(cells: DataFrame, kind: str, path: str, rate: float = 1.0, seed: int = 42, value: str | None = None) -> DataFrame:
    """Cells with one drift in ``rate`` of the events, chosen by hash."""
    hit = F.conv(F.substring(draw(F.col("seq"), f"{seed}-{kind}-{path}"), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) < rate
    own = (F.col("path") == path) & hit
    cols = cells.select("seq", "path", "kind", "text")
    if kind == "field_removed" or kind == "presence_drop":
        return cols.filter(~own)
    if kind == "type_flip":
        to = F.when(F.col("kind") == "string", "integer").otherwise("string")
        text = F.when(F.col("kind") == "string", F.length("text").cast("string")).otherwise(F.concat(F.lit("v"), "text"))
        return cols.withColumn("text", F.when(own, text).otherwise(F.col("text"))).withColumn("kind", F.when(own, to).otherwise(F.col("kind")))
    if kind in ("enum_add", "pii_add"):
        new = F.lit(value or ("NEW_VALUE" if kind == "enum_add" else "someone@example.com"))
        return cols.withColumn("kind", F.when(own, "string").otherwise(F.col("kind"))).withColumn("text", F.when(own, new).otherwise(F.col("text")))
    if kind == "field_added":
        return cols.union(cells.select("seq").distinct().filter(hit).select("seq", F.lit(path), F.lit("string"), F.lit(value or "new")))
    if kind == "nesting_change":
        return cols.withColumn("path", F.when(own, F.concat("path", F.lit(".value"))).otherwise(F.col("path")))
    raise ValueError(f"unknown drift {kind}")


def labels(kind: str, path: str) -> list[tuple[str, str]]:
    """The findings (path, drift_type) that an injection should cause."""
    return {
        "type_flip": [(path, "type_changed")],
        "enum_add": [(path, "enum_changed")],
        "presence_drop": [(path, "presence_drop")],
        "field_added": [(path, "field_added")],
        "field_removed": [(path, "field_removed")],
        "pii_add": [(path, "new_pii")],
        "nesting_change": [(path, "field_removed"), (path + ".value", "field_added")],
    }[kind]


def score(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of distinct keys."""
    a, b = found.select(*keys).distinct().withColumn("a", F.lit(1)), expected.select(*keys).distinct().withColumn("b", F.lit(1))
    c = a.join(b, keys, "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    p, r, f = stats.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def score_schema(inferred: DataFrame, truth: DataFrame) -> DataFrame:
    """Field detection, type and required agreement of (path, field_type, required)."""
    j = inferred.select("path", F.col("field_type").alias("t"), F.col("required").alias("r"), F.lit(1).alias("i")).join(truth.select("path", "field_type", "required", F.lit(1).alias("g")), "path", "full")
    both = F.col("i").isNotNull() & F.col("g").isNotNull()
    c = j.agg(
        F.count_if(both).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("i").isNull()).alias("fn"),
        F.count_if(both & (F.col("t") == F.col("field_type"))).alias("types"), F.count_if(both & (F.col("r") == F.col("required"))).alias("requireds"),
    )
    p, r, f = stats.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), F.try_divide("types", "tp").alias("type_accuracy"), F.try_divide("requireds", "tp").alias("required_accuracy"))


def false_positive_rate(findings: DataFrame, fields: DataFrame) -> DataFrame:
    n, k = fields.agg(F.count("*").alias("fields")), findings.agg(F.count_distinct("path").alias("flagged"))
    return k.crossJoin(n).withColumn("fpr", F.coalesce(F.try_divide("flagged", "fields"), F.lit(0.0)))  # one row each


def detection_latency(timeline: DataFrame, expected: DataFrame) -> DataFrame:
    """The smallest prefix (size, path, drift_type) with an expected finding."""
    return timeline.join(expected, ["path", "drift_type"], "left_semi").agg(F.min("size").alias("latency"))


def uniform(spark_range: DataFrame, *salt: Column) -> Column:
    h = F.md5(F.concat_ws("-", *(s.cast("string") for s in salt)).cast("binary"))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def simulate_fdr(spark, simulations: int = 200, tests: int = 50, true_share: float = 0.1, q: float = 0.05, seed: int = 7) -> DataFrame:
    """Mean false discovery proportion and power of BH over simulated p-values."""
    r = spark.range(simulations * tests).select((F.col("id") / tests).cast("long").alias("sim"), (F.col("id") % tests).alias("test"))
    u = uniform(r, F.lit(seed), F.col("sim"), F.col("test"))
    real = F.col("test") < F.lit(int(tests * true_share))
    p = r.withColumn("real", real).withColumn("p", F.when(real, F.pow(u, F.lit(12.0))).otherwise(u))
    t = stats.benjamini_hochberg(p, "p", ["test"], ["sim"], q)
    by = t.groupBy("sim").agg(F.count_if("significant").alias("found"), F.count_if(F.col("significant") & ~F.col("real")).alias("false"), F.count_if(F.col("significant") & F.col("real")).alias("true"), F.count_if("real").alias("all"))
    return by.agg(F.avg(F.coalesce(F.try_divide("false", "found"), F.lit(0.0))).alias("fdr"), F.avg(F.try_divide("true", "all")).alias("power"), F.count("*").alias("simulations"))


def generate(spark, schema: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(seq, path, kind, text): n synthetic events of a schema (path, field_type,
    presence, enum), each value drawn from a hash of event and path."""
    ids = spark.range(n).withColumnRenamed("id", "seq")
    if schema.count() > FIELDS:
        raise ValueError(f"a schema has at most {FIELDS} fields")
    j = ids.join(F.broadcast(schema.select("path", "field_type", "presence", "enum")))  # checked above
    u = lambda s: uniform(j, F.lit(f"{seed}{s}"), F.col("seq"), F.col("path"))
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("seq").cast("string"), F.col("path")).cast("binary"))
    t = F.col("field_type")
    whole = F.floor(u("v") * 10_000).cast("string")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    text = (
        F.when(F.size("enum") > 0, F.get("enum", F.floor(u("e") * F.size("enum")).cast("int")))
        .when(t == "integer", whole)
        .when(t == "float", F.concat(whole, F.lit(".5")))
        .when(t == "boolean", F.when(u("b") < 0.5, "true").otherwise("false"))
        .when(t == "uuid", uuid)
        .when(t == "email", F.concat(F.lit("user"), whole, F.lit("@example.com")))
        .when(t == "timestamp_epoch_ms", (F.lit(1_700_000_000_000) + F.floor(u("t") * 1e9).cast("long")).cast("string"))
        .when(t == "timestamp_iso8601", F.concat(F.lit("2024-01-"), F.lpad((F.floor(u("t") * 28) + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")))
        .when(t == "date", F.concat(F.lit("2024-01-"), F.lpad((F.floor(u("t") * 28) + 1).cast("string"), 2, "0")))
        .when(t == "array", "[]")
        .otherwise(F.concat(F.lit("s"), F.substring(h, 1, 6)))
    )
    kind = F.when(t.isin("integer", "timestamp_epoch_ms"), "integer").when(t.isin("float", "boolean", "array"), t).otherwise("string")
    return j.filter(u("p") < F.col("presence")).select("seq", "path", kind.alias("kind"), text.alias("text"))
