"""Operator 10: mix sources to target weights by Pareto order sampling.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``share`` times all words; a source's target stops at ``most`` times its words
and the excess goes to the others by weight (water-filling: sort by cap over
weight, find the level).  A source whose rate target / words is r gives every
document floor(r) whole copies, which are certain; the rest of the target is a
sample of unequal probabilities.  A document of s words is included with
p = min(1, level * s), the source's level set so that the words expected, the sum
of p * s, are that rest: long documents, without which a target can't be met
closely, are certain.  Documents are ranked by (u / (1-u)) / (p / (1-p)), u a hash
of the id, and the first ones go in until their words fill the rest (the last one
only if at least half of it fits), so a source misses its target by half a
document at most.

No source is sorted whole: the level comes from counts by size, ranks are counted
into 65,536 bins a source, which are summed in blocks of 256, and only the bin in
which the target falls is ordered.
The cut lies near a rank of 1, where the bins are finest for any p.  The table of
sources is a dimension (a row a source); windows over it run in one task.  Windows
over sizes hold a row for each size that a source's documents have.

Defined results: a null text has size 0; a document of size 0 gets whole copies
only; an empty source takes nothing; rows that repeat an id are ranked by the
text's hash, and wholly equal rows are taken together; a null id is hashed by its
text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialize

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2.0, "mix-1"
BINS, BLOCK = 1 << 16, 1 << 8
P = "__op10_"  # names of helper columns


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) with target and weight added."""
    by_source, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_source) - 1) % len(weights)))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - before) / left)
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    return t.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(id_col: Column, seed: str) -> Column:
    """In (0, 1), from the first 48 bits of an md5."""
    hexed = F.substring(F.md5(F.concat(id_col, F.lit("-" + seed)).cast("binary")), 1, 12)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def levels(counts: DataFrame) -> DataFrame:
    """(source, level) of counts (source, size, n, rest): with p = min(1, level * size)
    the sum of n * p * size is the rest.  The sizes of at most 1 / level are those for
    which the level found without a cap on them is at most 1 / size."""
    by_size = Window.partitionBy("source").orderBy("size")
    words = (F.col("size") * F.col("n")).cast("decimal(38,0)")
    above = F.sum(words).over(Window.partitionBy("source")) - F.sum(words).over(by_size)
    square = F.sum(words * F.col("size").cast("decimal(19,0)")).over(by_size)
    level = (F.col("rest") - above.cast("double")) / square.cast("double")
    return counts.withColumn("level", level).filter(F.col("level") * F.col("size") <= 1).groupBy("source").agg(F.max_by("level", "size").alias("level"))


def _rank(u: Column, size: Column, rest: Column, level: Column) -> Column:
    """Random odds by inclusion odds; null where nothing is to be sampled."""
    p = F.least(F.lit(1.0), F.coalesce(level * size, F.lit(1.0)))
    return F.when((rest > 0) & (size > 0), u * (1 - p) / ((1 - u) * p))


def _stop(bins: DataFrame) -> DataFrame:
    """(source, stop, before) of bins (source, at, words, rest, base): the first bin up
    to which the words after ``base`` reach the rest, and the words before it."""
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("at"))
    found = bins.withColumn("upto", upto).filter(F.col("upto") >= F.col("rest"))
    found = found.groupBy("source").agg(F.min_by(F.struct("at", (F.col("upto") - F.col("words")).alias("before")), "at").alias("e"))
    return found.select("source", F.col("e.at").alias("stop"), F.col("e.before").alias("before"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: float = MOST, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """``docs`` with helper columns size, source_size, target, copies (prefix P)."""
    size = size_of(docs[text_col])
    tie = F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    u = _uniform(F.coalesce(docs[id_col].cast("string"), tie), seed)
    slim = materialize(docs.select(docs[source_col].alias("source"), size.alias("size"), u.alias("u"), docs[id_col].alias("id"), tie.alias("tie")), "op10-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes, share, most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("whole", F.floor(rate).cast("long"))
    t = materialize(t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "op10-targets")
    sampled = t.filter(F.col("rest") > 0).select(F.col("source").alias("of"), "rest")
    counts = slim.filter(F.col("size") > 0).groupBy("source", "size").agg(F.count("*").alias("n"))
    level = levels(counts.join(sampled, F.col("source").eqNullSafe(F.col("of"))).drop("of")).withColumnRenamed("source", "of")
    t = t.join(level, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    t = materialize(t, "op10-levels")

    near = slim["source"].eqNullSafe(t["source"]) & (t["rest"] > 0) & (slim["size"] > 0)
    ranked = slim.join(t, near, "inner").select(slim["source"], "size", "id", "tie", "rest", _rank(F.col("u"), F.col("size"), F.col("rest"), F.col("level")).alias("q"))
    ranked = ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    bins = materialize(ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "op10-bins")
    # The bin in which the midpoint rule stops: the first whose words reach the rest,
    # looked for among blocks of bins and then in one block.
    block = _stop(bins.groupBy("source", F.floor(F.col("bin") / BLOCK).alias("at")).agg(F.sum("words").alias("words"), F.first("rest").alias("rest")).withColumn("base", F.lit(0).cast("long")))
    block = block.select(F.col("source").alias("of"), F.col("stop").alias("block"), F.col("before").alias("base"))
    within = bins.join(block, bins["source"].eqNullSafe(block["of"]) & (F.floor(bins["bin"] / BLOCK) == block["block"]))
    edge = _stop(within.select("source", F.col("bin").alias("at"), "words", "rest", "base"))
    edge = edge.select(F.col("source").alias("edge_source"), F.col("stop").alias("edge_bin"), "before")
    inside = ranked.join(edge, ranked["source"].eqNullSafe(edge["edge_source"]) & (ranked["bin"] == edge["edge_bin"]), "inner")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("q", "id", "tie").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("mid", upto - F.col("size") / 2).filter(F.col("mid") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("q", "id", "tie")).alias("last"))
    last = last.select(F.col("source").alias("last_source"), "last")
    cut = t.join(edge, t["source"].eqNullSafe(edge["edge_source"]), "left").join(last, t["source"].eqNullSafe(last["last_source"]), "left")
    cut = materialize(cut.select(F.col("source").alias(P + "source"), *(F.col(c).alias(P + c) for c in ("source_size", "target", "whole", "rest", "level", "edge_bin", "last"))), "op10-cuts")

    c = lambda n: F.col(P + n)
    joined = docs.withColumn(P + "size", size).withColumn(P + "u", u).join(cut, docs[source_col].eqNullSafe(cut[P + "source"]), "left")
    joined = joined.withColumn(P + "q", _rank(c("u"), c("size"), c("rest"), c("level")))
    at = F.floor(c("q") / (1 + c("q")) * BINS).cast("int")
    row = F.struct(c("q").alias("q"), docs[id_col].alias("id"), tie.alias("tie"))
    extra = F.when(c("q").isNull(), 0).when(c("edge_bin").isNull() | (at < c("edge_bin")), 1).when((at == c("edge_bin")) & c("last").isNotNull() & (row <= c("last")), 1).otherwise(0)
    return joined.select(*(docs[x] for x in docs.columns), P + "size", P + "source_size", P + "target", (c("whole") + extra).alias(P + "copies"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix_sources(load(spark, sf_dir, "documents"))
    c = lambda n: F.col(P + n)
    return m.select("doc_id", c("size").alias("size"), c("source_size").alias("source_size"), c("target").alias("target"), (c("copies") * c("size")).alias("taken"), c("copies").alias("copies"))


SQL_TEXT = rf"""WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS tie, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '-{SEED}'), 1, 12))::BIGINT::DOUBLE + 0.5) / {1 << 48}::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * {MOST}::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l x WHERE x.level <= x.ratio ORDER BY ratio, level LIMIT 1) * weight, cap)) AS target FROM l),
a AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
k AS (SELECT *, floor(rate)::BIGINT AS whole, target - floor(rate) * source_size AS rest FROM a),
n AS (SELECT d.source, d.size, any_value(k.rest) AS rest, count(*) AS n FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source WHERE d.size > 0 AND k.rest > 0 GROUP BY ALL),
g AS (SELECT source, size, (rest - (sum(size * n) OVER (PARTITION BY source) - sum(size * n) OVER (PARTITION BY source ORDER BY size))::DOUBLE)
  / (sum(size * size * n) OVER (PARTITION BY source ORDER BY size))::DOUBLE AS level FROM n),
v AS (SELECT source, arg_max(level, size) AS level FROM g WHERE level * size <= 1 GROUP BY source),
i AS (SELECT d.doc_id, d.size, d.tie, d.u, k.*, least(1.0::DOUBLE, coalesce(v.level * d.size, 1.0::DOUBLE)) AS p FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
  LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source),
j AS (SELECT *, CASE WHEN rest > 0 AND size > 0 THEN u * (1 - p) / ((1 - u) * p) END AS q FROM i),
c AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS mid FROM j)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN q IS NOT NULL AND mid <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
  whole + CASE WHEN q IS NOT NULL AND mid <= rest THEN 1 ELSE 0 END AS copies FROM c"""

QUERIES = {"op10_mix_sources": op10_mix_sources}
SQL = {"op10_mix_sources": SQL_TEXT}
