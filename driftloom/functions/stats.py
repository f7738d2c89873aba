"""Statistics as expressions, and tests as relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA, FDR = 0.01, 0.01
TERMS = 400


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within [0, 1]; (0, 0) without trials."""
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    clip = lambda c: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / (1 + z2 / n)))).otherwise(F.lit(0.0))
    return clip(mid - half), clip(mid + half)


def chi2_survival(x: Column, df: Column) -> Column:
    """P(chi-square of integer df >= x), by the series of the lower gamma function."""
    a, h = df / 2.0, x / 2.0
    odd = df % 2 == 1
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(a).cast("int")))
    lgamma = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.when(i.cast("double") - F.when(odd, 0.5).otherwise(0.0) > 0, F.ln(i - F.when(odd, 0.5).otherwise(0.0))).otherwise(0.0)) + F.when(odd, math.log(math.pi) / 2).otherwise(0.0)
    first = -h + a * F.ln(h) - lgamma
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(first).alias("t"), F.exp(first).alias("s")),
        lambda acc, n: F.struct((acc["t"] * h / (a + n)).alias("t"), (acc["s"] + acc["t"] * h / (a + n)).alias("s")),
        lambda acc: acc["s"],
    )
    far = x > df + 40 * F.sqrt(2.0 * df)
    return F.when((x <= 0) | (df <= 0), F.lit(1.0)).when(far | (first < -700), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - series))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal."""
    return chi2_survival(z * z, F.lit(1))


def binomial_z(p0: Column, k: Column, n: Column, alpha: float = ALPHA) -> Column:
    """struct<z, p, significant, effect>: observed share k/n against p0, two-sided.
    Under p0 of 0 or 1 any deviation has p = 0."""
    rate = k / n
    z = (rate - p0) / F.sqrt(p0 * (1 - p0) / n)
    flat = (p0 <= 0) | (p0 >= 1)
    p = F.when(n <= 0, 1.0).when(flat, F.when(rate == p0, 1.0).otherwise(0.0)).otherwise(normal_p(z))
    return F.struct(F.when((n > 0) & ~flat, z).otherwise(0.0).alias("z"), p.alias("p"), (p < alpha).alias("significant"), F.when(n > 0, F.abs(rate - p0)).otherwise(0.0).alias("effect"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy (log2), distinct values and rows by ``keys``."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("cardinality"), F.sum(F.col("c") * F.log2("c")).alias("w")).select(*keys, "n", "cardinality", F.greatest(F.lit(0.0), F.log2("n") - F.col("w") / F.col("n")).alias("entropy"))


def chi2_test(pairs: DataFrame, keys: list[str], least: float = 5.0, alpha: float = ALPHA) -> DataFrame:
    """Goodness of fit by ``keys``, from rows (keys, category, base, observed counts).

    Expected counts follow the baseline's shares; categories that it lacks share a
    cell with 0.5 expected; cells under ``least`` are merged; fewer than two cells
    give p = 1.  Effect: Cramer's V, at most 1."""
    w = Window.partitionBy(*keys)
    rows = pairs.withColumn("base_n", F.sum("base").over(w)).withColumn("n", F.sum("observed").over(w)).filter((F.col("base") > 0) | (F.col("observed") > 0))
    cells = rows.withColumn("new", F.col("base") <= 0).withColumn("expected", F.col("base") / F.col("base_n") * F.col("n"))
    cells = cells.withColumn("cell", F.when(F.col("new"), F.lit("new")).otherwise(F.concat(F.lit("="), "category")))
    cells = cells.groupBy(*keys, "cell").agg(F.sum("observed").alias("observed"), F.max("n").alias("n"), F.when(F.first("new"), 0.5).otherwise(F.sum("expected")).alias("expected"))
    cells = cells.withColumn("cell", F.when(F.col("expected") < least, F.lit("small")).otherwise(F.col("cell")))
    cells = cells.groupBy(*keys, "cell").agg(F.sum("observed").alias("observed"), F.max("n").alias("n"), F.sum("expected").alias("expected")).filter(F.col("expected") > 0)
    out = cells.groupBy(*keys).agg(F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("statistic"), F.count("*").alias("k"), F.max("n").alias("n"))
    enough = F.col("k") >= 2
    out = out.withColumn("df", F.when(enough, F.col("k") - 1).otherwise(0)).withColumn("statistic", F.when(enough, F.col("statistic")).otherwise(0.0))
    p = F.when(enough, chi2_survival(F.col("statistic"), F.col("df").cast("int"))).otherwise(1.0)
    effect = F.when(enough & (F.col("n") > 0), F.least(F.lit(1.0), F.sqrt(F.col("statistic") / (F.col("n") * F.col("df"))))).otherwise(0.0)
    return out.select(*keys, "statistic", F.col("df").cast("int").alias("df"), p.alias("p"), (p < alpha).alias("significant"), effect.alias("effect"))


def psi(base: DataFrame, observed: DataFrame, keys: list[str], value: str, bins: int = 10, threshold: float = 0.2) -> DataFrame:
    """Population stability index by ``keys``: bins at exact order statistics of the
    baseline, outliers in the end bins, shares floored at 1 / (n * edges)."""
    b = base.select(*keys, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    o = observed.select(*keys, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    # Values are counted before they are ordered; a value holds the places from ``upto - c`` on.
    counts = b.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    k = F.least(F.lit(bins), F.col("n"))
    wanted = F.transform(F.sequence(F.lit(0), k.cast("int")), lambda j: F.floor(j * (F.col("n") - 1) / k))
    edges = ranked.filter(F.exists(wanted, lambda i: (i >= F.col("upto") - F.col("c")) & (i < F.col("upto")))).groupBy(*keys).agg(F.array_sort(F.collect_set("v")).alias("edges"), F.max("n").alias("n"))
    both = b.withColumn("side", F.lit(0)).union(o.withColumn("side", F.lit(1))).join(edges, keys)
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    counted = both.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("v")))).groupBy(*keys, "bin").agg(F.count_if(F.col("side") == 0).alias("b"), F.count_if(F.col("side") == 1).alias("o"), F.max("n").alias("n"), F.max(F.size("edges")).alias("e"))
    w = Window.partitionBy(*keys)
    shares = counted.withColumn("nb", F.sum("b").over(w)).withColumn("no", F.sum("o").over(w)).withColumn("bins", F.count("*").over(w))
    floor = 1.0 / (F.col("n") * F.col("e"))
    pb, po = F.greatest(F.col("b") / F.col("nb"), floor), F.greatest(F.col("o") / F.col("no"), floor)
    out = shares.groupBy(*keys).agg(F.sum((po - pb) * F.ln(po / pb)).alias("psi"), F.max("n").alias("n"), F.max("no").alias("no"), F.max("e").alias("e"), F.max("bins").alias("bins"))
    value_ = F.when((F.col("n") < 2) | (F.col("no") == 0) | (F.col("e") < 2), 0.0).otherwise(F.col("psi"))
    band = F.when(value_ >= threshold, "major").when(value_ >= 0.1, "moderate").otherwise("stable")
    return out.select(*keys, value_.alias("psi"), (value_ >= threshold).alias("significant"), band.alias("band"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", order: list[str] | None = None, family: list[str] | None = None, q: float = FDR) -> DataFrame:
    """``tests`` with p_adjusted, significant and suppressed, within each family.
    The running minimum from the largest p down; rows without p stay null.

    Both frames grow row by row (a frame that ends at the last row is scanned anew for
    each); the first row of the way down holds the family's count.  A family is sorted
    within one task."""
    family, order = family or [], order or []
    known = F.col("__known")  # by name, for an unnamed key is dealt out again for each window
    group = Window.partitionBy(*family, known)
    down = group.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tests.withColumn("__known", F.col(p).isNotNull()).withColumn("__rank", F.row_number().over(group.orderBy(p, *order))).withColumn("__m", F.max("__rank").over(down).cast("long"))
    low = F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(down)
    out = ranked.withColumn("p_adjusted", F.when(known, F.least(F.lit(1.0), low)))
    return out.withColumn("significant", F.col("p_adjusted") < q).withColumn("suppressed", (F.col(p) < q) & ~(F.col("p_adjusted") < q)).drop("__known", "__rank", "__m")


def calibration(pairs: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins: (bin, n, confidence, accuracy, gap)."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    g = pairs.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    return g.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def expected_calibration_error(pairs: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    c = calibration(pairs, score, label, bins)
    return c.agg(F.coalesce(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), F.lit(0.0)).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; 0 where the denominator is."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = over(tp, tp + fp), over(tp, tp + fn)
    return p, r, over(2 * p * r, p + r)


def summarise_tests(tests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, drifted, dominant, max_effect) of rows (keys, test, significant, effect):
    any significant test is a drift, and the one of the largest effect dominates; without
    one, the largest effect of all is told.  Ties go to the test of the smaller name."""
    hit = F.col("significant")
    first = F.min_by("test", F.when(hit, F.struct((-F.col("effect")).alias("e"), "test")))
    g = tests.groupBy(*keys).agg(F.bool_or(hit).alias("drifted"), first.alias("dominant"), F.max(F.when(hit, F.col("effect"))).alias("strong"), F.max("effect").alias("any"))
    return g.select(*keys, "drifted", F.when(F.col("drifted"), F.col("dominant")).alias("dominant"), F.coalesce("strong", "any").alias("max_effect"))


def suppression_rate(tested: DataFrame, family: list[str]) -> DataFrame:
    """(family, tests, significant, suppressed, rate) after Benjamini-Hochberg: the share of
    tests significant alone that the correction holds back."""
    g = tested.groupBy(*family).agg(F.count("*").alias("tests"), F.count_if("significant").alias("significant"), F.count_if("suppressed").alias("suppressed"))
    return g.withColumn("rate", F.coalesce(F.try_divide("suppressed", F.col("significant") + F.col("suppressed")), F.lit(0.0)))
