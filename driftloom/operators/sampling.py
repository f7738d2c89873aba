"""Deterministic samples: order by a hash of the row's number, never by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seq: Column, seed: int | str) -> Column:
    """A hash that other engines can compute too."""
    return F.md5(F.concat(seq.cast("string"), F.lit(f"-{seed}")).cast("binary"))


def reservoir(df: DataFrame, n: int, seed: int | str = 42, seq: str = "seq") -> DataFrame:
    """n rows, each set as likely as any other; all if there are fewer."""
    return df.orderBy(draw(F.col(seq), seed), seq).limit(n)


def reservoir_by(df: DataFrame, keys: list[str], n: int, seed: int | str = 42, seq: str = "seq") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(draw(F.col(seq), seed), seq)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def allocate(sizes: DataFrame, total: int, least: int) -> DataFrame:
    """(stratum, size) with alloc: a minimum each, the rest by share, truncated."""
    whole, kinds = F.sum("size").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    base = F.least(F.col("size"), F.lit(least).cast("long"))
    rest = F.greatest(F.lit(0).cast("long"), F.lit(total) - kinds * F.lit(least))
    return sizes.withColumn("alloc", F.least(F.col("size"), base + F.floor(rest * F.col("size") / whole).cast("long")))


def stratified(df: DataFrame, stratum: str, total: int, least: int = 10, seed: int | str = 42, seq: str = "seq") -> DataFrame:
    """Rows of each stratum up to its allocation; rows without a stratum are left out."""
    known = df.filter(F.col(stratum).isNotNull())
    alloc = allocate(known.groupBy(stratum).agg(F.count("*").alias("size")), total, least)
    w = Window.partitionBy(stratum).orderBy(draw(F.col(seq), seed), seq)
    few = known.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= total)
    return few.join(alloc, stratum).filter(F.col("__r") <= F.col("alloc")).drop("__r", "size", "alloc")


def last_n(df: DataFrame, keys: list[str], n: int, order: str = "seq") -> DataFrame:
    """The newest n rows of each key: a count-based window."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def cluster_windows(df: DataFrame, key: str, known: tuple[str, ...] = (), n: int = 2000, most: int = 100, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(windows, unrouted): the newest n rows of each cluster, and the rows without one.
    Clusters are the known values of ``key`` and, in the order in which they first
    come, new ones up to ``most`` in all; ties go by name.  Rows without a key have no
    cluster."""
    new = df.filter(F.col(key).isNotNull() & ~F.col(key).isin(*known)).groupBy(F.col(key).alias("__c")).agg(F.min(order).alias("__first"))
    open_ = new.orderBy("__first", "__c").limit(max(0, most - len(known))).select("__c")
    if known:
        open_ = open_.union(df.sparkSession.createDataFrame([(k,) for k in known], "__c string"))
    names = F.broadcast(open_)  # at most ``most`` rows, or the known ones
    return last_n(df.join(names, F.col(key) == F.col("__c"), "left_semi"), [key], n, order), df.join(names, F.col(key) == F.col("__c"), "left_anti")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def choose(df: DataFrame, rate: float, seed: int | str = 42, seq: str = "seq") -> DataFrame:
    """Exactly max(1, round(rate * n)) rows."""
    n = df.count()
    return reservoir(df, max(1, round(rate * n)), seed, seq) if n else df
