"""Dated snapshots of profiles: differences, trends, proposals, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions import types

# Thresholds of trends and proposals.
MIN_SNAPSHOTS, SLOPE, SIGMA, ENUM_PER_MONTH = 3, 0.002, 0.10, 1.0
DIFF_PRESENCE, DIFF_MINOR = 0.02, 0.15
WEEKS, AUTO = 4, 0.90
EMPTY = F.array


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def widening_any_order(a: Column, b: Column) -> Column:
    return types.pair_in(a, b, types.WIDENING) | types.pair_in(b, a, types.WIDENING)


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cluster_id, path, change, before, after, significance) between two profiles
    of (cluster_id, path, field_type, presence, required, enum, pii)."""
    side = lambda d, s: d.select("cluster_id", "path", *(F.col(c).alias(f"{c}_{s}") for c in ("field_type", "presence", "required", "enum", "pii")), F.lit(True).alias(f"has_{s}"))
    a, b = side(left, "l").withColumnRenamed("cluster_id", "cl").withColumnRenamed("path", "pl"), side(right, "r")
    j = a.join(b, F.col("cl").eqNullSafe(F.col("cluster_id")) & (F.col("pl") == F.col("path")), "full")
    j = j.withColumn("cluster_id", F.coalesce("cluster_id", "cl")).withColumn("path", F.coalesce("path", "pl"))
    lc, rc = left.select(F.col("cluster_id").alias("c_l")).distinct(), right.select(F.col("cluster_id").alias("c_r")).distinct()
    j = j.join(lc, F.col("cluster_id").eqNullSafe(F.col("c_l")), "left").join(rc, F.col("cluster_id").eqNullSafe(F.col("c_r")), "left")
    both = F.col("has_l") & F.col("has_r")
    delta = F.col("presence_r") - F.col("presence_l")
    s = lambda c: c.cast("string")
    row = lambda name, hit, x, y, sig: F.when(hit, F.struct(F.lit(name).alias("change"), s(x).alias("before"), s(y).alias("after"), sig.alias("significance")))
    v = F.lit
    wide = widening_any_order(F.col("field_type_l"), F.col("field_type_r"))
    gone_enum, new_enum = F.array_except(_list("enum_l"), _list("enum_r")), F.array_except(_list("enum_r"), _list("enum_l"))
    changes = F.array_compact(
        F.array(
            row("field_added", F.col("has_l").isNull() & F.col("c_l").isNotNull(), v(None), F.col("field_type_r"), F.when(F.col("required_r"), "breaking").otherwise("non_breaking")),
            row("field_removed", F.col("has_r").isNull() & F.col("c_r").isNotNull(), F.col("field_type_l"), v(None), F.when(F.col("required_l"), "breaking").otherwise("non_breaking")),
            row("type_changed", both & (F.col("field_type_l") != F.col("field_type_r")), F.col("field_type_l"), F.col("field_type_r"), F.when(wide, "non_breaking").otherwise("breaking")),
            row("presence_changed", both & (F.abs(delta) >= DIFF_PRESENCE - 1e-9), F.col("presence_l"), F.col("presence_r"), F.when(F.abs(delta) >= DIFF_MINOR - 1e-9, "non_breaking").otherwise("informational")),
            row("required_changed", both & (F.col("required_l") != F.col("required_r")), F.col("required_l"), F.col("required_r"), F.when(F.col("required_r"), "breaking").otherwise("non_breaking")),
            row("enum_removed", both & (F.size(gone_enum) > 0), F.array_join(_list("enum_l"), ","), F.array_join(_list("enum_r"), ","), v("breaking")),
            row("enum_added", both & (F.size(new_enum) > 0), F.array_join(_list("enum_l"), ","), F.array_join(_list("enum_r"), ","), v("non_breaking")),
            row("pii_added", both & (F.size(F.array_except(_list("pii_r"), _list("pii_l"))) > 0), F.array_join(_list("pii_l"), ","), F.array_join(_list("pii_r"), ","), v("breaking")),
        )
    )
    return j.select("cluster_id", "path", F.explode(changes).alias("x")).select("cluster_id", "path", "x.*")


def cluster_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.select("cluster_id").distinct(), right.select("cluster_id").distinct()
    return b.join(a, "cluster_id", "left_anti").withColumn("change", F.lit("cluster_added")).union(a.join(b, "cluster_id", "left_anti").withColumn("change", F.lit("cluster_removed")))


def velocity(snapshots: DataFrame) -> DataFrame:
    """Per (cluster_id, path) of dated snapshots: slope of presence a day by least
    squares, residual deviation, trend, alert, growth of the enum."""
    keys = ["cluster_id", "path"]
    day = F.datediff("snapshot_date", F.min("snapshot_date").over(Window.partitionBy(*keys))).cast("double")
    s = snapshots.withColumn("x", day)
    g = s.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by("presence", "snapshot_date").alias("first_presence"),
        F.max_by("presence", "snapshot_date").alias("last_presence"),
        F.regr_sxx("presence", "x").alias("sxx"),
        F.regr_syy("presence", "x").alias("syy"),
        F.regr_sxy("presence", "x").alias("sxy"),
        F.max("x").alias("days"),
    )
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    g = g.withColumn("slope", slope).withColumn("sigma", F.sqrt(F.greatest(F.lit(0.0), (F.col("syy") - slope * slope * F.col("sxx")) / F.col("n"))))
    trend = (
        F.when(F.col("n") < MIN_SNAPSHOTS, "insufficient_data").when(F.col("sigma") > SIGMA, "volatile").when(F.col("slope") > SLOPE, "rising").when(F.col("slope") < -SLOPE, "declining").otherwise("stable")
    )
    g = g.withColumn("trend", trend).join(enum_growth(snapshots), keys, "left")
    last = F.col("last_presence")
    alert = (
        F.when((F.col("trend") == "declining") & (last < 0.40), "removal_risk")
        .when((F.col("trend") == "declining") & (F.col("slope") < -0.01), "fast_decline")
        .when((F.col("trend") == "volatile") & (last < 0.35), "unstable")
        .when(F.col("enum_growth") > ENUM_PER_MONTH, "enum_growth")
    )
    return g.withColumn("alert", alert).select(*keys, "n", "first_presence", "last_presence", F.round("slope", 6).alias("slope"), F.round("sigma", 6).alias("sigma"), "trend", "enum_growth", "alert")


def enum_growth(snapshots: DataFrame) -> DataFrame:
    """New distinct values after the first snapshot, in 30 days; fields that never
    listed values have no row."""
    keys = ["cluster_id", "path"]
    listed = snapshots.filter(F.size("enum") > 0)
    span = listed.groupBy(*keys).agg(F.min("snapshot_date").alias("d0"), F.datediff(F.max("snapshot_date"), F.min("snapshot_date")).alias("days"))
    first = listed.select(*keys, "snapshot_date", F.explode("enum").alias("value")).groupBy(*keys, "value").agg(F.min("snapshot_date").alias("d"))
    new = first.join(span, keys).groupBy(*keys).agg(F.count_if(F.col("d") > F.col("d0")).alias("new"), F.first("days").alias("days"))
    return new.select(*keys, F.round(F.col("new") / F.greatest("days", F.lit(1)) * 30, 2).alias("enum_growth"))


def fill_absent(snapshots: DataFrame) -> DataFrame:
    """(cluster_id, path, snapshot_date, presence, enum): with a row of presence 0 where
    a cluster's snapshot lacks a field that another one of the cluster has."""
    dates = snapshots.select("cluster_id", "snapshot_date").distinct()
    every = snapshots.select("cluster_id", "path").distinct().join(dates, "cluster_id")
    got = every.join(snapshots, ["cluster_id", "path", "snapshot_date"], "left")
    return got.select("cluster_id", "path", "snapshot_date", F.coalesce("presence", F.lit(0.0)).alias("presence"), _list("enum").alias("enum"))


def stability(velocities: DataFrame) -> DataFrame:
    good = F.col("alert").isNull() & F.col("trend").isin("stable", "insufficient_data")
    return velocities.agg(F.round(F.avg(F.when(good, 1.0).otherwise(0.0)), 3).alias("stability"))


def type_changes(snapshots: DataFrame) -> DataFrame:
    w = Window.partitionBy("cluster_id", "path").orderBy("snapshot_date")
    s = snapshots.withColumn("was", F.lag("field_type").over(w))
    return s.filter(F.col("was").isNotNull() & (F.col("was") != F.col("field_type"))).select("cluster_id", "path", "snapshot_date", "was", "field_type")


def trend_warnings(rates: DataFrame, line: float = 0.8, last: int = 10) -> DataFrame:
    """Fields of (path, cycle, rate) whose last three changes all fall, by half a
    percent or more on average, and which reach ``line`` within three cycles."""
    w = Window.partitionBy("path").orderBy("cycle")
    newest = Window.partitionBy("path").orderBy(F.desc("cycle"))
    r = rates.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= last).withColumn("delta", F.col("rate") - F.lag("rate").over(w))
    near = w.rowsBetween(-2, 0)
    r = r.withColumn("worst", F.max("delta").over(near)).withColumn("step", F.avg("delta").over(near)).withColumn("k", F.count("delta").over(near)).filter(F.col("age") == 1)
    left = (F.col("rate") - F.lit(line)) / F.abs(F.col("step"))
    return r.filter((F.col("k") == 3) & (F.col("worst") < 0) & (F.abs("step") >= 0.005) & (F.col("rate") > line) & (left <= 3)).select("path", "rate", F.col("step").alias("mean_delta"), left.alias("cycles_left"))


def proposal_confidence(weeks: Column, clarity: Column, sigma: Column) -> Column:
    raw = 0.6 * F.least(weeks / 8.0, F.lit(1.0)) + 0.4 * clarity - F.when(sigma > 0.15, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.0), raw)), 3)


def proposals(velocities: DataFrame, declared: DataFrame, observed_types: DataFrame | None = None) -> DataFrame:
    """(cluster_id, path, action, confidence, automatic) for a declared (path, required, field_type)."""
    v = velocities.filter(F.col("n") >= WEEKS).join(declared, "path", "left")
    cur, base = F.col("last_presence"), F.col("first_presence")
    conf = lambda clarity, cap=0.95: F.least(F.lit(cap), proposal_confidence(F.col("n"), F.least(F.lit(1.0), clarity), F.col("sigma")))
    row = lambda name, hit, c: F.when(hit, F.struct(F.lit(name).alias("action"), c.alias("confidence")))
    rows = [
        row("promote_to_required", ~F.coalesce("required", F.lit(False)) & (cur >= 0.85) & (base >= 0.80), conf(cur)),
        row("demote_to_optional", F.coalesce("required", F.lit(False)) & (cur < 0.65), conf(1 - cur)),
        row("remove_field", (cur < 0.20) & (F.col("trend") == "declining"), conf(1 - cur, 0.80)),
    ]
    if observed_types is not None:
        v = v.join(observed_types.select("path", F.col("field_type").alias("seen_type")), "path", "left")
        rows.append(row("widen_type", types.pair_in(F.col("field_type"), F.col("seen_type"), types.WIDENING), conf(cur, 0.75)))
    out = v.select("cluster_id", "path", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("cluster_id", "path", "x.*")
    return out.withColumn("automatic", (F.col("confidence") >= AUTO) & ~F.col("action").isin("remove_field", "widen_type"))


def apply_proposals(schema: DataFrame, accepted: DataFrame) -> DataFrame:
    j = schema.join(accepted.groupBy("path").agg(F.collect_set("action").alias("acts")), "path", "left").withColumn("acts", _list("acts"))
    has = lambda a: F.array_contains("acts", a)
    return j.filter(~has("remove_field")).withColumn("required", (F.col("required") | has("promote_to_required")) & ~has("demote_to_optional")).drop("acts")


def accept(schema: DataFrame, findings: DataFrame) -> DataFrame:
    """The baseline with accepted findings (path, drift_type, after, new_type, pii) in it."""
    f = findings.groupBy("path").agg(F.collect_set("drift_type").alias("kinds"), F.max("after").alias("after"), F.max("new_type").alias("new_type"), F.max("pii").alias("extra"))
    j = schema.join(f, "path", "full").withColumn("kinds", _list("kinds"))
    has = lambda k: F.array_contains("kinds", k)
    j = j.filter(~has("field_removed"))
    return j.select(
        "path",
        F.when(has("type_changed") | F.col("field_type").isNull(), F.col("new_type")).otherwise(F.col("field_type")).alias("field_type"),
        F.when(has("presence_drop") | has("presence_increase") | F.col("presence").isNull(), F.col("after")).otherwise(F.col("presence")).alias("presence"),
        F.array_sort(F.array_union(_list("pii"), F.when(has("new_pii"), _list("extra")).otherwise(F.array().cast("array<string>")))).alias("pii"),
    )


def write_snapshot(profile: DataFrame, path: str) -> None:
    """One snapshot a stream and date: (stream, snapshot_date, ...) overwritten by partition."""
    profile.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "snapshot_date").parquet(path)


def read_snapshots(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """A stream's snapshots; the partitions of other streams are not read."""
    return spark.read.parquet(path).filter(F.col("stream") == stream)


def snapshot_dates(snapshots: DataFrame) -> DataFrame:
    """(cluster_id, oldest, latest, n): what there is to compare."""
    return snapshots.groupBy("cluster_id").agg(F.min("snapshot_date").alias("oldest"), F.max("snapshot_date").alias("latest"), F.count_distinct("snapshot_date").alias("n"))


def ends(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each cluster's oldest and latest snapshot."""
    dates = snapshot_dates(snapshots)
    at = lambda which: snapshots.join(dates.select("cluster_id", F.col(which).alias("snapshot_date")), ["cluster_id", "snapshot_date"])
    return at("oldest"), at("latest")
