"""Incidents: findings that live from poll to poll."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

PRUNE_DAYS, MOST = 7, 1000
HOURS = {3: 4.0, 2: 1.0}


def merge(state: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """The incidents after one poll.  ``state``: (cluster_id, path, drift_type, tier,
    status, first_detected, last_seen, occurrences); findings share the first four.

    An open incident seen again is bumped, one not seen is resolved, a new signature
    opens; accepted and suppressed ones stay what they are."""
    cur = findings.groupBy(F.col("cluster_id").alias("c"), F.col("path").alias("p"), F.col("drift_type").alias("d")).agg(F.max("tier").alias("t"))
    same = F.col("cluster_id").eqNullSafe(F.col("c")) & (F.col("path") == F.col("p")) & (F.col("drift_type") == F.col("d"))
    # A resolved incident makes room for a new one of its signature.
    live, old = state.filter(F.col("status") != "resolved"), state.filter(F.col("status") == "resolved")
    j = live.join(cur, same, "full")
    seen, known, open_ = F.col("d").isNotNull(), F.col("status").isNotNull(), F.col("status") == "open"
    out = j.select(
        F.when(known, F.col("cluster_id")).otherwise(F.col("c")).alias("cluster_id"),
        F.coalesce("path", "p").alias("path"),
        F.coalesce("drift_type", "d").alias("drift_type"),
        F.coalesce("tier", "t").alias("tier"),
        F.when(~known, "open").when(open_ & ~seen, "resolved").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_detected", now).alias("first_detected"),
        F.when(~known | (open_ & seen), now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(~known, 1).when(open_ & seen, F.col("occurrences") + 1).otherwise(F.col("occurrences")).cast("long").alias("occurrences"),
    )
    return out.unionByName(old.select(*out.columns))


def prune(state: DataFrame, now: Column, days: int = PRUNE_DAYS, most: int = MOST) -> DataFrame:
    """Resolved and accepted incidents go after a week; the newest ``most`` stay."""
    keep = F.col("status").isin("open", "suppressed") | (F.datediff(now, F.col("last_seen")) <= days)
    return state.filter(keep).orderBy(F.desc("last_seen"), "path", "drift_type").limit(most)


def suppress(state: DataFrame, path: str, drift_type: str | None = None) -> DataFrame:
    hit = (F.col("path") == path) & (F.lit(True) if drift_type is None else F.col("drift_type") == drift_type) & (F.col("status") == "open")
    return state.withColumn("status", F.when(hit, "suppressed").otherwise(F.col("status")))


def status(state: DataFrame) -> DataFrame:
    return state.groupBy("status", "tier").agg(F.count("*").alias("n"), F.sum("occurrences").alias("occurrences"))


def roi(state: DataFrame, since: Column) -> DataFrame:
    """Counts by tier, hours saved, and mean hours to resolve, of incidents since a time."""
    s = state.filter(F.col("first_detected") >= since)
    hours = (F.unix_timestamp("last_seen") - F.unix_timestamp("first_detected")) / 3600.0
    saved = sum((F.count_if(F.col("tier") == t) * h for t, h in HOURS.items()), F.lit(0.0))
    return s.agg(
        F.count("*").alias("incidents"),
        *(F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        saved.alias("hours_saved"),
        F.coalesce(F.avg(F.when(F.col("status") == "resolved", hours)), F.lit(0.0)).alias("mttr_hours"),
    )


def lifecycle(findings: DataFrame) -> DataFrame:
    """The same fold in one batch: intervals of consecutive polls in which a
    signature (cluster_id, path, drift_type) was found, of (poll, ...)."""
    keys = ["cluster_id", "path", "drift_type"]
    f = findings.groupBy(*keys, "poll").agg(F.max("tier").alias("tier"))
    w = Window.partitionBy(*keys).orderBy("poll")
    f = f.withColumn("island", F.col("poll") - F.row_number().over(w))
    return f.groupBy(*keys, "island").agg(F.min("poll").alias("first_poll"), F.max("poll").alias("last_poll"), F.count("*").alias("occurrences"), F.max("tier").alias("tier")).drop("island")
