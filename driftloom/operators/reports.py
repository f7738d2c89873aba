"""Composites: profile of a stream, multi-schema analysis, scrubbing, configuration."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import pii, types
from driftloom.operators import cells as C
from driftloom.operators import profile, sampling


def profile_stream(events: DataFrame, cells: DataFrame, min_fraction: float = 0.01) -> DataFrame:
    """(cluster_id, path, seen, presence, nulls, distinct, type) of every family's fields.

    ``cells`` carry seq; the quick type names the parts of a mixture."""
    known = events.select("seq", profile.cluster_key(F.col("v")).alias("key"))
    sizes = profile.clusters(events, min_fraction).select(F.col("cluster_id").alias("kept"))
    routed = known.join(sizes, F.col("key") == F.col("kept"), "left").select("seq", F.coalesce("kept", F.lit("_other")).alias("cluster_id"))
    c = cells.join(routed, "seq")
    stats_ = profile.value_stats(c, ["cluster_id"])
    t = profile.first_n(c.filter(F.col("kind") != "null"), ["cluster_id", "path"], 50, ["seq"])
    t = t.groupBy("cluster_id", "path").agg(types.of_values_named(F.collect_set(types.quick(F.col("kind"), F.col("text")))).alias("type"))
    p = profile.presence(c, routed, ["cluster_id"])
    out = p.join(stats_, ["cluster_id", "path"]).join(t, ["cluster_id", "path"], "left")
    return out.select("cluster_id", "path", "seen", "presence", "nulls", F.col("cardinality").alias("distinct"), F.coalesce("type", F.lit("null")).alias("type"))


def multi_schema(events: DataFrame, total: int = 1000, least: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(confidence by type, overall confidence) of a stratified sample by the best
    discriminator; without one, by the structure of the events."""
    best = profile.discriminator_scores(events).filter("chosen").select("field").limit(1).collect()
    key = C.get_path(F.col("v"), best[0]["field"]) if best else profile.structure_key(F.col("v"))
    rows = events.withColumn("event_kind", key)
    sample = sampling.stratified(rows, "event_kind", total, least, seed)
    counts = sample.groupBy("event_kind").agg(F.count("*").alias("n"))
    conf = profile.type_confidence(counts)
    population = rows.count()
    size = F.sum("n").over(Window.partitionBy())
    conf = conf.withColumn("population", (F.col("frequency") * F.lit(population)).cast("bigint")).withColumn("sample", size)
    return conf, profile.overall_confidence(conf)


def scrub(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Cells with personal values replaced by stable stand-ins; ``found``: (path, category)."""
    first = found.groupBy("path").agg(F.min("category").alias("category"))
    j = cells.join(first, "path", "left")
    return j.withColumn("text", F.when(F.col("category").isNotNull() & (F.col("kind") == "string"), pii.pseudonym(F.col("category"), F.col("text"))).otherwise(F.col("text"))).drop("category")


def deep_merge(low: dict[str, Any], high: dict[str, Any]) -> dict[str, Any]:
    """Layered settings: the higher layer wins, nulls don't."""
    out = dict(low)
    for k, v in high.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = deep_merge(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def policy(settings: dict[str, Any] | None = None) -> dict[int, str]:
    """Tier to action: log, alert or block."""
    base = {"tier_1": "log", "tier_2": "alert", "tier_3": "block"}
    got = deep_merge(base, settings or {})
    bad = {v for v in got.values()} - {"log", "alert", "block"}
    if bad:
        raise ValueError(f"unknown actions {sorted(bad)}")
    return {int(k[-1]): v for k, v in got.items()}
