"""Drift: a baseline schema against observed events, as one relation of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import pii, stats, types
from driftloom.operators import profile

# Thresholds.
ALPHA, FDR = 0.01, 0.01
TEST_LEAST = 30
SMALL_PRESENCE, SMALL_TYPE, ENUM_RATE = 0.15, 0.05, 0.05
NEW_FIELD, REMOVED_BELOW, REMOVED_FROM = 0.05, 0.05, 0.2
FIRST_TYPES, FIRST_HISTOGRAM, CHI2_LEAST = 50, 200, 5
REGRESSION = {"base": 0.10, "events": 30, "drop": 0.20}
NEW_CLUSTER = 0.05
POLICY = {1: "log", 2: "alert", 3: "block"}


def tier(kind: Column, before: Column, after: Column, old: Column, new: Column) -> Column:
    """1 (harmless) to 3 (breaking)."""
    gone = (before >= 0.8) & (after < 0.2)
    stamps = old.isin(*types.TIMESTAMPS) & new.isin(*types.TIMESTAMPS)
    return (
        F.when(kind == "field_added", F.when(F.coalesce(after, F.lit(0.0)) < 0.5, 1).otherwise(2))
        .when(kind == "field_removed", F.when(gone | (before - after > 0.5), 3).otherwise(2))
        .when(kind == "presence_drop", F.when(gone, 3).otherwise(2))
        .when(kind == "presence_increase", 1)
        .when(kind == "type_changed", F.when(stamps | types.pair_in(old, new, types.WIDENING), 2).otherwise(3))
        .when(kind == "enum_changed", 2)
        .when(kind == "new_pii", 3)
        .otherwise(2)
    )


def drift_class(kind: Column, after: Column, old: Column, new: Column, old_enum: Column, new_enum: Column, confidence: Column | None = None, new_cluster_evolves: bool = False) -> Column:
    """drift, evolution or noise."""
    stamps = old.isin(*types.TIMESTAMPS) & new.isin(*types.TIMESTAMPS)
    lost = F.size(F.array_except(F.coalesce(old_enum, F.array().cast("array<string>")), F.coalesce(new_enum, F.array().cast("array<string>")))) > 0
    rules = (
        F.when(kind == "new_cluster", "evolution" if new_cluster_evolves else "drift")
        .when(kind == "field_added", F.when(F.coalesce(after, F.lit(0.0)) < 0.5, "evolution").otherwise("drift"))
        .when(kind == "type_changed", F.when(stamps | types.pair_in(old, new, types.WIDENING), "evolution").otherwise("drift"))
        .when(kind == "enum_changed", F.when(lost, "drift").otherwise("evolution"))
        .when(kind == "presence_increase", "evolution")
        .otherwise("drift")
    )
    return rules if confidence is None else F.when(confidence < 0.5, "noise").otherwise(rules)


def policy_action(tier_: Column, policy: dict[int, str] | None = None) -> Column:
    p = policy or POLICY
    return F.create_map(*(F.lit(x) for kv in p.items() for x in kv))[tier_]


def observe(cells: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """What the tests need of each observed field, in one row: its presence, and the
    types and strings of its first values, at most ``FIRST_HISTOGRAM`` a field."""
    on = [*keys, "path"]
    values = cells.filter(F.col("kind") != "null").select(*on, "seq", "kind", "text")
    w = Window.partitionBy(*on).orderBy("seq")
    first = values.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= FIRST_HISTOGRAM)
    first = first.withColumn("t", types.semantic(F.col("kind"), F.col("text")))
    got = first.groupBy(*on).agg(
        types.of_values(F.collect_set(F.when(F.col("nth") <= FIRST_TYPES, F.col("t")))).alias("new_type"),
        F.collect_list("t").alias("ts"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("nth") <= pii.FIRST) & (F.col("kind") == "string"), F.struct("nth", "text")))), lambda x: x["text"]).alias("strings"),
    )
    hist = F.map_from_entries(F.transform(F.array_distinct("ts"), lambda t: F.struct(t, F.size(F.filter("ts", lambda x: x == t)).cast("long"))))
    out = profile.presence(cells, events, keys).join(got, on, "left")
    found = pii.categories(pii.detect(F.col("path"), F.coalesce("strings", F.array().cast("array<string>"))))
    return out.withColumn("histogram", hist).withColumn("new_type", F.coalesce("new_type", F.lit("null"))).withColumn("new_pii", found).drop("strings", "ts")


def enum_novelty(cells: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, novel_rate, new_enum) of fields whose baseline lists its values."""
    on = [*keys, "path"]
    known = baseline.filter(F.size("enum") > 0).select(*on, "enum")
    v = cells.filter(F.col("kind") != "null").join(known, on).groupBy(*on, "text").agg(F.count("*").alias("c"), F.first("enum").alias("enum"))
    novel = F.sum(F.when(~F.array_contains("enum", F.col("text")), F.col("c")).otherwise(0))
    rate = v.groupBy(*on).agg((novel / F.sum("c")).alias("novel_rate"))
    few = profile.first_n(v.select(*on, "text"), on, 50, ["text"]).groupBy(*on).agg(F.array_sort(F.collect_list("text")).alias("new_enum"))
    return rate.join(few, on, "left")


def detect(baseline: DataFrame, cells: DataFrame, events: DataFrame, keys: list[str] | None = None, family: str = "tested", alpha: float = ALPHA, q: float = FDR) -> DataFrame:
    """Findings (keys, path, drift_type, before, after, old_type, new_type, p, p_adjusted, tier, class).

    ``baseline``: (keys, path, field_type, presence, enum, pii), and confidence if
    findings on fields of low confidence are to be noise.  ``family="tested"``
    controls false discoveries over all tests; ``"candidates"`` only over those that
    were significant alone.  The baseline is small and may be broadcast by its size."""
    keys = keys or []
    on = [*keys, "path"]
    base = baseline.select(*on, F.col("field_type").alias("old_type"), F.col("presence").alias("before"), F.coalesce("enum", F.array().cast("array<string>")).alias("enum"), F.coalesce("pii", F.array().cast("array<string>")).alias("old_pii"), F.lit(True).alias("known"), *([F.col("confidence")] if "confidence" in baseline.columns else []))
    seen = observe(cells, events, keys)
    j = base.join(seen, on, "full").join(enum_novelty(cells, base, keys), on, "left")
    j = j.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("old_pii", "new_pii", "enum")})
    t = profile.totals(events, keys)
    j = j.drop("total").join(t, keys, "left") if keys else j.drop("total").crossJoin(F.broadcast(t))  # one row without keys
    j = j.withColumns({"total": F.coalesce("total", F.lit(0)), "after": F.coalesce("presence", F.lit(0.0)), "k": F.coalesce("seen", F.lit(0))})
    z = stats.binomial_z(F.col("before"), F.col("k"), F.col("total"), alpha)
    large = F.col("total") >= TEST_LEAST
    off = F.aggregate(F.map_values(F.map_filter("histogram", lambda t, _: t != F.col("old_type"))), F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.aggregate(F.map_values("histogram"), F.lit(0).cast("long"), lambda s, x: s + x)
    # A baseline of one type: its cell expects n, all others share one of 0.5.
    m = j.withColumns({"z": F.when(F.col("known"), z), "n": F.coalesce(n, F.lit(0)), "off": F.coalesce(off, F.lit(0))})
    chi = (F.col("off") ** 2) / F.col("n") + (F.col("off") - 0.5) ** 2 / 0.5
    type_p = F.when((F.col("n") >= CHI2_LEAST) & (F.col("off") > 0), stats.chi2_survival(chi, F.lit(1))).when(F.col("n") >= CHI2_LEAST, 1.0)
    m = m.withColumn("type_p", type_p)
    removed = F.col("known") & (F.col("after") < REMOVED_BELOW) & (F.col("before") >= REMOVED_FROM)
    small = F.abs(F.col("after") - F.col("before")) > F.when(F.col("before") < 0.8, 2 * SMALL_PRESENCE).otherwise(SMALL_PRESENCE)
    moved = F.when(large, F.col("z.p") < alpha).otherwise(small)
    changed = (F.col("new_type") != F.col("old_type")) & (F.col("new_type") != "null") & (F.col("old_type") != "null") & ~types.pair_in(F.col("old_type"), F.col("new_type"), types.REFINEMENTS)
    share = F.col("off") / F.col("n")
    type_hit = changed & F.when(F.col("n") >= CHI2_LEAST, F.col("type_p") < alpha).otherwise(share > SMALL_TYPE)
    extra = F.array_except("new_pii", "old_pii")
    none = F.lit(None).cast("double")
    one = lambda name, hit, p: F.when(hit, F.struct(F.lit(name).alias("drift_type"), p.alias("p")))
    stays = F.col("known") & ~removed
    fresh = F.col("known").isNull() & (F.col("after") >= NEW_FIELD)
    direction = F.when(F.col("after") < F.col("before"), "presence_drop").otherwise("presence_increase")
    findings = F.array_compact(
        F.array(
            one("field_removed", removed, F.when(large, F.col("z.p")).otherwise(none)),
            F.when(stays & moved, F.struct(direction.alias("drift_type"), F.when(large, F.col("z.p")).otherwise(none).alias("p"))),
            one("type_changed", stays & type_hit, F.col("type_p")),
            one("enum_changed", stays & (F.col("novel_rate") >= ENUM_RATE), none),
            one("new_pii", (stays | fresh) & (F.size(extra) > 0), none),
            one("field_added", fresh & (F.size("new_pii") == 0), none),
        )
    )
    rows = m.withColumn("tests", F.when(stays & large & ~moved, 1).otherwise(0) + F.when(stays & changed & (F.col("n") >= CHI2_LEAST) & ~type_hit, 1).otherwise(0))
    quiet = rows.groupBy(*keys).agg(F.sum("tests").alias("quiet")) if keys else rows.agg(F.sum("tests").alias("quiet"))
    sure = ["confidence"] if "confidence" in base.columns else []
    found = rows.select(*on, *sure, "before", "after", "old_type", "new_type", F.col("enum").alias("old_enum"), "new_enum", extra.alias("pii"), F.explode(findings).alias("x")).select("*", "x.drift_type", "x.p").drop("x")
    found = found.join(quiet, keys, "left") if keys else found.crossJoin(F.broadcast(quiet))  # one row
    by = Window.partitionBy(*keys, F.col("p").isNotNull())
    rank = F.row_number().over(by.orderBy("p", "path", "drift_type"))
    ranked = found.withColumn("__rank", rank).withColumn("__m", F.count("*").over(by) + (F.col("quiet") if family == "tested" else F.lit(0)))
    low = F.min(F.col("p") * F.col("__m") / F.col("__rank")).over(by.orderBy("p", "path", "drift_type").rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("p_adjusted", F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), low)))
    kept = ranked.filter(F.col("p").isNull() | (F.col("p_adjusted") < q))
    k = F.col("drift_type")
    level = tier(k, F.col("before"), F.col("after"), F.col("old_type"), F.col("new_type"))
    kind = drift_class(k, F.col("after"), F.col("old_type"), F.col("new_type"), F.col("old_enum"), F.col("new_enum"), F.col("confidence") if sure else None)
    return kept.select(*on, "drift_type", "before", "after", "old_type", "new_type", "p", "p_adjusted", level.alias("tier"), kind.alias("class"), "pii")


def report(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals by key: findings, highest tier, action, count by class."""
    g = findings.groupBy(*(keys or []))
    return g.agg(F.count("*").alias("findings"), F.max("tier").alias("highest_tier"), F.count_if(F.col("class") == "drift").alias("drifts"), F.count_if(F.col("class") == "evolution").alias("evolutions")).withColumn("action", policy_action(F.col("highest_tier")))


def baseline_of(cells: DataFrame, events: DataFrame, keys: list[str] | None = None, enums: bool = False, most: int = 15) -> DataFrame:
    """A baseline from clean events: types, presence, pii, and short enums if asked."""
    keys = keys or []
    on = [*keys, "path"]
    seen = observe(cells, events, keys).select(*on, F.col("new_type").alias("field_type"), "presence", F.col("new_pii").alias("pii"))
    if not enums:
        return seen.withColumn("enum", F.array().cast("array<string>"))
    v = cells.filter(F.col("kind") == "string").groupBy(*on).agg(F.count_distinct("text").alias("kinds"))
    few = cells.filter(F.col("kind") == "string").join(v.filter(F.col("kinds") <= most), on).groupBy(*on).agg(F.array_sort(F.collect_set("text")).alias("enum"))
    return seen.join(few, on, "left").withColumn("enum", F.coalesce("enum", F.array().cast("array<string>")))


def route(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """``events`` with cluster_id; families that the baseline lacks give _unknown."""
    known = clusters.select(F.col("cluster_id").alias("__known"))
    key = profile.cluster_key(F.col("v"))
    j = events.withColumn("__key", key).join(known, F.col("__key") == F.col("__known"), "left")
    return j.withColumn("cluster_id", F.coalesce("__known", F.lit("_unknown"))).drop("__known")


def cluster_drift(baseline: DataFrame, routed: DataFrame, alpha: float = ALPHA, new_cluster: float = NEW_CLUSTER) -> DataFrame:
    """(cluster_id, drift_type, before, after, p) of families that shrank or are new.

    ``baseline``: (cluster_id, share)."""
    n = routed.agg(F.count("*").alias("total"))
    seen = routed.groupBy("cluster_id").agg(F.count("*").alias("k"))
    j = baseline.join(seen, "cluster_id", "full").crossJoin(F.broadcast(n))  # one row
    k = F.coalesce("k", F.lit(0))
    after = k / F.col("total")
    z = stats.binomial_z(F.col("share"), k, F.col("total"), alpha)
    drop = (F.col("share") - after) / F.col("share")
    tested = (F.col("share") >= REGRESSION["base"]) & (F.col("total") >= REGRESSION["events"])
    lost = tested & ((k == 0) | ((drop >= REGRESSION["drop"]) & z["significant"]))
    fresh = (F.col("cluster_id") == "_unknown") & (after >= new_cluster)
    kind = F.when(lost, "cluster_routing_regression").when(fresh, "new_cluster")
    return j.select("cluster_id", kind.alias("drift_type"), F.col("share").alias("before"), after.alias("after"), F.when(lost, z["p"]).alias("p"), F.lit(2).alias("tier")).filter(F.col("drift_type").isNotNull())


def validate(cells: DataFrame, events: DataFrame, schema: DataFrame, strict: bool = False) -> DataFrame:
    """(seq, path, problem): required fields missing, unknown fields (strict), values
    off their enum, values off their type."""
    required = schema.filter("required").select("path")
    seen = cells.select("seq", "path", "kind", "text")
    have = seen.select("seq", "path").join(required, "path").groupBy("seq").agg(F.collect_set("path").alias("have"))
    wanted = required.agg(F.array_sort(F.collect_set("path")).alias("wanted"))
    # One row of wanted names; an event is one row until something is missing.
    each = events.select("seq").join(have, "seq", "left").crossJoin(F.broadcast(wanted))
    missing = each.select("seq", F.explode(F.array_except("wanted", F.coalesce("have", F.array().cast("array<string>")))).alias("path")).withColumn("problem", F.lit("missing"))
    j = seen.join(schema.select("path", "field_type", "enum"), "path")
    off = j.filter((F.size("enum") > 0) & (F.col("kind") != "null") & ~F.array_contains("enum", F.col("text"))).select("seq", "path", F.lit("not_in_enum").alias("problem"))
    wrong = j.filter(~types.matches(F.col("kind"), F.col("text"), F.col("field_type"))).select("seq", "path", F.lit("wrong_type").alias("problem"))
    out = missing.unionByName(off).unionByName(wrong)
    if strict:
        out = out.unionByName(seen.join(schema.select("path"), "path", "left_anti").select("seq", "path", F.lit("unknown").alias("problem")))
    return out


def destinations(findings: DataFrame) -> DataFrame:
    """Findings with where their class goes: incidents, proposals or the log."""
    to = F.when(F.col("class") == "drift", "incident").when(F.col("class") == "evolution", "proposal").otherwise("log")
    return findings.withColumn("destination", to)
