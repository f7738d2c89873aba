"""Schema inference without a language model: statistics, votes, hints, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import pii, stats, types
from driftloom.operators import profile
from driftloom.operators.sampling import draw

# Type hints (first match wins) and names that force a category.
HINTS = (
    ("timestamp_epoch_ms", r"^1[3-9]\d{11}$", "timestamp_epoch_ms", 0.99),
    ("timestamp_iso8601", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "timestamp_iso8601", 0.99),
    ("uuid_v4", r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", "uuid", 0.99),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$", "email", 0.97),
    ("ipv4", r"^(\d{1,3}\.){3}\d{1,3}$", "string", 0.97),
)
PII_FLOORS = (("passport", "passport"), ("card_last_four", "card_number"), ("card_number", "card_number"), ("dob", "date_of_birth"))
HINT_SHARE = 0.6
REGISTRY = {"seen": 3, "confidence": 0.8, "days": 90, "boost": 0.05}
VOTES, VOTE_SIZE, VOTE_LEAST = 5, 200, 20


def statistical(cells: DataFrame, events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One field a row: primitive type, presence, required, confidence, samples, pii.

    Confidence is the Wilson lower bound of the majority type's share, capped for
    the catch-all types; 0.3 without any value."""
    keys = keys or []
    on = [*keys, "path"]
    kinds = ("boolean", "integer", "float", "string", "array")
    seen = cells.groupBy(*on).agg(F.count("*").alias("seen"), F.filter(F.array(*(F.struct(F.count_if(types.primitive(F.col("kind")) == t).alias("c"), F.lit(t).alias("t")) for t in kinds)), lambda x: x["c"] > 0).alias("ts"))
    t = profile.totals(events, keys)
    seen = seen.join(t, keys) if keys else seen.crossJoin(F.broadcast(t))  # one row without keys
    w = Window.partitionBy(*on).orderBy("seq")
    first = cells.filter(F.col("kind") != "null").select(*on, "seq", "kind", "text").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= pii.FIRST)
    ordered = lambda hit: F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("nth", "text")))), lambda x: x["text"])
    texts = first.groupBy(*on).agg(ordered(F.col("nth") <= 5).alias("samples"), ordered(F.col("kind") == "string").alias("strings"))
    rows = seen.join(texts, on, "left").withColumn("presence", F.col("seen") / F.col("total"))
    rows = rows.withColumn("k", F.array_max(F.transform("ts", lambda x: x["c"]))).withColumn("n", F.when(F.size("ts") > 0, F.aggregate("ts", F.lit(0).cast("long"), lambda s, x: s + x["c"])))
    kind = F.when(F.size("ts") == 0, "null").when(F.size("ts") > 1, "mixed").otherwise(F.get("ts", F.lit(0))["t"])
    low, _ = stats.wilson(F.col("k"), F.col("n"))
    conf = F.when(F.col("n").isNull(), 0.3).otherwise(F.round(low, 4))
    conf = F.when(kind.isin("string", "integer"), F.least(conf, F.lit(0.7))).when(kind == "mixed", F.least(conf, F.lit(0.5))).otherwise(conf)
    found = pii.categories(pii.detect(F.col("path"), F.coalesce("strings", F.array().cast("array<string>"))))
    return rows.select(*on, kind.alias("field_type"), "presence", (F.col("presence") >= 0.8).alias("required"), conf.alias("confidence"), "samples", found.alias("pii"))


def quorum(cells: DataFrame, events: DataFrame, keys: list[str] | None = None, votes: int = VOTES, size: int = VOTE_SIZE) -> DataFrame:
    """(path, field_type, agreement, votes_seen): the type that most votes see, each
    vote on its own sample; ties by type name."""
    keys = keys or []
    vote = events.select(*keys, "seq", F.explode(F.sequence(F.lit(0), F.lit(votes - 1))).alias("vote"))
    w = Window.partitionBy(*keys, "vote").orderBy(F.md5(F.concat_ws("-", F.col("seq").cast("string"), F.col("vote").cast("string")).cast("binary")), "seq")
    chosen = vote.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size).drop("r")
    seen = cells.join(chosen, [*keys, "seq"]).withColumn("t", types.semantic(F.col("kind"), F.col("text")))
    by_vote = seen.groupBy(*keys, "path", "vote").agg(types.of_values(F.collect_set("t")).alias("t"))
    counts = by_vote.groupBy(*keys, "path", "t").agg(F.count("*").alias("c"))
    best = F.row_number().over(Window.partitionBy(*keys, "path").orderBy(F.desc("c"), "t"))
    counts = counts.withColumn("votes_seen", F.sum("c").over(Window.partitionBy(*keys, "path"))).withColumn("r", best).filter(F.col("r") == 1)
    return counts.select(*keys, "path", F.col("t").alias("field_type"), (F.col("c") / F.col("votes_seen")).alias("agreement"), "votes_seen")


def quorum_override(fields: DataFrame, voted: DataFrame, keys: list[str] | None = None, least: float = 0.6) -> DataFrame:
    """Types that a clear majority of votes sees differently are replaced."""
    on = [*(keys or []), "path"]
    v = voted.select(*on, F.col("field_type").alias("voted"), "agreement")
    take = F.col("voted").isNotNull() & (F.col("voted") != "null") & (F.col("voted") != F.col("field_type")) & (F.col("agreement") >= least)
    out = fields.join(v, on, "left")
    return out.withColumn("overridden", F.coalesce(take, F.lit(False))).withColumn("field_type", F.when(take, F.col("voted")).otherwise(F.col("field_type"))).drop("voted", "agreement")


def hints(cells: DataFrame) -> DataFrame:
    """(path, hint, hinted_type, floor): the first hint that enough values match."""
    values = cells.filter(F.col("kind").isin("string", "integer", "float"))
    shares = values.groupBy("path").agg(*(F.avg(F.col("text").rlike(p).cast("double")).alias(f"s{i}") for i, (_, p, _, _) in enumerate(HINTS)))
    pick = F.coalesce(*(F.when(F.col(f"s{i}") >= HINT_SHARE, F.struct(F.lit(n).alias("hint"), F.lit(t).alias("hinted_type"), F.lit(c).alias("floor"))) for i, (n, _, t, c) in enumerate(HINTS)))
    return shares.select("path", pick.alias("x")).filter(F.col("x").isNotNull()).select("path", "x.*")


def apply_hints(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """Hinted types override, confidences have floors, names force categories."""
    out = fields.join(hints(cells), "path", "left")
    out = out.withColumn("field_type", F.coalesce("hinted_type", "field_type")).withColumn("confidence", F.greatest("confidence", F.coalesce("floor", F.lit(0.0))))
    forced = F.array_compact(F.array(*(F.when(F.contains(F.lower("path"), F.lit(s)), F.lit(c)) for s, c in PII_FLOORS)))
    return out.withColumn("pii", F.array_sort(F.array_union("pii", forced))).drop("hint", "hinted_type", "floor")


def correct_types(fields: DataFrame, observed: DataFrame, least: int = 3) -> DataFrame:
    """Declared types corrected by observed (path, n, observed_type): only between
    timestamp forms, and between integer and float."""
    out = fields.join(observed, "path", "left")
    stamps = F.col("field_type").isin(*types.TIMESTAMPS) & F.col("observed_type").isin(*types.TIMESTAMPS)
    numbers = F.col("field_type").isin("integer", "float") & F.col("observed_type").isin("integer", "float")
    take = (F.col("n") >= least) & (F.col("field_type") != F.col("observed_type")) & (stamps | numbers)
    return out.withColumn("corrected", F.coalesce(take, F.lit(False))).withColumn("field_type", F.when(take, F.col("observed_type")).otherwise(F.col("field_type"))).drop("observed_type", "n")


def fingerprint(fields: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """16 hex digits of a schema: path, type and required of every field."""
    item = F.concat_ws("|", "path", "field_type", F.col("required").cast("string"))
    joined = F.array_join(F.array_sort(F.collect_list(item)), ";")
    g = fields.groupBy(*keys) if keys else fields.groupBy()
    return g.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def cache_probe(prints: DataFrame, cache: DataFrame) -> DataFrame:
    """Fingerprints with the cached schema's fields, if known."""
    return prints.join(cache, "fingerprint", "left").withColumn("hit", F.col("fields").isNotNull())


def registry_lookup(paths: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """``paths`` with the registry's type where seen often, surely and lately enough."""
    good = (F.col("seen") >= REGISTRY["seen"]) & (F.col("confidence") >= REGISTRY["confidence"]) & (F.datediff(now, F.col("last_seen")) <= REGISTRY["days"])
    known = registry.filter(good).select("path", F.col("field_type").alias("known_type"), F.least(F.lit(1.0), F.col("confidence") + REGISTRY["boost"]).alias("known_confidence"))
    return paths.join(known, "path", "left")


def registry_record(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """The registry with (path, field_type, confidence, last_seen, stream) added:
    counts rise, type and confidence are the latest, streams unite."""
    new = seen.groupBy("path").agg(F.max_by("field_type", "last_seen").alias("t"), F.max_by("confidence", "last_seen").alias("c"), F.max("last_seen").alias("l"), F.count("*").alias("k"), F.collect_set("stream").alias("s"))
    j = registry.join(new, "path", "full")
    streams = F.array_sort(F.array_union(F.coalesce("streams", F.array().cast("array<string>")), F.coalesce("s", F.array().cast("array<string>"))))
    return j.select("path", F.coalesce("t", "field_type").alias("field_type"), F.coalesce("c", "confidence").alias("confidence"), (F.coalesce("seen", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("seen"), F.greatest("last_seen", "l").alias("last_seen"), streams.alias("streams"))


def evict_stale(registry: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return registry.filter(F.datediff(now, F.col("last_seen")) <= days)


def align_paths(inferred: DataFrame, known: DataFrame) -> DataFrame:
    """Inferred paths repaired to known ones: equal, or the only one that they end."""
    a, b = inferred.select(F.col("path").alias("inferred")).distinct(), known.select(F.col("path").alias("aligned")).distinct()
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    # Joined on the last segment, which both share whenever one ends the other.
    j = a.withColumn("tail", last("inferred")).join(b.withColumn("tail", last("aligned")), "tail", "left")
    ends = (F.col("inferred") == F.col("aligned")) | F.endswith(F.col("aligned"), F.concat(F.lit("."), "inferred")) | F.endswith(F.col("inferred"), F.concat(F.lit("."), "aligned"))
    j = j.filter(F.coalesce(ends, F.lit(False))).withColumn("same", F.col("inferred") == F.col("aligned"))
    w = Window.partitionBy("inferred")
    j = j.withColumn("has", F.max("same").over(w)).filter(F.col("same") | ~F.col("has")).withColumn("k", F.count("*").over(w)).filter(F.col("k") == 1)
    return a.join(j.select("inferred", "aligned"), "inferred", "left")


def infer(cells: DataFrame, events: DataFrame, keys: list[str] | None = None, use_hints: bool = False) -> DataFrame:
    """The offline schema of each key: statistics, then votes, then hints if asked."""
    fields = quorum_override(statistical(cells, events, keys), quorum(cells, events, keys), keys)
    return apply_hints(fields, cells) if use_hints and not keys else fields


def value_matches(cells: DataFrame, schema: DataFrame) -> DataFrame:
    """(path, n, valid): values that fit their declared type."""
    j = cells.join(schema.select("path", F.col("field_type").alias("wanted")), "path")
    return j.groupBy("path").agg(F.count("*").alias("n"), F.count_if(types.matches(F.col("kind"), F.col("text"), F.col("wanted"))).alias("valid"))
