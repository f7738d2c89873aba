"""Field profiles, clusters and discriminators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import stats, types
from driftloom.operators.cells import get_path

# Fields that name an event's type.
TYPE_FIELDS = ("type", "event_type", "schema", "kind", "_type", "record_type", "msg_type")
DISCRIMINATORS = ("type", "event_type", "eventType", "kind", "action", "schema", "_type", "record_type", "msg_type")


def first_n(df: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """The first n rows of each key; the row limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).filter(F.col("__nth") <= n).drop("__nth")


def totals(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("total")) if keys else events.agg(F.count("*").alias("total"))


def presence(cells: DataFrame, events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, path, seen, total, presence): share of events that have the field, null or not."""
    keys = keys or []
    seen = cells.groupBy(*keys, "path").agg(F.count("*").alias("seen"))
    t = totals(events, keys)
    out = seen.join(t, keys) if keys else seen.crossJoin(F.broadcast(t))  # one row
    return out.withColumn("presence", F.col("seen") / F.col("total"))


def field_types(cells: DataFrame, keys: list[str] | None = None, first: int | None = 50, typer=None) -> DataFrame:
    """(keys, path, field_type): one type, mixed, or null, of the first non-null values."""
    keys = keys or []
    typer = typer or types.semantic
    rows = cells.filter(F.col("kind") != "null").withColumn("t", typer(F.col("kind"), F.col("text")))
    rows = first_n(rows, [*keys, "path"], first, ["seq"]) if first else rows
    got = rows.groupBy(*keys, "path").agg(F.collect_set("t").alias("ts"))
    every = cells.select(*keys, "path").distinct()
    return every.join(got, [*keys, "path"], "left").select(*keys, "path", types.of_values(F.coalesce("ts", F.array().cast("array<string>"))).alias("field_type"))


def type_histogram(cells: DataFrame, keys: list[str] | None = None, first: int | None = 200) -> DataFrame:
    """(keys, path, type, n) over the first non-null values."""
    keys = keys or []
    rows = cells.filter(F.col("kind") != "null").withColumn("type", types.semantic(F.col("kind"), F.col("text")))
    rows = first_n(rows, [*keys, "path"], first, ["seq"]) if first else rows
    return rows.groupBy(*keys, "path", "type").agg(F.count("*").alias("n"))


def value_stats(cells: DataFrame, keys: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(keys, path, n, nulls, cardinality, low, high): numeric range of numbers."""
    keys = keys or []
    number = F.when(F.col("kind").isin("integer", "float"), F.col("text").try_cast("double"))
    distinct = F.count_distinct("text") if exact else F.approx_count_distinct("text")
    return cells.groupBy(*keys, "path").agg(
        F.count_if(F.col("kind") != "null").alias("n"), F.count_if(F.col("kind") == "null").alias("nulls"), distinct.alias("cardinality"), F.min(number).alias("low"), F.max(number).alias("high")
    )


def distribution(df: DataFrame, value: str, least: int = 30) -> DataFrame:
    """(value, n, percent, warning) of each value; warning: too few to trust."""
    c = df.groupBy(F.coalesce(F.col(value), F.lit("_null")).alias("value")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())
    return c.withColumn("percent", F.round(F.col("n") * 100.0 / whole, 2)).withColumn("warning", F.col("n") < least)


def value_distribution(cells: DataFrame, most: int = 30) -> DataFrame:
    """(path, value, share) of string fields with at most ``most`` distinct values."""
    c = cells.filter(F.col("kind") == "string").groupBy("path", F.col("text").alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("path")
    c = c.withColumn("kinds", F.count("*").over(w)).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4))
    return c.filter(F.col("kinds") <= most).select("path", "value", "n", "share")


def sample_values(cells: DataFrame, keys: list[str] | None = None, n: int = 5) -> DataFrame:
    """(keys, path, samples): the first n non-null values in order."""
    keys = keys or []
    rows = cells.filter(F.col("kind") != "null")
    w = Window.partitionBy(*keys, "path").orderBy("seq")
    rows = rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
    return rows.groupBy(*keys, "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("samples"))


def distinct_samples(cells: DataFrame, n: int = 8, longest: int = 100) -> DataFrame:
    """(path, value, nth): the first n distinct short values of each field."""
    d = cells.filter((F.col("kind") != "null") & (F.length("text") <= longest)).groupBy("path", F.col("text").alias("value")).agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("path").orderBy("seq", "value")
    return d.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).select("path", "value", "nth")


def enums(cells: DataFrame, most: int = 20) -> DataFrame:
    """(path, enum): values by falling count, of fields whose values are all strings and few."""
    c = cells.filter(F.col("kind") != "null")
    per = c.groupBy("path", F.col("text").alias("value")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") != "string").alias("others"))
    short = per.groupBy("path").agg(F.count("*").alias("k"), F.sum("others").alias("others")).filter((F.col("k") <= most) & (F.col("others") == 0)).select("path")
    got = per.join(short, "path").groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))).alias("x"))
    return got.select("path", F.transform("x", lambda s: s["value"]).alias("enum"))


def top_keys(events: DataFrame, n: int = 15) -> DataFrame:
    keys = events.select(F.explode(F.map_keys(F.col("v").try_cast("map<string,variant>"))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(n)


# -- clusters ------------------------------------------------------------


def visible_keys(v: Column) -> Column:
    return F.array_sort(F.filter(F.map_keys(v.try_cast("map<string,variant>")), lambda k: ~k.startswith("_")))


def cluster_key(v: Column) -> Column:
    """The event family: first non-blank type field, else a fingerprint of the names."""
    named = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(v, f"$.{f}", "string")), F.lit(""))) for f in TYPE_FIELDS if not f.startswith("_")]
    keys = visible_keys(v)
    print_ = F.concat(F.lit("struct:"), F.substring(F.sha2(F.array_join(keys, "|"), 256), 1, 12))
    return F.when(F.size(keys) < 2, "_sparse").otherwise(F.coalesce(*named, print_))


def structure_key(v: Column) -> Column:
    """16 hex digits over names and JSON types of the top level."""
    entries = F.map_entries(v.try_cast("map<string,variant>"))
    names = {"string": "str", "integer": "int", "float": "float", "boolean": "bool", "array": "list", "object": "dict", "null": "NoneType"}
    py = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), F.get(F.filter(F.map_entries(py), lambda m: m["key"] == types.json_kind(e["value"])), F.lit(0))["value"]))
    return F.substring(F.sha2(F.array_join(F.array_sort(pairs), "|"), 256), 1, 16)


def clusters(events: DataFrame, min_fraction: float = 0.01) -> DataFrame:
    """(cluster_id, n): families below the fraction become _other; _sparse stays."""
    c = events.groupBy(cluster_key(F.col("v")).alias("key")).agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy()) * F.lit(min_fraction)))
    c = c.withColumn("cluster_id", F.when((F.col("key") != "_sparse") & (F.col("n") < least), "_other").otherwise(F.col("key")))
    return c.groupBy("cluster_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cluster_id")


def detection_method(clusters_: DataFrame) -> DataFrame:
    real = ~F.col("cluster_id").isin("_other", "_sparse")
    named = real & ~F.col("cluster_id").startswith("struct:")
    return clusters_.agg(F.when(F.count_if(real) <= 1, "single").when(F.count_if(named) > 0, "event_type_field").otherwise("structural_fingerprint").alias("method"))


def routing_field(events: DataFrame, clusters_: DataFrame, first: int = 200) -> DataFrame:
    """The first type field whose value is a cluster id among the first events."""
    few = events.orderBy("seq").limit(first)
    found = few.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.trim(get_path(F.col("v"), f)).alias("value")) for i, f in enumerate(TYPE_FIELDS)))).alias("x")).select("x.*")
    return found.join(clusters_.select(F.col("cluster_id").alias("value")), "value", "left_semi").groupBy("field", "i").count().orderBy("i").limit(1).select("field")


# -- discriminators ----------------------------------------------------------


def discriminator_scores(events: DataFrame, candidates=DISCRIMINATORS, low: int = 2, high: int = 100, coverage: float = 0.8) -> DataFrame:
    """(field, cardinality, coverage, entropy, score, chosen): normalised entropy
    times coverage; the best admissible field is chosen, ties by order."""
    total = events.agg(F.count("*").alias("total"))
    rows = events.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), get_path(F.col("v"), f).alias("value")) for i, f in enumerate(candidates)))).alias("x")).select("x.*").filter(F.col("value").isNotNull())
    e = stats.entropy(rows, ["place", "field"], "value").crossJoin(F.broadcast(total))  # one row
    e = e.withColumn("coverage", F.col("n") / F.col("total"))
    score = F.when(F.col("cardinality") > 1, F.col("entropy") / F.log2("cardinality")).otherwise(F.col("entropy")) * F.col("coverage")
    fits = F.col("cardinality").between(low, high) & (F.col("coverage") >= coverage)
    e = e.withColumn("score", score).withColumn("fits", fits)
    best = F.row_number().over(Window.partitionBy("fits").orderBy(F.desc("score"), "place"))
    return e.withColumn("chosen", F.col("fits") & (best == 1)).select("field", "cardinality", "coverage", "entropy", "score", "chosen")


def type_confidence(counts: DataFrame, n: str = "n", least: int = 30) -> DataFrame:
    """``counts`` with frequency, Wilson bounds, schema confidence and validity."""
    total = F.sum(n).over(Window.partitionBy())
    low, high = stats.wilson(F.col(n), total)
    conf = F.least(F.lit(0.99), 0.5 + 0.1 * F.log10(F.col(n)))
    return counts.withColumn("frequency", F.col(n) / total).withColumn("low", low).withColumn("high", high).withColumn("schema_confidence", conf).withColumn("valid", F.col(n) >= least)


def overall_confidence(conf: DataFrame) -> DataFrame:
    return conf.agg(F.coalesce(F.sum(F.col("frequency") * F.col("schema_confidence")) / F.sum("frequency"), F.lit(0.0)).alias("confidence"))


def coverage_guarantee(sample: int, least: int = 30, level: float = 0.95) -> str:
    """What a sample of this size is sure to have seen."""
    if sample <= 0:
        return "no sample, no guarantee"
    return f"with {level:.0%} confidence every type above {min(1.0, least / sample):.2%} of events has at least {least} samples of {sample}"


def sketch(cells: DataFrame, keys: list[str] | None = None, most: int = 50) -> DataFrame:
    """Mergeable counters a field: events with a value, nulls, type counts, and the
    most frequent short strings.  Null counts as absent here."""
    keys = keys or []
    t = types.sketch(F.col("kind"))
    per = cells.groupBy(*keys, "path", t.alias("type")).agg(F.count("*").alias("n"))
    kinds = per.groupBy(*keys, "path").agg(F.sum(F.when(F.col("type") != "null", F.col("n")).otherwise(0)).alias("present"), F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("nulls"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    short = cells.filter((F.col("kind") == "string") & (F.length("text") < 100)).groupBy(*keys, "path", "text").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "path").orderBy(F.desc("n"), "text")
    top = short.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).groupBy(*keys, "path").agg(F.array_sort(F.collect_list("text")).alias("enum"))
    return kinds.join(top, [*keys, "path"], "left")


def merge_sketches(a: DataFrame, b: DataFrame, most: int = 50) -> DataFrame:
    """Counts add up, so sketches of parts give the sketch of the whole; the listed
    strings are united, the first ``most`` of them by name."""
    cols = ["path", "present", "nulls", "types", "enum"]
    u = a.select(*cols).unionByName(b.select(*cols))
    types_ = u.select("path", F.explode("types").alias("t", "n")).groupBy("path", "t").agg(F.sum("n").alias("n")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("types"))
    listed = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("enum")))), 1, most)
    return u.groupBy("path").agg(F.sum("present").alias("present"), F.sum("nulls").alias("nulls"), listed.alias("enum")).join(types_, "path", "left")


def from_sketch(sketch_: DataFrame, events: int, required: float = 0.8) -> DataFrame:
    """(path, field_type, presence, required, enum): a profile from mergeable counters."""
    kinds = F.array_sort(F.filter(F.map_keys("types"), lambda t: t != "null"))
    kind = F.when(F.size(kinds) == 0, "null").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("mixed")
    rate = F.col("present") / F.lit(float(events))
    return sketch_.select("path", kind.alias("field_type"), rate.alias("presence"), (rate >= required).alias("required"), "enum")
