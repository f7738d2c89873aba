"""Who uses which field: declared and observed consumers, blast radius, graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICALITY = {"high": 3, "medium": 2, "low": 1}


def uses(consumers: DataFrame) -> DataFrame:
    """One row a (stream, consumer, field) of consumers with fields_used."""
    return consumers.select("stream", F.col("name").alias("consumer"), "team", "criticality", F.explode("fields_used").alias("f")).select("stream", "consumer", "team", "criticality", F.col("f.path").alias("path"), F.col("f.required").alias("required"))


def blast_radius(drifts: DataFrame, used: DataFrame) -> DataFrame:
    """(consumer, highest_tier, fields, hard_breaks, score): who a stream's drifts
    (path, tier) hit; a field with several drifts counts with its worst."""
    worst = drifts.groupBy("path").agg(F.max("tier").alias("tier"))
    j = used.join(worst, "path")
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in CRITICALITY.items() for x in kv))[F.lower("criticality")], F.lit(1))
    hard = F.count_if(F.col("required") & (F.col("tier") == 3))
    g = j.groupBy("consumer", "criticality").agg(F.max("tier").alias("highest_tier"), F.count("*").alias("fields"), hard.alias("hard_breaks"))
    return g.withColumn("score", weight * F.col("highest_tier")).select("consumer", "criticality", "highest_tier", "fields", "hard_breaks", "score").orderBy(F.desc("score"), "consumer")


def unaffected(drifts: DataFrame, used: DataFrame) -> DataFrame:
    hit = used.join(drifts.select("path").distinct(), "path", "left_semi").select("consumer").distinct()
    return used.select("consumer").distinct().join(hit, "consumer", "left_anti")


def field_blast_radius(used: DataFrame, path: str, stream: str | None = None) -> DataFrame:
    rows = used.filter(F.col("path") == path)
    return (rows.filter(F.col("stream") == stream) if stream else rows).select("stream", "consumer", "criticality", "required").orderBy(F.desc("required"), "stream", "consumer")


def field_graph(fields: DataFrame) -> DataFrame:
    """(path, streams, n_streams, types, inconsistent) of (stream, path, field_type)."""
    g = fields.groupBy("path").agg(F.array_sort(F.collect_set("stream")).alias("streams"), F.array_sort(F.collect_set("field_type")).alias("types"))
    return g.select("path", "streams", F.size("streams").alias("n_streams"), "types", (F.size("types") > 1).alias("inconsistent"))


def inconsistencies(fields: DataFrame) -> DataFrame:
    return field_graph(fields).filter("inconsistent").orderBy(F.desc("n_streams"), "path")


def shared_fields(fields: DataFrame, a: str, b: str) -> DataFrame:
    pick = lambda s: fields.filter(F.col("stream") == s).select("path")
    return pick(a).intersect(pick(b))


def graph_blast_radius(fields: DataFrame, used: DataFrame, stream: str, path: str) -> DataFrame:
    """Other streams with the field, whether their type differs, and their consumers."""
    own = fields.filter((F.col("stream") == stream) & (F.col("path") == path)).select("path", F.col("field_type").alias("own_type"))
    others = fields.filter(F.col("stream") != stream).join(own, "path")
    who = used.groupBy("stream", "path").agg(F.array_sort(F.collect_set("consumer")).alias("consumers"))
    return others.join(who, ["stream", "path"], "left").select("stream", "path", "field_type", (F.col("field_type") != F.col("own_type")).alias("differs"), F.coalesce("consumers", F.array().cast("array<string>")).alias("consumers"))


def enrich(findings: DataFrame, fields: DataFrame, used: DataFrame, stream: str) -> DataFrame:
    """Findings with the other streams and the consumers of their field."""
    s = fields.filter(F.col("stream") != stream).groupBy("path").agg(F.array_sort(F.collect_set("stream")).alias("other_streams"))
    c = used.groupBy("path").agg(F.array_sort(F.collect_set("consumer")).alias("consumers"))
    return findings.join(s, "path", "left").join(c, "path", "left")


def registry_streams(registry: DataFrame, fields: DataFrame) -> DataFrame:
    """The registry's (path, streams) with each stream's declared type, if any."""
    r = registry.select("path", F.explode("streams").alias("stream"))
    return r.join(fields.select("stream", "path", "field_type"), ["stream", "path"], "left")


def declared_and_observed(used: DataFrame, access: DataFrame) -> DataFrame:
    """Each (stream, path, consumer) with whether it is declared, and seen how often."""
    d = used.select("stream", "path", "consumer", F.lit(True).alias("declared")).distinct()
    o = access.select("stream", F.col("field").alias("path"), "consumer", "count", "last_seen")
    return d.join(o, ["stream", "path", "consumer"], "full").withColumn("declared", F.coalesce("declared", F.lit(False))).withColumn("count", F.coalesce("count", F.lit(0)))


def access_edges(touched: DataFrame) -> DataFrame:
    """(stream, consumer, field, count, last_seen) from single accesses."""
    return touched.groupBy("stream", "consumer", "field").agg(F.count("*").alias("count"), F.max("seen").alias("last_seen"))


def consumers_of(access: DataFrame, field: str) -> DataFrame:
    return access.filter(F.col("field") == field).groupBy("consumer").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen")).orderBy(F.desc("count"), "consumer")


def access_stats(access: DataFrame) -> DataFrame:
    return access.agg(F.count_distinct("stream").alias("streams"), F.count_distinct("consumer").alias("consumers"), F.count_distinct("field").alias("fields"), F.coalesce(F.sum("count"), F.lit(0)).alias("accesses"))


class _Watched(dict):
    """A dict that notes the paths read from it, missing ones too; membership tests don't count."""

    def __init__(self, data: dict, note: set, prefix: str = "") -> None:
        super().__init__(data)
        self._note, self._prefix = note, prefix

    def _see(self, key: str, value: object) -> object:
        path = f"{self._prefix}{key}"
        self._note.add(path)
        if isinstance(value, dict):
            return _Watched(value, self._note, path + ".")
        if isinstance(value, list):
            return [_Watched(x, self._note, path + "[].") if isinstance(x, dict) else x for x in value]
        return value

    def __getitem__(self, key):
        self._note.add(f"{self._prefix}{key}")
        return self._see(key, super().__getitem__(key))

    def get(self, key, default=None):
        return self._see(key, super().get(key, default))


def observe(events: DataFrame, stream: str, consumer: str, fn: Callable[[dict], object], raw: str = "raw", seq: str = "seq") -> DataFrame:
    """Run a consumer's function over the events and record what it reads:
    (stream, consumer, field, seen).  The function is Python, so this maps batches."""
    import json

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text, n in zip(part[raw], part[seq], strict=True):
                try:
                    event = json.loads(text)
                except (TypeError, ValueError):
                    continue
                if isinstance(event, dict):
                    note: set[str] = set()
                    try:
                        fn(_Watched(event, note))
                    except Exception:  # noqa: BLE001 a consumer's failure is its own
                        pass
                    rows += [(stream, consumer, p, n) for p in note]
            yield pd.DataFrame(rows, columns=["stream", "consumer", "field", "seen"])

    return events.select(raw, seq).mapInPandas(run, "stream string, consumer string, field string, seen long")


def search_fields(fields: DataFrame, text: str = "", field_type: str | None = None, pii_only: bool = False) -> DataFrame:
    out = fields.filter(F.contains(F.lower("path"), F.lit(text.lower())))
    out = out.filter(F.col("field_type") == field_type) if field_type else out
    return out.filter(F.size("pii") > 0) if pii_only else out


def pii_summary(fields: DataFrame) -> DataFrame:
    return fields.select("stream", "path", F.explode("pii").alias("category")).groupBy("category").agg(F.count("*").alias("fields"), F.count_distinct("stream").alias("streams"))


def latest_reports(reports: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("stream").orderBy(F.desc("at"))
    return reports.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).drop("nth")


def metrics_summary(fields: DataFrame, incidents: DataFrame) -> DataFrame:
    f = fields.agg(F.count_distinct("stream").alias("streams"), F.count("*").alias("fields"), F.count_if(F.size("pii") > 0).alias("pii_fields"))
    i = incidents.agg(F.count_if(F.col("status") == "open").alias("open_incidents"), F.count_if((F.col("status") == "open") & (F.col("tier") == 3)).alias("open_breaking"))
    return f.crossJoin(i)  # one row each


def discover(topics: DataFrame, schemas: DataFrame, incidents: DataFrame, pattern: str = "*") -> DataFrame:
    """(topic, known, version, open_incidents) of topics that a glob matches and whose
    names don't start with an underscore, with the schema (stream, version) of each."""
    like = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in pattern)
    own = topics.filter(~F.col("topic").startswith("_") & F.col("topic").rlike(f"^{like}$"))
    open_ = incidents.filter(F.col("status") == "open").groupBy(F.col("stream").alias("topic")).agg(F.count("*").alias("open_incidents"))
    j = own.join(schemas.select(F.col("stream").alias("topic"), "version"), "topic", "left").join(open_, "topic", "left")
    return j.select("topic", F.col("version").isNotNull().alias("known"), "version", F.coalesce("open_incidents", F.lit(0)).alias("open_incidents"))


def recommendation(criticality: Column, required: Column, tier: Column) -> Column:
    """What a consumer of a drifted field should do."""
    return (
        F.when((tier == 3) & required, "stop the release until the consumer is changed")
        .when(tier == 3, "tell the consumer's team before the release")
        .when((tier == 2) & (F.lower(criticality) == "high"), "test the consumer against the new shape")
        .when(tier == 2, "tell the consumer's team")
        .otherwise("nothing to do")
    )
