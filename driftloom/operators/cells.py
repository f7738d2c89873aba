"""Cells: one row a (event, field path, value); the form all operators read.

Events are flattened by expressions over a row alone (no join, no shuffle, no
Python): a VARIANT object becomes an array of entries that is widened level by
level, and one explode at the end makes the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.types import json_kind

DEPTH, KEYS, VALUE = 10, 1000, 100_000


def parse_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with ``v``, the parsed object; rows that hold none are dropped."""
    return df.withColumn("v", F.try_parse_json(raw)).filter(F.schema_of_variant("v").startswith("OBJECT"))


def _entries(v: Column, prefix: Column | None) -> Column:
    name = lambda e: F.replace(e["key"], F.lit("\0"), F.lit(""))
    return F.transform(
        F.map_entries(v.try_cast("map<string,variant>")),
        lambda e: F.struct((name(e) if prefix is None else F.concat(prefix, name(e))).alias("path"), e["value"].alias("value"), F.lit(False).alias("done")),
    )


def _widen(entries: Column, arrays: bool) -> Column:
    def one(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        head = F.try_variant_get(e["value"], "$[0]", "variant")
        same = F.array(F.struct(e["path"].alias("path"), e["value"].alias("value"), F.lit(True).alias("done")))
        inner = F.when(~e["done"] & kind.startswith("OBJECT"), _entries(e["value"], F.concat(e["path"], F.lit("."))))
        if arrays:
            inner = inner.when(~e["done"] & kind.startswith("ARRAY") & F.schema_of_variant(head).startswith("OBJECT"), F.concat(same, _entries(head, F.concat(e["path"], F.lit("[].")))))
        return inner.otherwise(same)

    return F.flatten(F.transform(entries, one))


def depth_needed(events: DataFrame, raw: str = "raw", most: int = DEPTH) -> int:
    """No event nests deeper than it has braces: one cheap scan saves levels."""
    got = events.agg(F.max(F.length(raw) - F.length(F.replace(F.col(raw), F.lit("{"), F.lit(""))))).first()[0]
    return min(most, max(0, (got or 1) - 1))


def cells(events: DataFrame, keep: tuple[str, ...] = ("seq",), depth: int = DEPTH, arrays: bool = True, internal: bool = True) -> DataFrame:
    """(keep, path, kind, text, value) of every field of the parsed events.

    Objects give no cell of their own; arrays do, and the first element, if an
    object, gives cells below ``path[]``.  A null is a cell (presence counts keys).
    Names are taken in sorted order up to ``KEYS`` an event; ``internal=False``
    leaves out top-level names that start with an underscore."""
    e = _entries(F.col("v"), None)
    if not internal:
        e = F.filter(e, lambda x: ~x["path"].startswith("_"))
    out = events.select(*keep, e.alias("e"))
    for _ in range(depth):
        out = out.withColumn("e", _widen(F.col("e"), arrays))
    flat = F.filter("e", lambda x: ~F.schema_of_variant(x["value"]).startswith("OBJECT"))
    rows = out.select(*keep, F.explode(F.slice(flat, 1, KEYS)).alias("c"))
    text = F.expr("try_variant_get(c.value, '$', 'string')")
    return rows.select(*keep, F.col("c.path").alias("path"), json_kind(F.col("c.value")).alias("kind"), F.substring(text, 1, VALUE).alias("text"), F.col("c.value").alias("value"))


def get_path(v: Column, path: str) -> Column:
    """A nested value as text, null if a step is missing."""
    return F.try_variant_get(v, "$." + path, "string")


def edit(cells_: DataFrame, path: str, new: Column | None, kind: str | None = None) -> DataFrame:
    """Cells with a path's value replaced, or deleted if ``new`` is None."""
    if new is None:
        return cells_.filter(F.col("path") != path)
    hit = F.col("path") == path
    return cells_.withColumn("text", F.when(hit, new).otherwise(F.col("text"))).withColumn("kind", F.when(hit, F.lit(kind)).otherwise(F.col("kind")) if kind else F.col("kind"))


def json_literal(kind: Column, text: Column) -> Column:
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    return F.when(kind == "null", "null").when(kind.isin("integer", "float", "boolean", "array", "object"), text).otherwise(quoted)


def rebuild(cells_: DataFrame, keep: tuple[str, ...] = ("seq",), depth: int = DEPTH) -> DataFrame:
    """(keep, raw): the cells' JSON objects again, nested by the dots of their paths,
    names in order.  Cells below ``[]`` are left out, as the array's own cell holds them;
    a name that itself has a dot comes back nested."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    rows = cells_.filter(~F.contains("path", F.lit("[]."))).select(*keep, F.split("path", r"\.").alias("way"), json_literal(F.col("kind"), F.col("text")).alias("json"))
    most = rows.agg(F.max(F.size("way"))).first()[0] or 1
    for level in range(min(most, depth + 1), 0, -1):
        deep = F.size("way") == level
        pair = F.concat(quoted(F.element_at("way", -1)), F.lit(":"), F.col("json"))
        folded = rows.filter(deep).groupBy(*keep, F.slice("way", 1, F.size("way") - 1).alias("way")).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("json"))
        rows = folded if level == most == 1 else rows.filter(~deep).unionByName(folded)
    return rows.select(*keep, F.col("json").alias("raw"))
