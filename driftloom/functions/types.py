"""Type inference as expressions over a value's JSON kind and its text.

Four typers: ``semantic`` (drift), ``primitive`` (statistical inference),
``quick`` (profiles) and ``sketch``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names, patterns and ranges.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
UUID_PREFIX = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-"
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
ISO_T = r"^\d{4}-\d{2}-\d{2}T"
DATE = r"^\d{4}-\d{2}-\d{2}$"
EMAIL = r"^[^@]+@[^@]+\.[^@]+$"
EPOCH_MS = (1_000_000_000_000, 9_999_999_999_999)
TIMESTAMPS = ("timestamp_epoch_ms", "timestamp_iso8601", "timestamp_rfc2822")
WIDENING = (("integer", "float"), ("integer", "mixed"), ("float", "mixed"), ("string", "mixed"))
REFINEMENTS = (
    ("string", "uuid"),
    ("string", "email"),
    ("string", "phone"),
    ("string", "date"),
    ("string", "timestamp_iso8601"),
    ("string", "timestamp_rfc2822"),
    ("integer", "timestamp_epoch_ms"),
)


def json_kind(v: Column) -> Column:
    """null, boolean, integer, float, string, array or object of a VARIANT.

    A number without fraction in up to 18 digits is an integer if it was written
    as one; DECIMAL(p,0) beyond that is a big integer."""
    s = F.schema_of_variant(v)
    digits = F.regexp_extract(s, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(s == "VOID", "null")
        .when(s == "BOOLEAN", "boolean")
        .when((s == "BIGINT") | ((digits != "") & (F.length(digits) > 1) & (digits >= "19")), "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def _epoch(text: Column) -> Column:
    return text.try_cast("decimal(38,0)").between(*EPOCH_MS)


def semantic(kind: Column, text: Column) -> Column:
    """The finest type that one value shows."""
    t = F.trim(text)
    return (
        F.when((kind == "integer") & _epoch(text), "timestamp_epoch_ms")
        .when(kind != "string", kind)
        .when(t.rlike(UUID), "uuid")
        .when(text.rlike(EMAIL), "email")
        .when(text.rlike(ISO), "timestamp_iso8601")
        .when(text.rlike(DATE), "date")
        .otherwise("string")
    )


def primitive(kind: Column) -> Column:
    """JSON kinds only."""
    return kind


def quick(kind: Column, text: Column) -> Column:
    return (
        F.when((kind == "integer") & _epoch(text), "timestamp_epoch_ms")
        .when(kind != "string", kind)
        .when(text.rlike(ISO_T), "timestamp_iso8601")
        .when(text.rlike(UUID_PREFIX), "uuid")
        .when(text.rlike(EMAIL), "email")
        .otherwise("string")
    )


def sketch(kind: Column) -> Column:
    return F.when(kind == "float", "number").otherwise(kind)


def of_values(types: Column) -> Column:
    """The type of a field, from the array of its values' types: mixed beyond one."""
    seen = F.array_distinct(F.filter(types, lambda t: t != "null"))
    return F.when(F.size(seen) == 0, "null").when(F.size(seen) == 1, F.get(seen, F.lit(0))).otherwise("mixed")


def of_values_named(types: Column) -> Column:
    """As ``of_values``, mixed naming its parts."""
    seen = F.array_sort(F.array_distinct(types))
    return F.when(F.size(seen) == 0, "null").when(F.size(seen) == 1, F.get(seen, F.lit(0))).otherwise(F.concat(F.lit("mixed("), F.array_join(seen, "/"), F.lit(")")))


def matches(kind: Column, text: Column, wanted: Column) -> Column:
    """Whether one value is valid under a declared type; null and unknown types are."""
    integer, string = kind == "integer", kind == "string"
    return (
        F.when((kind == "null") | kind.isNull(), True)
        .when(wanted == "timestamp_epoch_ms", integer & _epoch(text))
        .when(wanted == "timestamp_iso8601", string & (F.length(text) >= 10) & (F.substring(text, 5, 1) == "-"))
        .when(wanted == "integer", integer)
        .when(wanted == "float", kind.isin("integer", "float"))
        .when(wanted == "boolean", kind == "boolean")
        .when(wanted == "string", string)
        .when(wanted == "uuid", string & (F.length(text) == 36) & (F.substring(text, 9, 1) == "-"))
        .when(wanted == "email", string & F.contains(text, F.lit("@")))
        .when(wanted.isin("array", "object"), kind == wanted)
        .otherwise(True)
    )


def pair_in(a: Column, b: Column, pairs) -> Column:
    out = F.lit(False)
    for x, y in pairs:
        out = out | ((a == x) & (b == y))
    return out
