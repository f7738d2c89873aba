"""Names, versions, windows of time, sentences about drifts."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def bump_version(version: Column, tier: Column) -> Column:
    """SemVer: tier 3 raises major, 2 minor, 1 patch; odd versions start from 1.0.0."""
    part = lambda k: F.coalesce(F.get(F.split(version, r"\."), F.lit(k)).try_cast("int"), F.lit(1 if k == 0 else 0))
    a, b, c = part(0), part(1), part(2)
    to = lambda *x: F.concat_ws(".", *(F.lit(y).cast("string") if isinstance(y, int) else y.cast("string") for y in x))
    return F.when(tier >= 3, to(a + 1, 0, 0)).when(tier == 2, to(a, b + 1, 0)).otherwise(to(a, b, c + 1))


def safe_column(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\[\]", ""), r"[^A-Za-z0-9_]", "_")


def pascal_case(name: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(name, r"[^A-Za-z0-9]+", " ")), " ", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-")


def subject_for_topic(topic: Column, suffix: str = "-value") -> Column:
    return F.concat(topic, F.lit(suffix))


def since(text: str) -> timedelta:
    """'7d', '24h', '90m'; 30 days otherwise."""
    m = re.fullmatch(r"\s*(\d+)\s*([dhm])\s*", text or "")
    return timedelta(**{{"d": "days", "h": "hours", "m": "minutes"}[m[2]]: int(m[1])}) if m else timedelta(days=30)


def since_time(text: str, now: datetime) -> datetime:
    """The time that a window begins at: an ISO date or time, or so long before now."""
    try:
        at = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return now - since(text)
    return at.replace(tzinfo=now.tzinfo) if at.tzinfo is None else at


def percent(rate: Column) -> Column:
    return F.concat(F.round(F.coalesce(rate, F.lit(0.0)) * 100).cast("int").cast("string"), F.lit("%"))


def describe_drift(kind: Column, path: Column, before: Column, after: Column, old_type: Column, new_type: Column) -> Column:
    """One sentence about a drift, with what to do."""
    p = F.concat(F.lit("'"), path, F.lit("'"))
    s = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    return (
        F.when(kind == "field_removed", s("Field ", p, " is gone (", percent(before), " to ", percent(after), "): look for a rename at the producer, then accept or roll back."))
        .when(kind == "presence_drop", s("Field ", p, " became rarer (", percent(before), " to ", percent(after), "): see whether the producer omits it on purpose."))
        .when(kind == "presence_increase", s("Field ", p, " became more frequent (", percent(before), " to ", percent(after), ")."))
        .when(kind == "type_changed", s("Field ", p, " changed from ", F.coalesce(old_type, F.lit("unknown")), " to ", F.coalesce(new_type, F.lit("unknown")), ": check consumers, then accept."))
        .when(kind == "enum_changed", s("Field ", p, " has values that the baseline lacks: extend the enum if they are meant."))
        .when(kind == "new_pii", s("Field ", p, " shows personal data: review it before anything reads it."))
        .when(kind == "field_added", s("Field ", p, " is new (", percent(after), "): review and accept."))
        .otherwise(s("Drift on field ", p, " (", kind, ")."))
    )
