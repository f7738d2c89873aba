"""Events and findings to other systems: dead letters, notices, registries, audit."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dead_letters(bad: DataFrame, topic: str, producer: str, problem: Column, at: Column, raw: str = "raw", min_tier: int = 1, tier: Column | None = None) -> DataFrame:
    """(topic, value): envelopes of rejected events for ``<topic>.dlq``."""
    rows = bad if tier is None else bad.filter(tier >= min_tier)
    envelope = F.to_json(F.struct(F.lit(topic).alias("source_topic"), F.lit(producer).alias("producer"), problem.alias("violation"), at.alias("at"), F.col(raw).alias("event")))
    return rows.select(F.lit(f"{topic}.dlq").alias("topic"), envelope.alias("value"))


def write_kafka(df: DataFrame, brokers: str) -> None:
    """Needs the Kafka package on the class path."""
    df.selectExpr("topic", "CAST(value AS STRING) AS value").write.format("kafka").option("kafka.bootstrap.servers", brokers).save()


def notice(stream: str, findings: list[dict], most: int = 5) -> dict:
    """A chat message of the worst findings."""
    rows = sorted(findings, key=lambda r: -r["tier"])
    lines = [f"tier {r['tier']} {r['drift_type']} {r['path']}" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"and {len(rows) - most} more")
    return {"text": f"{stream}: {len(rows)} findings\n" + "\n".join(lines)}


def post(url: str, payload: dict, min_tier: int = 1, tier: int = 3, timeout: float = 5.0) -> bool:
    """Send and forget; False if it wasn't sent."""
    if tier < min_tier:
        return False
    try:
        request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return answer.status < 300
    except Exception:  # noqa: BLE001 a notice never stops the engine
        return False


class SchemaRegistry:
    """A registry over HTTP; ``send(method, path, body)`` returns the decoded answer.
    No call raises: failures come back as None, False or an empty list."""

    def __init__(self, send: Callable[[str, str, dict | None], object]) -> None:
        self._send = send

    def _try(self, *call, default=None):
        try:
            return self._send(*call)
        except Exception:  # noqa: BLE001
            return default

    def push(self, subject: str, payload: dict) -> int | None:
        got = self._try("POST", f"/subjects/{subject}/versions", payload)
        return got.get("id") if isinstance(got, dict) else None

    def get(self, subject: str, version: str = "latest") -> dict | None:
        got = self._try("GET", f"/subjects/{subject}/versions/{version}", None)
        return got if isinstance(got, dict) else None

    def subjects(self) -> list[str]:
        return list(self._try("GET", "/subjects", None, default=[]) or [])

    def compatible(self, subject: str, payload: dict) -> bool:
        got = self._try("POST", f"/compatibility/subjects/{subject}/versions/latest", payload)
        return bool(isinstance(got, dict) and got.get("is_compatible"))

    def ping(self) -> bool:
        return self._try("GET", "/subjects", None) is not None


def audit(findings: DataFrame, stream: str, batch: int, at: Column) -> DataFrame:
    """(stream, batch, at, level, findings, highest_tier) of one batch."""
    g = findings.agg(F.count("*").alias("findings"), F.coalesce(F.max("tier"), F.lit(0)).alias("highest_tier"))
    return g.select(F.lit(stream).alias("stream"), F.lit(batch).cast("long").alias("batch"), at.alias("at"), F.when(F.col("findings") > 0, "INFO").otherwise("DEBUG").alias("level"), "findings", "highest_tier")


def metrics_text(counters: dict[str, float], prefix: str = "driftloom") -> str:
    """Counters in the text format that scrapers read."""
    return "".join(f"# TYPE {prefix}_{k} counter\n{prefix}_{k} {v:g}\n" for k, v in sorted(counters.items()))
