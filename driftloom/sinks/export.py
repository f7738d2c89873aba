"""Schemas as JSON Schema, Avro, Protobuf, Flink, ksqlDB, Spark DDL and Markdown.

All take a stream name and the fields (path, field_type, required, nullable, pii,
enum) of one schema: a handful of rows that the driver holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The types of each target.
JSON = {"string": "string", "uuid": "string", "email": "string", "phone": "string", "integer": "integer", "float": "number", "boolean": "boolean", "timestamp_epoch_ms": "integer", "timestamp_iso8601": "string", "timestamp_rfc2822": "string", "date": "string", "array": "array", "object": "object", "null": "null"}
JSON_FORMATS = {"uuid": "uuid", "email": "email", "timestamp_iso8601": "date-time", "date": "date"}
AVRO = {"integer": "long", "float": "double", "boolean": "boolean", "timestamp_epoch_ms": {"type": "long", "logicalType": "timestamp-millis"}, "date": "string", "uuid": {"type": "string", "logicalType": "uuid"}, "array": {"type": "array", "items": "string"}, "mixed": ["null", "string", "int", "long", "float", "double", "boolean"]}
PROTO = {"integer": "int64", "float": "double", "boolean": "bool", "object": "bytes", "mixed": "bytes", "null": "bytes", "timestamp_epoch_ms": "google.protobuf.Timestamp", "timestamp_iso8601": "google.protobuf.Timestamp", "array": "repeated string"}
FLINK = {"integer": "BIGINT", "float": "DOUBLE", "boolean": "BOOLEAN", "timestamp_epoch_ms": "BIGINT", "timestamp_iso8601": "TIMESTAMP(3)", "date": "DATE", "array": "ARRAY<STRING>", "object": "ROW<>"}
KSQL = {"integer": "BIGINT", "float": "DOUBLE", "boolean": "BOOLEAN", "timestamp_epoch_ms": "BIGINT", "date": "DATE", "array": "ARRAY<VARCHAR>", "object": "STRUCT<>"}
SPARK = {"integer": "BIGINT", "float": "DOUBLE", "boolean": "BOOLEAN", "timestamp_epoch_ms": "BIGINT", "timestamp_iso8601": "TIMESTAMP", "date": "DATE", "array": "ARRAY<STRING>", "object": "VARIANT", "mixed": "VARIANT"}
RESERVED = frozenset("timestamp time date value key offset table select from where order group join type".split())
KSQL_KEYS = ("event_id", "id", "message_id", "record_id")
ENUM_SYMBOLS = 50


def rows_of(schema: DataFrame, most: int = 10_000) -> list[dict]:
    """The fields of one schema by path; more than ``most`` is no schema."""
    rows = [r.asDict() for r in schema.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a schema of more than {most} fields")
    return sorted(rows, key=lambda r: r["path"])


def parents(schema: DataFrame) -> DataFrame:
    """``schema`` with rows for the objects above its paths: an array if a child is
    below ``name[]``; least presence and confidence; required if all children are."""
    steps = F.split("path", r"\.")
    above = schema.select("path", "presence", "required", "confidence", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.when(k < F.size(steps), F.array_join(F.slice(steps, 1, k), "."))), lambda x: x.isNotNull())).alias("parent"))
    name = F.regexp_replace("parent", r"\[\]$", "")
    got = above.groupBy(name.alias("path")).agg(F.max(F.endswith("parent", F.lit("[]"))).alias("array"), F.min("presence").alias("presence"), F.every("required").alias("required"), F.min("confidence").alias("confidence"))
    new = got.join(schema.select("path"), "path", "left_anti").select("path", F.when(F.col("array"), "array").otherwise("object").alias("field_type"), "presence", "required", "confidence")
    return schema.unionByName(new, allowMissingColumns=True)


def _json_type(f: dict) -> dict:
    t = f["field_type"]
    out: dict = {} if t == "mixed" else {"type": JSON.get(t, "string")}
    if t in JSON_FORMATS:
        out["format"] = JSON_FORMATS[t]
    if f.get("enum"):
        out["enum"] = list(f["enum"])
    if f.get("nullable") and out:
        out = {"anyOf": [out, {"type": "null"}]}
    if f.get("pii"):
        out["x-pii"] = list(f["pii"])
    return out


def json_schema(stream: str, fields: Iterable[dict], version: str = "1.0.0") -> dict:
    """Draft 2020-12, paths as nested objects and arrays."""
    root: dict = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": stream, "version": version, "type": "object", "properties": {}, "required": []}
    for f in sorted(fields, key=lambda r: r["path"]):
        at = root
        steps = f["path"].split(".")
        for step in steps[:-1]:
            name = step.removesuffix("[]")
            node = at.setdefault("properties", {}).setdefault(name, {})
            if step.endswith("[]"):
                node["type"] = "array"
                node = node.setdefault("items", {})
            node["type"] = "object"
            at = node
        leaf = at.setdefault("properties", {})
        leaf[steps[-1]] = {**_json_type(f), **{k: v for k, v in leaf.get(steps[-1], {}).items() if k in ("properties", "items")}}
        if f.get("required"):
            at.setdefault("required", []).append(steps[-1])
    return root


def profile_json_schema(stream: str, clusters: dict[str, list[dict]]) -> dict:
    """oneOf the clusters' schemas."""
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": stream, "oneOf": [json_schema(c, f) for c, f in sorted(clusters.items())]}


def _identifier(name: str) -> str:
    n = re.sub(r"[^A-Za-z0-9_]", "_", name.replace("[]", ""))
    return n if re.match(r"[A-Za-z_]", n) else "_" + n


def _pascal(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z0-9]+", name) if p) or "Record"


def avro(stream: str, fields: Iterable[dict], namespace: str = "events") -> dict:
    """A record; short enums of plain symbols as enum, one level of nesting as records."""

    def typed(f: dict, name: str) -> object:
        symbols = f.get("enum") or []
        if symbols and len(symbols) <= ENUM_SYMBOLS and all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", s) for s in symbols):
            return {"type": "enum", "name": _pascal(name) + "Enum", "symbols": list(symbols)}
        return AVRO.get(f["field_type"], "string")

    def member(f: dict, name: str) -> dict:
        t = typed(f, name)
        if (f.get("nullable") or not f.get("required")) and not (isinstance(t, list) and "null" in t):
            return {"name": _identifier(name), "type": ["null", t], "default": None}
        return {"name": _identifier(name), "type": t}

    tops: dict[str, list[dict]] = {}
    for f in sorted(fields, key=lambda r: r["path"]):
        tops.setdefault(f["path"].split(".")[0], []).append(f)
    out = []
    for top, group in tops.items():
        if len(group) == 1 and group[0]["path"] == top:
            out.append(member(group[0], top))
        else:
            inner = [member(f, f["path"][len(top) + 1 :].replace(".", "_")) for f in group if f["path"] != top]
            record: object = {"type": "record", "name": _pascal(top), "fields": inner}
            out.append({"name": _identifier(top), "type": {"type": "array", "items": record} if top.endswith("[]") else record})
    return {"type": "record", "name": _pascal(stream), "namespace": namespace, "fields": out}


def registry_payload(stream: str, fields: Iterable[dict]) -> dict:
    return {"schema": json.dumps(avro(stream, fields)), "schemaType": "AVRO"}


def proto(stream: str, fields: Iterable[dict]) -> str:
    """proto3, numbered by path."""
    rows = sorted(fields, key=lambda r: r["path"])
    stamps = any(PROTO.get(f["field_type"], "").startswith("google") for f in rows)
    lines = ['syntax = "proto3";', ""] + (['import "google/protobuf/timestamp.proto";', ""] if stamps else []) + [f"message {_pascal(stream)} {{"]
    for k, f in enumerate(rows, 1):
        t = PROTO.get(f["field_type"], "string")
        optional = "" if f.get("required") or t.startswith("repeated") else "optional "
        lines.append(f"  {optional}{t} {_identifier(f['path']).lower()} = {k};")
    return "\n".join([*lines, "}", ""])


def flink_ddl(stream: str, fields: Iterable[dict], brokers: str = "localhost:9092") -> str:
    """A Kafka table; an epoch field becomes event time with a watermark of 5 seconds."""
    quote = lambda n: f"`{n}`" if n.lower() in RESERVED or re.search(r"[.\-\[]", n) else n
    rows = list(fields)
    cols, stamp = [], next((f["path"] for f in rows if f["field_type"] in ("timestamp_epoch_ms", "timestamp_iso8601")), None)
    for f in rows:
        if f["field_type"] == "timestamp_epoch_ms" and f["path"] == stamp:
            cols.append(f"  {quote(f['path'])} TIMESTAMP(3) METADATA FROM 'timestamp'")
        else:
            cols.append(f"  {quote(f['path'])} {FLINK.get(f['field_type'], 'STRING')}")
    if stamp:
        cols.append(f"  WATERMARK FOR {quote(stamp)} AS {quote(stamp)} - INTERVAL '5' SECOND")
    body = ",\n".join(cols)
    return f"CREATE TABLE {_identifier(stream)} (\n{body}\n) WITH (\n  'connector' = 'kafka',\n  'topic' = '{stream}',\n  'properties.bootstrap.servers' = '{brokers}',\n  'format' = 'json'\n);\n"


def ksqldb(stream: str, fields: Iterable[dict], value_format: str = "JSON") -> str:
    rows = list(fields)
    paths = {f["path"] for f in rows}
    key = next((k for k in KSQL_KEYS if k in paths), None)
    column = lambda p: _identifier(p).upper()
    cols = ",\n".join(f"  {column(f['path'])} {KSQL.get(f['field_type'], 'VARCHAR')}{' KEY' if f['path'] == key else ''}" for f in rows)
    options = [f"KAFKA_TOPIC='{stream}'", f"VALUE_FORMAT='{value_format}'"]
    if stamp := next((f for f in rows if f["field_type"] in ("timestamp_epoch_ms", "timestamp_iso8601")), None):
        options.append(f"TIMESTAMP='{column(stamp['path'])}'")
        if stamp["field_type"] == "timestamp_iso8601":
            options.append("TIMESTAMP_FORMAT='yyyy-MM-dd''T''HH:mm:ss.SSSZ'")
    return f"CREATE STREAM {_identifier(stream).upper()} (\n{cols}\n) WITH (\n  " + ",\n  ".join([*options, "PARTITIONS=1"]) + "\n);\n"


def spark_ddl(stream: str, fields: Iterable[dict]) -> str:
    cols = ",\n".join(f"  `{f['path']}` {SPARK.get(f['field_type'], 'STRING')}{' NOT NULL' if f.get('required') else ''}" for f in fields)
    return f"CREATE TABLE `{stream}` (\n{cols}\n) USING parquet;\n"


def markdown(stream: str, fields: Iterable[dict]) -> str:
    """A data dictionary."""
    cell = lambda x: str(x).replace("|", "\\|")
    lines = [f"# {stream}", "", "| Field | Type | Required | Presence | Personal data |", "|-|-|-|-|-|"]
    for f in fields:
        presence = f"{f['presence']:.0%}" if f.get("presence") is not None else ""
        lines.append(f"| {cell(f['path'])} | {f['field_type']} | {'yes' if f.get('required') else 'no'} | {presence} | {', '.join(f.get('pii') or [])} |")
    return "\n".join([*lines, ""])


def drift_markdown(stream: str, findings: Iterable[dict]) -> str:
    rows = sorted(findings, key=lambda r: (-r["tier"], r["path"]))
    lines = [f"# Drift of {stream}", "", f"{len(rows)} findings.", ""]
    return "\n".join([*lines, *(f"- tier {r['tier']} {r['drift_type']} `{r['path']}` ({r['class']})" for r in rows), ""])
