"""Dimension files beside the streams: schemas, consumers, drift states and profiles in YAML.

A folder holds one folder a stream.  Files are found and read by Spark, so any file
system it knows will do and thousands of streams are read in parallel; each file is
parsed whole in the task that has it.  Entries that lack what they need are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The types and categories that a schema file may name.
FIELD_TYPES = ("string", "integer", "float", "boolean", "timestamp_epoch_ms", "timestamp_iso8601", "timestamp_rfc2822", "date", "uuid", "email", "phone", "array", "object", "null", "mixed")
SCHEMA = "stream string, version string, path string, field_type string, nullable boolean, required boolean, presence double, enum array<string>, pii array<string>, confidence double, notes string"
CONSUMERS = "stream string, name string, team string, contact string, criticality string, schema_version string, fields_used array<struct<path:string,required:boolean,transform:string>>, description string, repo string, runbook string"
DOCUMENT = "stream string, document string"


def _fields(doc: dict, folder: str, categories: frozenset[str]) -> Iterator[tuple]:
    for f in doc.get("fields") or ():
        if isinstance(f, dict) and isinstance(f.get("path"), str) and f.get("type") in FIELD_TYPES:
            enum = None if f.get("enum_values") is None else [str(v) for v in f["enum_values"]]
            pii = [c for c in f.get("pii") or () if c in categories]
            yield doc.get("stream", folder), str(doc.get("version", "1.0.0")), f["path"], f["type"], bool(f.get("nullable", False)), bool(f.get("required", True)), float(f.get("presence_rate", 1.0)), enum, pii, float(f.get("confidence", 1.0)), f.get("notes")


def _consumers(doc: dict, folder: str) -> Iterator[tuple]:
    for c in doc.get("consumers") or ():
        used = c.get("fields_used") or () if isinstance(c, dict) else ()
        if isinstance(c, dict) and c.get("name") and all(isinstance(u, dict) and "path" in u for u in used):
            fields = [(u["path"], bool(u.get("required", True)), u.get("transform")) for u in used]
            yield folder, c["name"], c.get("team", "unknown"), c.get("contact", ""), c.get("criticality", "tier3"), str(c.get("schema_version", "1.0.0")), fields, c.get("description"), c.get("repo"), c.get("runbook")


def _document(doc: dict, folder: str) -> Iterator[tuple]:
    yield folder, json.dumps(doc, default=str)


def _read(spark: SparkSession, root: str, file: str, schema: str, rows: Callable[[dict, str], Iterator[tuple]]) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            for folder, text in zip(batch["folder"], batch["value"], strict=True):
                try:
                    doc = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                yield pd.DataFrame(list(rows(doc, folder)) if isinstance(doc, dict) else [], columns=names)

    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", file).option("recursiveFileLookup", True).load(root)
    folder = F.element_at(F.split(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "/"), -2)
    return files.select(folder.alias("folder"), "value").mapInPandas(parse, schema)


def read_schemas(spark: SparkSession, root: str) -> DataFrame:
    """A row a field of every ``schema.yaml``, fit as a baseline for drift; unknown
    types are left out, and so are unknown categories of personal data."""
    from driftloom.functions.pii import NAME_HINTS

    known = frozenset(NAME_HINTS)
    return _read(spark, root, "schema.yaml", SCHEMA, lambda doc, folder: _fields(doc, folder, known))


def read_consumers(spark: SparkSession, root: str) -> DataFrame:
    """A row a consumer of every ``consumers.yaml``, as ``lineage.uses`` takes them."""
    return _read(spark, root, "consumers.yaml", CONSUMERS, _consumers)


def read_profiles(spark: SparkSession, root: str) -> DataFrame:
    """(stream, v) of every ``profile.yaml``, v the document as a VARIANT."""
    return _read(spark, root, "profile.yaml", DOCUMENT, _document).select("stream", F.parse_json("document").alias("v"))


def read_drift_states(spark: SparkSession, root: str) -> DataFrame:
    """(stream, incident) of every ``drift_state.yaml``: a row an incident, as JSON.
    A stream without the file has none."""

    def incidents(doc: dict, folder: str) -> Iterator[tuple]:
        for i in doc.get("incidents") or ():
            yield doc.get("stream_name", folder), json.dumps(i, default=str)

    return _read(spark, root, "drift_state.yaml", DOCUMENT, incidents).withColumnRenamed("document", "incident")
