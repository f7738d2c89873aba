"""Streams by URI, Kafka options, and sources of one's own."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

_schemes: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_scheme(scheme: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    _schemes[scheme] = reader


def resolve(spark: SparkSession, uri: str) -> DataFrame:
    """The events of a folder, a ``kafka://broker/topic``, or a registered scheme."""
    from driftloom.sources.parse import read_events

    u = urlparse(uri)
    if u.scheme in ("", "file") or len(u.scheme) == 1:
        return read_events(spark, u.path if u.scheme == "file" else uri)
    if u.scheme == "kafka":
        return read_kafka(spark, u.netloc, u.path.strip("/"))
    if u.scheme in _schemes:
        return _schemes[u.scheme](spark, uri)
    raise ValueError(f"no reader for {u.scheme}://")


def kafka_options(brokers: str, topic: str, start: str = "earliest", most: int | None = None, offsets: dict[int, int] | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": json.dumps({topic: {str(k): v for k, v in offsets.items()}}) if offsets else start, "failOnDataLoss": "false"}
    return out | ({"maxOffsetsPerTrigger": str(most)} if most else {})


def tail_offsets(ends: dict[int, int], n: int) -> dict[int, int]:
    """Where to start for the last n messages of every partition."""
    return {p: max(0, e - n) for p, e in ends.items()}


def read_kafka(spark: SparkSession, brokers: str, topic: str, most: int | None = None) -> DataFrame:
    """(seq, raw, v) of a topic, partitions taken in equal parts; needs the Kafka package.
    Empty values, values over 5 MB and non-objects are left out."""
    rows = spark.read.format("kafka").options(**kafka_options(brokers, topic)).load()
    return kafka_events(rows, most)


def kafka_events(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The same from (partition, offset, value) rows."""
    w = Window.partitionBy("partition").orderBy("offset")
    r = rows.filter(F.col("value").isNotNull() & (F.length("value") <= 5_000_000)).withColumn("nth", F.row_number().over(w))
    r = r.withColumn("raw", F.col("value").cast("string")).withColumn("v", F.try_parse_json("raw")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    r = r.orderBy("nth", "partition").limit(most) if most else r
    return r.select((F.col("partition").cast("long") * F.lit(1 << 40) + F.col("offset")).alias("seq"), "raw", "v")


class _TailReader(SimpleDataSourceStreamReader):
    """New lines of growing files: the offset holds each file's line count, and a
    file that shrank is read from its start."""

    def __init__(self, options: dict) -> None:
        self._path = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def _lines(self) -> dict[str, list[str]]:
        import glob
        import os

        out = {}
        for f in sorted(glob.glob(os.path.join(self._path, "**", "*"), recursive=True)):
            if f.endswith((".ndjson", ".json", ".jsonl")) and not os.path.basename(f).startswith("._"):
                with open(f, errors="replace") as h:
                    out[f] = h.read().splitlines()
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for f, lines in self._lines().items():
            seen = int(start.get(f, 0))
            seen = 0 if seen > len(lines) else seen
            rows += [(f, k, lines[k]) for k in range(seen, len(lines)) if lines[k].strip()]
            end[f] = len(lines)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for f, lines in self._lines().items():
            seen = int(start.get(f, 0))
            seen = 0 if seen > int(end.get(f, 0)) else seen
            for k in range(seen, min(len(lines), int(end.get(f, 0)))):
                if lines[k].strip():
                    yield f, k, lines[k]


class TailSource(DataSource):
    """``spark.readStream.format("tail").load(folder)``: (file, line_no, line) of files
    on a file system that the driver mounts."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, line_no long, line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _TailReader(self.options)


class QueueBrowser:
    """What a read-only queue client offers: at most ``most`` messages, none removed."""

    def peek(self, queue: str, most: int) -> list[str]:
        raise NotImplementedError

    def depth(self, queue: str) -> int:
        raise NotImplementedError


_browsers: dict[str, QueueBrowser] = {}


def register_browser(name: str, browser: QueueBrowser) -> None:
    _browsers[name] = browser


class _QueueReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._queue, self._browser, self._most = options["queue"], _browsers[options["browser"]], int(options.get("most", 10))
        if int(options.get("visibilitytimeout", options.get("visibilityTimeout", 0))) != 0:
            raise ValueError("a peek must not hide messages: the visibility timeout is 0")
        if not 1 <= self._most <= 10:
            raise ValueError("a peek takes 1 to 10 messages")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        now = time.time()
        for k, body in enumerate(self._browser.peek(self._queue, self._most)):
            try:
                ok = isinstance(json.loads(body), dict)
            except ValueError:
                ok = False
            yield self._queue, k, body if ok else json.dumps({"_raw": body}), now


class QueueSource(DataSource):
    """``spark.read.format("queue").option("browser", name).option("queue", q)``:
    (queue, position, raw, seen_at) without taking a message off."""

    @classmethod
    def name(cls) -> str:
        return "queue"

    def schema(self) -> str:
        return "queue string, position long, raw string, seen_at double"

    def reader(self, schema) -> DataSourceReader:
        return _QueueReader(self.options)


def phased(spark: SparkSession, phases: list[tuple[list[str], int]], loop_last: bool = False, most: int = 10_000) -> DataFrame:
    """(phase, seq, raw): events of scripted phases, (lines, count) each, the last
    repeated up to ``most`` rows if asked."""
    rows, seq = [], 0
    for p, (lines, n) in enumerate(phases):
        n = max(n, most - seq) if loop_last and p == len(phases) - 1 else n
        for k in range(n):
            rows.append((p, seq, lines[k % len(lines)]))
            seq += 1
    return spark.createDataFrame(rows, "phase int, seq long, raw string")
