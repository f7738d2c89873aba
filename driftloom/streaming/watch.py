"""Watching a stream: batches into a count-based window, drift, phases, incidents.

One ``foreachBatch`` does it all with the batch operators.  What lasts between
batches are small Parquet tables beside the checkpoint, written a batch at a time
under the batch's number: a batch that is delivered again finds the state before
it and writes the same files, so results count once.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftloom.operators import drift, incidents, sampling
from driftloom.operators.cells import cells, parse_events

WINDOW, SAMPLE, LEAST = 2000, 200, 10
WARMUP, CLEAN, CONSECUTIVE = 10, 3, 2


@dataclass
class Phase:
    """LEARNING, then STABILIZING, then STABLE.  Tier 3 always fires; findings while
    learning or stabilizing are held back, and in STABLE they must repeat."""

    phase: str = "LEARNING"
    warmup: int = WARMUP
    clean: int = 0
    consecutive: int = 0
    cycles: int = 0
    need_clean: int = CLEAN
    need_consecutive: int = CONSECUTIVE

    def tick(self, findings: int, highest_tier: int = 0) -> str:
        """suppress, alert, clean or tier3."""
        self.cycles += 1
        drifted = findings > 0
        if drifted and highest_tier >= 3:
            if self.phase == "STABLE":
                self.consecutive = 0
            return "tier3"
        if self.phase == "LEARNING":
            self.warmup -= 1
            if self.warmup <= 0:
                self.phase, self.clean = "STABILIZING", 0
            return "suppress" if drifted else "clean"
        if self.phase == "STABILIZING":
            if drifted:
                self.clean = 0 if highest_tier >= 2 else self.clean
                return "suppress"
            self.clean += 1
            if self.clean >= self.need_clean:
                self.phase, self.consecutive = "STABLE", 0
            return "clean"
        if not drifted:
            self.consecutive = 0
            return "clean"
        self.consecutive += 1
        return "alert" if self.consecutive >= self.need_consecutive else "suppress"


class Watch:
    """A watch over one stream; ``baseline`` as :func:`drift.detect` takes it."""

    def __init__(self, spark: SparkSession, baseline: DataFrame, folder: str, window: int = WINDOW, sample: int = SAMPLE, least: int = LEAST, on_event=None, depth: int = 10, clock=None) -> None:
        self.spark, self.baseline, self.folder = spark, baseline, folder
        self.window, self.sample, self.least, self.on_event, self.depth = window, sample, least, on_event, depth
        self.clock = clock or (lambda batch: time.time())  # seconds since 1970 at a batch

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _read(self, table: str, batch: int, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(table, batch))
        except Exception as e:  # the first batch has none
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def phase(self, batch: int) -> Phase:
        row = self._read("phase", batch, "state string").first()
        return Phase(**json.loads(row["state"])) if row else Phase()

    def incidents(self, batch: int) -> DataFrame:
        return self._read("incidents", batch, "cluster_id string, path string, drift_type string, tier int, status string, first_detected timestamp, last_seen timestamp, occurrences long")

    def process(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch of (seq, raw)."""
        before = self._read("window", batch - 1, "seq long, raw string")
        window = before.union(rows.select("seq", "raw")).orderBy(F.desc("seq")).limit(self.window)
        window.write.mode("overwrite").parquet(self._path("window", batch))
        window = self.spark.read.parquet(self._path("window", batch))
        state = self.phase(batch - 1)
        had = self.incidents(batch - 1)
        if window.limit(self.least).count() < self.least:
            found, action = [], "warming"
        else:
            events = parse_events(sampling.reservoir(window, self.sample, batch))
            c = cells(events, depth=self.depth, internal=False).drop("value").persist()
            found_df = drift.detect(self.baseline, c, events.filter(F.col("v").isNotNull()))
            found = [r.asDict() for r in found_df.select("path", "drift_type", "tier", "class").collect()]  # a few a field of the sampled events
            c.unpersist()
            action = state.tick(len(found), max((r["tier"] for r in found), default=0))
        shown = self.spark.createDataFrame([(None, r["path"], r["drift_type"], r["tier"]) for r in found], "cluster_id string, path string, drift_type string, tier int")
        now = F.timestamp_seconds(F.lit(float(self.clock(batch))))
        merged = incidents.prune(incidents.merge(had, shown, now), now) if action in ("tier3", "alert", "clean") else had
        merged.write.mode("overwrite").parquet(self._path("incidents", batch))
        self.spark.createDataFrame([(json.dumps(asdict(state)),)], "state string").coalesce(1).write.mode("overwrite").parquet(self._path("phase", batch))
        log = self.spark.createDataFrame([(batch, action, len(found), max((r["tier"] for r in found), default=0))], "batch long, action string, findings int, highest_tier int")
        log.coalesce(1).write.mode("overwrite").parquet(self._path("ticks", batch))
        if self.on_event and action in ("tier3", "alert"):
            self.on_event(batch, action, found)

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = None):
        """The running query over a stream of (seq, raw); without an interval it
        takes what is there and ends."""
        w = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()

    def ticks(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").schema("batch long, action string, findings int, highest_tier int").parquet(f"{self.folder}/ticks")


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "5 seconds", slide: str | None = None) -> DataFrame:
    """Counts by event type and window of event time, late rows dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "5 seconds") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


class LastN(StatefulProcessor):
    """State of the newest n rows (seq, raw) of a key, for ``transformWithStateInPandas``;
    gives (key, kept, newest) after each batch."""

    n = WINDOW

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "seq long, raw string")

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        kept = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for part in rows:
            kept += list(zip(part["seq"].tolist(), part["raw"].tolist(), strict=True))
        kept = sorted(kept)[-self.n :]
        self.rows.put(kept)
        yield pd.DataFrame({"key": [key[0]], "kept": [len(kept)], "newest": [kept[-1][0]]})

    def close(self) -> None:
        pass


def breaker(fails: int = 5, rest: float = 30.0):
    """A circuit breaker around calls: after ``fails`` failures in a row calls are
    refused for ``rest`` seconds, then one is tried."""
    import time

    state = {"fails": 0, "until": 0.0}

    def call(fn, *args, clock=time.monotonic):
        if state["fails"] >= fails and clock() < state["until"]:
            raise RuntimeError("circuit open")
        try:
            got = fn(*args)
        except Exception:
            state["fails"] += 1
            state["until"] = clock() + rest
            raise
        state["fails"] = 0
        return got

    return call


def supervise(start, most: int = 10, first: float = 5.0, cap: float = 120.0, sleep=None) -> int:
    """Run ``start()`` (which returns a query or blocks) again after failures, waiting
    twice as long each time; the number of restarts."""
    import time

    sleep, wait, tries = sleep or time.sleep, first, 0
    while True:
        try:
            q = start()
            if q is not None:
                q.awaitTermination()
            return tries
        except Exception:
            if tries >= most:
                raise
            sleep(wait)
            wait, tries = min(cap, wait * 2), tries + 1
