"""Structured Streaming: event-time windows, versioned file state, and a log of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from typeloom.operators.deltas import changes


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by event-time window; on a stream, late rows within the watermark count."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, n) by sessions of activity."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


class VersionedTable:
    """Snapshots (key, mark) under a folder; a version is made only if something changed.

    ``apply`` is a ``foreachBatch`` function: it upserts the batch's (key, mark) rows, a null mark removes
    the key. A version's number is its batch, so a batch that is run again changes nothing. A version counts
    once its marker is there; after a restart the table goes on from the last that counts.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        self.version = max(self.versions(), default=-1)

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions with a marker, in order."""
        at, fs = self._path("v*.committed")
        return sorted(int(f.getPath().getName()[1:].removesuffix(".committed")) for f in fs.globStatus(at) or [])

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version if version is None else version
        if v < 0:
            return self.spark.createDataFrame([], "key string, mark string")
        return self.spark.read.schema("key string, mark string").parquet(f"{self.folder}/v{v}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.version:
            return
        now = batch.groupBy("key").agg(F.max_by("mark", "ts").alias("mark"))
        before = self.read()
        after = before.join(now, "key", "left_anti").unionByName(now.where("mark is not null").select("key", "mark"))
        if changes(before, after).isEmpty():
            return
        after.write.mode("overwrite").parquet(f"{self.folder}/v{batch_id}")
        at, fs = self._path(f"v{batch_id}.committed")
        fs.create(at, True).close()
        self.version = batch_id

    def delta(self, old: int, new: int) -> DataFrame:
        return changes(self.read(old), self.read(new))


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run all that has arrived, batch by batch."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def affected(dirty: DataFrame, flips: DataFrame, dependents: DataFrame) -> DataFrame:
    """Files to validate again: the changed ones, sources whose links may flip, and sources of typed links to them."""
    return dirty.select("path").unionByName(flips.select("path")).unionByName(dependents.select("path")).distinct()
