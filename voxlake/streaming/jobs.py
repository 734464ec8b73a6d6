"""Structured Streaming jobs: stability gate, duplicate-safe ingest, time-outs, running counts; streaming.changelog has the index sync."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STABLE_SECONDS = 30


class StabilityGate(StatefulProcessor):
    """A file's size and time since when they stand, as value state; an event-time timer drops it when no listing has named the file for 20 waiting times."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "length long, mtime double, since double, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        length, mtime, since, done = self.file.get() if self.file.exists() else (None, None, None, False)
        for r in sorted(rows, key=lambda r: r.seen_at):
            now = r.seen_at.timestamp()
            if (r.length, r.mtime) != (length, mtime):
                length, mtime, since, done = r.length, r.mtime, now, False
            elif not done and now - since >= self.seconds:
                yield Row(path=key[0], length=length, mtime=mtime)
                done = True
        self.file.update((length, mtime, since, done))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(max(since * 1000, timerValues.getCurrentWatermarkInMs() + 1000) + 20 * self.seconds * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.file.clear()
        return iter(())

    def close(self) -> None:
        pass


def stability_gate(listings: DataFrame, seconds: int = STABLE_SECONDS) -> DataFrame:
    """path, length and mtime of files whose size and time did not change for `seconds`, once for each version.

    listings: a stream of (path, length, mtime, seen_at); state is one row a path and goes with the
    watermark of ten waiting times. Run it inside timers_on().
    """
    seen = listings.withWatermark("seen_at", f"{10 * seconds} seconds")
    return seen.groupBy("path").transformWithState(StabilityGate(seconds), "path string, length long, mtime double", "append", "EventTime")


@contextmanager
def timers_on(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with timers need, for streams that start inside; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def first_contents(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of files (sha256, seen_at) without repeated contents inside the watermark."""
    return files.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["sha256"])


def interrupted(attempts: DataFrame, wait: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """attempt_id of a stream of (attempt_id, kind start or finish, ts) whose finish did not come within `wait`.

    A left outer stream-stream join; the watermark bounds its state and releases the unmatched starts.
    """
    seen = attempts.withWatermark("ts", late)  # before the split, so that either kind moves both watermarks
    starts = seen.filter("kind = 'start'").select(F.col("attempt_id").alias("s_id"), F.col("ts").alias("s_ts"))
    ends = seen.filter("kind = 'finish'").select(F.col("attempt_id").alias("f_id"), F.col("ts").alias("f_ts"))
    near = F.expr(f"s_id = f_id AND f_ts >= s_ts AND f_ts <= s_ts + INTERVAL {wait}")
    return starts.join(ends, near, "leftOuter").filter("f_id is null").select(F.col("s_id").alias("attempt_id"), F.col("s_ts").alias("started_at"))


def running_counts(events: DataFrame, column: str) -> DataFrame:
    """Running count of each value, for update or complete mode."""
    return events.groupBy(column).agg(F.count("*").alias("n"))


def sync_stream(changes: DataFrame, touched: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each batch's distinct recording ids to `touched`, which must be idempotent by batch id."""
    def run(batch: DataFrame, batch_id: int) -> None:
        touched(batch.select("recording_id").distinct(), batch_id)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, path: str, schema: str, files: int | None = 1) -> DataFrame:
    """Parquet files as a stream, so many files a batch; all in one with None."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir for a stream's state and results."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/voxlake-{label}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, label: str, counts: str | None = None) -> DataFrame:
    """Everything that a stream has to say now, as a table in the shared folder.

    counts: a key column of a running aggregation; each batch then writes its updates, and the last one of a key counts.
    """
    spark = stream.sparkSession
    path = shared_folder(spark, label)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if counts is None:
        with timers_on(spark):
            writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")

    def update(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/step={batch_id}")

    writer.outputMode("update").foreachBatch(update).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows").drop("step")
    rest = [c for c in stream.columns if c != counts]
    return rows.groupBy(counts).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(counts, "r.*")
