"""A stored document index as an append-only change log: batches add rows, the latest row of a document counts, snapshots keep reading short."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, MapType, StructField, StructType

from voxlake.functions.text import content_hash
from voxlake.streaming.jobs import clearing

#: The documents that recordings (recording_id) should have now, and those recordings of which that cannot be said (recording_id, fault).
Expected = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
COUNTS = ("inserted", "updated", "repaired", "deleted", "skipped")
#: Recordings that are named to the scan of a snapshot, so that it can step over row groups; more are only joined.
NAMED = 1000
#: Documents of a batch whose keys go to all tasks.
KEYS = 100_000
ATTEMPTS = 3


def no_faults(ids: DataFrame) -> DataFrame:
    return ids.select("recording_id", F.lit(None).cast("string").alias("fault")).limit(0)


def _named(ids: DataFrame) -> list | None:
    """The recordings, if they are few enough to be named to a scan."""
    named = [r[0] for r in ids.select("recording_id").limit(NAMED + 1).collect()]
    return named if len(named) <= NAMED else None


def write_and_clear(df: DataFrame, path: str) -> None:
    """Write df, after which its shuffle files go."""
    with clearing(df.sparkSession):
        df.write.mode("overwrite").parquet(path)


@dataclass
class IndexLog:
    """documents: the schema of a document row, with document_key, recording_id and index_hash (a digest of what the search index holds of it).

    Below root: batch=N/changes has a row for each document that batch N changed, for one that is gone a mark of its key and recording with
    is_live = false; batch=N/plan what becomes of each document, batch=N/outcomes a row for each recording; snapshot=N all documents as of batch N, by recording. Folders count once Spark has committed them. Batches are
    numbered in order by the caller (a stream's batch ids); a batch that runs again sees only earlier ones and replaces itself.
    """

    spark: SparkSession
    root: str
    documents: StructType

    @property
    def schema(self) -> StructType:
        return StructType([*self.documents.fields, StructField("is_live", BooleanType()), StructField("batch", LongType())])

    def _committed(self, kind: str, inside: str = "") -> list[int]:
        """Numbers of the folders of a kind that hold Spark's mark of a committed write, ascending."""
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(context._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
        return [n for n in numbers if fs.exists(context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}={n}{inside}/_SUCCESS"))]

    def rows(self, before: int | None = None, recordings: DataFrame | None = None) -> DataFrame:
        """The latest row of each document before a batch, gone ones included; of some recordings only, if they are given."""
        return self._latest([F.col(c) for c in self.schema.names], before, recordings)

    def _latest(self, columns: list[Column], before: int | None = None, recordings: DataFrame | None = None) -> DataFrame:
        """rows() with these columns instead (document_key, recording_id, is_live and batch among them), made where the rows are read: nothing else is shuffled."""
        early = lambda n: before is None or n < before
        snapshot = max(filter(early, self._committed("snapshot")), default=-1)
        batches = [n for n in self._committed("batch", "/changes") if n > snapshot and early(n)]
        paths = [f"{self.root}/snapshot={snapshot}"] * (snapshot >= 0) + [f"{self.root}/batch={n}/changes" for n in batches]
        if not paths:
            return self.spark.createDataFrame([], self.schema).select(*columns)
        found = self.spark.read.schema(self.schema).parquet(*paths)
        some = named = None
        if recordings is not None:
            some = recordings.select("recording_id").distinct()
            named = _named(some)
        found = found.select(*columns) if named is None else found.filter(F.col("recording_id").isin(named)).select(*columns)
        names = found.columns
        if some is not None and named is None:
            found = found.join(some, "recording_id")  # no semi join, which Spark would move below the columns
        if batches:  # a document that left one recording for another in a batch has a mark beside its row
            newest = Window.partitionBy("document_key").orderBy(F.desc("batch"), F.desc("is_live"))
            found = found.withColumn("_at", F.row_number().over(newest)).filter("_at = 1")
        return found.select(*names)

    def _digest(self) -> Column:
        """A digest of all that a document row says beside its key, recording and index_hash."""
        flat = lambda c: F.to_json(F.struct(c), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
        rest = [f for f in self.documents.fields if f.name not in ("document_key", "recording_id", "index_hash")]
        return content_hash([flat(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name).cast("string") for f in rest])

    def read(self) -> DataFrame:
        """The documents of the index as it is now."""
        return self.rows().filter("is_live").select(*self.documents.names)

    def removed(self) -> DataFrame:
        """document_key of documents that batches took out: their vectors go too."""
        return self.rows().filter("not is_live").select("document_key")

    def write(self, documents: DataFrame) -> None:
        """A whole index as the snapshot before the first batch."""
        self._snapshot(documents.select(*self.documents.names, F.lit(True).alias("is_live"), F.lit(0).cast("long").alias("batch")), 0)

    def _snapshot(self, rows: DataFrame, number: int) -> None:
        write_and_clear(rows.repartitionByRange("recording_id").sortWithinPartitions("recording_id", "document_key"), f"{self.root}/snapshot={number}")

    def compact(self) -> int:
        """Write a snapshot as of the newest batch and return its number; rows of gone documents stay, as marks. Older folders may go once no reader needs them."""
        newest = max([*self._committed("batch", "/changes"), *self._committed("snapshot")], default=0)
        if newest not in self._committed("snapshot"):
            self._snapshot(self.rows(newest + 1), newest)
        return newest

    def outcomes(self, before: int | None = None) -> DataFrame:
        """The last outcome of each recording (before a batch): recording_id, batch, attempt, outcome (synced, failed or given_up), fault and the counts of its documents."""
        paths = [f"{self.root}/batch={n}/outcomes" for n in self._committed("batch", "/outcomes") if before is None or n < before]
        schema = f"recording_id string, batch long, attempt int, outcome string, fault string, {', '.join(f'{c} long' for c in COUNTS)}"
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        own = [c for c in rows.columns if c != "recording_id"]
        return rows.groupBy("recording_id").agg(F.max_by(F.struct(*own), "batch").alias("o")).select("recording_id", "o.*")

    def _written(self, documents: DataFrame, plan: DataFrame, key: list[str], only: bool) -> DataFrame:
        """The documents that a plan inserts, updates or repairs. Keys of these, or of those that stay if they are fewer and the documents are `only` such as are
        planned, go to the texts where they lie; if both are many, texts are shuffled once."""
        n = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        skipped, written = n.get("skipped", 0), sum(n.get(a, 0) for a in COUNTS[:3])
        few, how = ("action = 'skipped'", "left_anti") if only and skipped < written else ("action in ('inserted', 'updated', 'repaired')", "left_semi")
        few = plan.filter(few).select(*key)
        return documents.join(F.broadcast(few) if (skipped if how == "left_anti" else written) <= KEYS else few, key, how)

    def sync(self, expected: Expected, attempts: int = ATTEMPTS) -> Callable[[DataFrame, int], None]:
        """What a batch of touched recordings does: only rows that differ are written, and each recording gets an outcome.

        A recording with a fault keeps what it had, is counted as failed and comes along with the next batches until it succeeds or has failed
        `attempts` times. A document is inserted, updated (any field differs), repaired (only its index_hash does), deleted or skipped. That is decided on
        digests; texts are read again for the documents that are written.
        """
        def run(touched: DataFrame, batch_id: int) -> None:
            number = batch_id + 1  # 0 is what write() stored
            waiting = self.outcomes(number).filter("outcome = 'failed'").select("recording_id", "attempt")
            ids = touched.select(F.col("recording_id").cast("string")).unionByName(waiting.select("recording_id")).distinct()
            documents, faults = expected(ids)
            faults = faults.groupBy("recording_id").agg(F.min("fault").alias("fault"))
            fine = ids.join(faults, "recording_id", "left_anti")
            named = _named(fine)
            documents = documents if named is None else documents.filter(F.col("recording_id").isin(named))
            folder, key = f"{self.root}/batch={number}", ["document_key", "recording_id"]
            told = [F.col("index_hash"), self._digest().alias("rest")]
            side = lambda df, name: df.join(fine, "recording_id").select(*key, F.struct("index_hash", "rest").alias(name))
            new = side(documents.select(*key, *told), "new")
            old = side(self._latest([*map(F.col, key), *told, F.col("is_live"), F.col("batch")], number, ids).filter("is_live"), "old")
            action = (
                F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").when(F.col("new.rest") != F.col("old.rest"), "updated")
                .when(~F.col("new.index_hash").eqNullSafe(F.col("old.index_hash")), "repaired").otherwise("skipped")
            )
            plan = new.join(old, key, "full_outer").select(*key, action.alias("action"))
            write_and_clear(plan, f"{folder}/plan")  # reads only earlier batches, as does what follows
            plan = self.spark.read.schema(plan.schema).parquet(f"{folder}/plan")
            live = self._written(documents, plan, key, named is not None).withColumn("is_live", F.lit(True))
            gone = plan.filter("action = 'deleted'").select(*key, F.lit(False).alias("is_live"))
            changed = live.select(*self.documents.names, "is_live").unionByName(gone, allowMissingColumns=True).withColumn("batch", F.lit(number).cast("long"))
            counts = plan.groupBy("recording_id").agg(*(F.count_if(F.col("action") == c).alias(c) for c in COUNTS))
            said = ids.join(counts, "recording_id", "left").join(faults, "recording_id", "left").join(waiting, "recording_id", "left")
            attempt = F.coalesce("attempt", F.lit(0)) + 1
            outcome = F.when(F.col("fault").isNull(), "synced").when(attempt >= attempts, "given_up").otherwise("failed")
            said = said.select("recording_id", F.lit(number).cast("long").alias("batch"), attempt.cast("int").alias("attempt"), outcome.alias("outcome"), "fault", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS))
            said.write.mode("overwrite").parquet(f"{folder}/outcomes")
            write_and_clear(changed.select(*self.schema.names), f"{folder}/changes")

        return run
