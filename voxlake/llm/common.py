"""Shared folder handling and small helpers for the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it; where it is unset, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Rows of an Arrow batch of whole texts: with the default of 10,000, batches of long texts fill an executor's memory outside the heap.
TEXT_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most TEXT_ROWS rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > TEXT_ROWS:
        df.sparkSession.conf.set(name, str(TEXT_ROWS))
    return df


def returning_memory(batches):
    """The batches of a task; at its end Arrow's unused memory goes back to the system, as workers outlive tasks."""
    import pyarrow as pa

    yield from batches
    pa.default_memory_pool().release_unused()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; no run ever reuses another's."""
    return f"{shared_dir(spark)}/voxlake-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and lost executors cost no rerun."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() wrote and that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/voxlake-" in parent:
                path = context._jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
