"""Versions and sinks: source life cycle, transcript and summary versions, tag tables, stored index and vector generations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.operators.items import source_order


def reconcile_listing(known: DataFrame, listing: DataFrame) -> DataFrame:
    """path, change, presence and detached of known sources (path, file_size, file_mtime, presence) against a listing (path, file_size, file_mtime).

    A known file of other size or time is `changed` and detached, to be hashed again; one that was missing
    and is back is `reappeared`.
    """
    k = known.select("path", F.col("file_size").alias("ks"), F.col("file_mtime").alias("km"), "presence")
    n = listing.select("path", F.col("file_size").alias("ns"), F.col("file_mtime").alias("nm"), F.lit(True).alias("there"))
    there, was = F.col("there").isNotNull(), F.col("presence").isNotNull()
    other = ~(F.col("ks").eqNullSafe(F.col("ns")) & F.col("km").eqNullSafe(F.col("nm")))
    change = F.when(~was, "new").when(~there, "missing").when(other, "changed").when(F.col("presence") == "missing", "reappeared").otherwise("unchanged")
    out = k.join(n, "path", "full_outer").withColumn("change", change)
    return out.select("path", "change", F.when(there, "present").otherwise("missing").alias("presence"), (F.col("change") == "changed").alias("detached"))


def canonical_sources(sources: DataFrame) -> DataFrame:
    """recording_id, canonical_id (null without a present source), n_present and audio_status: of the present sources the one with the shortest path, then first seen."""
    here = F.col("presence") == "present"
    order = F.struct(F.length("path"), "first_seen_at", "source_id")
    best = F.min(F.when(here, F.struct(order.alias("o"), F.col("source_id").alias("id"))))
    out = sources.groupBy("recording_id").agg(best.alias("b"), F.count_if(here).alias("n_present"))
    return out.select("recording_id", F.col("b.id").alias("canonical_id"), "n_present", F.when(F.col("n_present") > 0, "present").otherwise("missing").alias("audio_status"))


def validate_sources(recordings: DataFrame, sources: DataFrame, files: DataFrame, inbox: str) -> DataFrame:
    """recording_id, source_id and outcome before processing: the first good source, canonical first, else why the last one tried failed.

    recordings: recording_id, sha256; files: path, file_size, file_mtime, sha256 as they are now. A file with
    equal size and time but another content is `changed` too.
    """
    s = sources.filter("presence = 'present'").join(recordings.select("recording_id", "sha256"), "recording_id")
    f = files.select("path", F.col("file_size").alias("fs"), F.col("file_mtime").alias("fm"), F.col("sha256").alias("fh"))
    s = s.join(f, "path", "left")
    same = (F.col("fs") == F.col("file_size")) & (F.col("fm") == F.col("file_mtime")) & (F.col("sha256").isNull() | (F.col("sha256") == F.col("fh")))
    outcome = F.when(~F.startswith("path", F.lit(inbox)), "outside_inbox").when(F.col("fs").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "valid").otherwise("changed")
    tried = s.withColumn("outcome", outcome).withColumn("at", source_order())
    found = tried.groupBy("recording_id").agg(F.min(F.when(F.col("outcome") == "valid", F.struct("at", "source_id"))).alias("good"), F.max_by("outcome", "at").alias("last"))
    out = recordings.select("recording_id").join(found, "recording_id", "left")
    return out.select("recording_id", F.col("good.source_id").alias("source_id"), F.when(F.col("good").isNotNull(), "valid").otherwise(F.coalesce("last", F.lit("no_source"))).alias("outcome"))


def append_versions(old: DataFrame, new: DataFrame, scope: list[str], at: str = "activated_at") -> DataFrame:
    """Old and new rows of a table of versions: in each scope the latest is active, any other is superseded when its successor came.

    Rows carry the scope's columns, version_id and a time; ties go to the greater version_id.
    """
    rows = old.select(*new.columns).unionByName(new)
    w = Window.partitionBy(*scope).orderBy(at, "version_id")
    return rows.withColumn("superseded_at", F.lead(at).over(w)).withColumn("is_active", F.lead("version_id").over(w).isNull())


def transcript_versions(old: DataFrame, new: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transcripts, sections, summary states) after new transcripts (recording_id, version_id, activated_at) were written.

    Each new version supersedes its recording's former one, has one section over the whole recording, from its
    first start to its last end, and a missing summary.
    """
    rows = append_versions(old, new, ["recording_id"])
    span = segments.groupBy(F.col("transcript_id").alias("version_id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("segments"))
    sections = new.select("version_id").join(span, "version_id", "left").select("version_id", F.lit(0).alias("ordinal"), "start_ms", "end_ms", F.coalesce("segments", F.lit(0)).alias("segments"))
    return rows, sections, new.select("recording_id", F.lit("missing").alias("summary_status"))


def tag_table(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, faults) of configured entries (name, description): good ones with their key; blank, over-long and repeated names are faults."""
    from voxlake.functions.text import strip, tag_name_key

    e = entries.select(strip("name").alias("name"), F.coalesce("description", F.lit("")).alias("description")).withColumn("name_key", tag_name_key(F.col("name")))
    n = e.groupBy("name_key").agg(F.count("*").alias("n"))
    e = e.join(n, "name_key")
    fault = F.when(F.col("name") == "", "blank_name").when(F.length("name") > 100, "long_name").when(F.col("n") > 1, "duplicate_key")
    e = e.withColumn("fault", fault)
    return e.filter("fault is null").select("name_key", "name", "description"), e.filter("fault is not null").select("name_key", "name", "fault")


# ---- stored generations --------------------------------------------------------------------------


def store_generation(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write df as a new generation below root and return its path; readers keep the old one until publish()."""
    path = f"{root.rstrip('/')}/generation-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def publish(spark: SparkSession, root: str, path: str) -> None:
    """Make a stored generation the active one: a one-row table that names it is appended, the newest counts."""
    row = spark.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{root.rstrip('/')}/active")


def active_generation(spark: SparkSession, root: str) -> DataFrame:
    """The active generation's rows."""
    found = spark.read.parquet(f"{root.rstrip('/')}/active").orderBy(F.desc("at"), F.desc("path")).limit(1).first()
    return spark.read.parquet(found["path"])


def replace_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Rewrite only the partitions that df touches."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def generation_counts(generations: DataFrame, vectors: DataFrame) -> DataFrame:
    """state, generations and vectors: all states, and how many vectors the generations of each hold."""
    states = ("building", "active", "superseded", "failed")
    known = generations.sparkSession.createDataFrame([(s,) for s in states], "state string")
    held = vectors.groupBy("generation_id").agg(F.count("*").alias("v"))
    found = generations.join(held, "generation_id", "left").groupBy("state").agg(F.count("*").alias("generations"), F.sum(F.coalesce("v", F.lit(0))).alias("vectors"))
    return known.join(found, "state", "left").select("state", F.coalesce("generations", F.lit(0)).alias("generations"), F.coalesce("vectors", F.lit(0)).alias("vectors"))


def generation_faults(generations: DataFrame, model: str, dimensions: int, embedding_version: str, index_version: str) -> DataFrame:
    """generation_id and faults (an array) of active generations that do not fit the job's settings."""
    checks: dict[str, Column] = {"model_mismatch": F.col("model") != model, "dimension_mismatch": F.col("dimensions") != dimensions, "version_mismatch": F.col("embedding_version") != embedding_version, "index_mismatch": F.col("source_index_version") != index_version}
    return generations.filter("state = 'active'").select("generation_id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])).alias("faults"))


def promoted(generations: DataFrame, candidate: int, expected: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """generations after a building one was checked: active if it holds a usable vector for each expected (document_key, content_hash) and no other, else failed; the former active one is then superseded."""
    from voxlake.functions.vectors import usability

    own = vectors.filter(F.col("generation_id") == candidate)
    both = expected.select("document_key", F.col("content_hash").alias("e")).join(own.select("document_key", F.col("source_content_hash").alias("v"), "embedding"), "document_key", "full_outer")
    bad = ~F.col("e").eqNullSafe(F.col("v")) | (usability(F.col("embedding"), dimensions) != "ok")
    good = not both.filter(bad).limit(1).count()
    mine = F.col("generation_id") == candidate
    state = F.when(mine, "active" if good else "failed")
    if good:
        state = state.when(F.col("state") == "active", "superseded")
    return generations.withColumn("state", state.otherwise(F.col("state")))


