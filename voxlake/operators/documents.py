"""Search documents: building, content hashes, status against an index, incremental synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from voxlake.operators.scans import covering

from voxlake.functions.text import content_hash, join_nonblank, strip

INDEX_VERSION = "2"
#: The parts of a content hash, in their order.
FIELDS = (
    "document_key", "doc_type", "recording_id", "transcript_id", "summary_id", "section_id", "segment_ordinal", "start_ms", "end_ms", "output_language",
    "title_text", "body_text", "aux_text",
)
KINDS = {"transcript_id": "long", "section_id": "long", "segment_ordinal": "int", "start_ms": "long", "end_ms": "long"}


def _documents(df: DataFrame, **parts: Column) -> DataFrame:
    cols = [parts[c].cast(KINDS.get(c, "string")).alias(c) if c in parts else F.lit(None).cast(KINDS.get(c, "string")).alias(c) for c in FIELDS]
    out = df.select(*cols).withColumns({c: F.coalesce(c, F.lit("")) for c in ("title_text", "body_text", "aux_text")})
    return out.withColumn("content_hash", content_hash([F.col(c).cast("string") for c in FIELDS])).withColumn("index_version", F.lit(INDEX_VERSION))


def documents_from_segments(segments: DataFrame) -> DataFrame:
    """A search document for each segment that is not blank."""
    s = segments.filter(strip(F.coalesce("text", F.lit(""))) != "")
    key = F.concat(F.lit("segment:"), F.col("transcript_id").cast("string"), F.lit(":"), F.col("ordinal").cast("string"))
    times = {c: F.col(c) for c in ("start_ms", "end_ms") if c in segments.columns}
    return _documents(
        s, document_key=key, doc_type=F.lit("segment"), recording_id=F.col("recording_id"), transcript_id=F.col("transcript_id"), segment_ordinal=F.col("ordinal"),
        body_text=F.col("text"), aux_text=F.col("speaker"), **times,
    )


def documents_from_recordings(recordings: DataFrame, title: Column, names: Column | None = None) -> DataFrame:
    """A metadata document for each recording; names (an array) are its file names."""
    return _documents(
        recordings, document_key=F.concat(F.lit("recording:"), F.col("recording_id").cast("string")), doc_type=F.lit("recording"), recording_id=F.col("recording_id"),
        title_text=title, aux_text=F.lit("") if names is None else join_nonblank(names),
    )


def documents_from_summaries(summaries: DataFrame) -> DataFrame:
    """A document for each summary (summary_id, recording_id, language, title, body, aux; transcript_id and section_id where they are known)."""
    more = {c: F.col(c) for c in ("transcript_id", "section_id") if c in summaries.columns}
    return _documents(
        summaries, document_key=F.concat(F.lit("summary:"), F.col("summary_id").cast("string")), doc_type=F.lit("summary"), recording_id=F.col("recording_id"),
        summary_id=F.col("summary_id"), output_language=F.col("language"), title_text=F.col("title"), body_text=F.col("body"), aux_text=F.col("aux"), **more,
    )


def build_documents(recordings: DataFrame, titles: DataFrame, names: DataFrame, transcripts: DataFrame, segments: DataFrame, summaries: DataFrame, valid_sections: DataFrame) -> DataFrame:
    """All documents that the library's tables call for.

    Segments of active transcripts, one document a recording, active summaries of whole recordings and of valid
    sections. transcripts: recording_id, transcript_id, is_active; summaries: from which documents_from_summaries()
    reads, with is_active; valid_sections: section_id.
    """
    live = transcripts.filter("is_active").select("transcript_id")
    said = documents_from_segments(segments.join(live, "transcript_id", "left_semi"))
    named = recordings.select("recording_id").join(titles, "recording_id", "left").join(names, "recording_id", "left")
    meta = documents_from_recordings(named, F.col("title"), F.coalesce("filenames", F.array().cast("array<string>")))
    held = summaries.filter("is_active").join(live, "transcript_id", "left_semi")
    whole = held.filter("section_id is null")
    parts = held.join(valid_sections.select("section_id"), "section_id", "left_semi").select(*held.columns)
    return said.unionByName(meta).unionByName(documents_from_summaries(whole.unionByName(parts)))


def document_items(documents: DataFrame, valid: DataFrame, sections: DataFrame) -> DataFrame:
    """documents with item_key: `r:` and the recording where its transcript is not split, the section that a segment or summary belongs to where it is, else null.

    valid: recording_id and transcript_id of validly split transcripts; sections: their sections.
    """
    split = valid.select(F.col("recording_id").alias("_r"), F.lit(True).alias("_split")).distinct()
    s = sections.join(valid.select("transcript_id"), "transcript_id", "left_semi").select("transcript_id", F.col("start_ordinal").alias("lo"), F.col("end_ordinal").alias("hi"), F.col("section_id").alias("id"))
    d = documents.join(split, F.col("recording_id") == F.col("_r"), "left")
    d = covering(d, s, "transcript_id", "segment_ordinal", "_s")
    own = s.select(F.col("id").alias("_o"))
    d = d.join(own, F.col("section_id") == F.col("_o"), "left")
    key = F.when(F.col("_split").isNull(), F.concat(F.lit("r:"), F.col("recording_id"))).otherwise(F.concat(F.lit("s:"), F.coalesce("_s", "_o").cast("string")))
    return d.withColumn("item_key", key).select(*documents.columns, "item_key")


def provenance_faults(documents: DataFrame, expected: DataFrame) -> DataFrame:
    """document_key and fault of stored documents whose recording, transcript, section or language no longer is what live data say, or that live data do not know."""
    on = ("recording_id", "transcript_id", "section_id", "output_language")
    live = expected.select("document_key", *[F.col(c).alias(f"_{c}") for c in on], F.lit(True).alias("_known"))
    d = documents.select("document_key", *on).join(live, "document_key", "left")
    fault = F.when(F.col("_known").isNull(), "orphan")
    for c in on:
        fault = fault.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"other_{c}")
    return d.select("document_key", fault.alias("fault")).filter("fault is not null")


def index_differences(expected: DataFrame, registry: DataFrame, index: DataFrame) -> DataFrame:
    """document_key and category of every fault among expected documents, registry rows and index rows.

    expected, registry: document_key, content_hash, index_version; index: document_key, content_hash.
    A version mismatch hides the later checks of its key.
    """
    e = expected.select("document_key", F.col("content_hash").alias("e"), F.col("index_version").alias("ev"))
    r = registry.select("document_key", F.col("content_hash").alias("r"), F.col("index_version").alias("rv"))
    i = index.select("document_key", F.col("content_hash").alias("i"))
    both = e.join(r, "document_key", "full_outer").join(i, "document_key", "full_outer")
    has = lambda c: F.col(c).isNotNull()
    other = has("e") & has("r") & (F.col("ev") != F.col("rv"))
    faults = F.array_compact(F.array(
        F.when(has("e") & ~has("r"), "missing_from_registry"), F.when(other, "version_mismatch"),
        F.when(~other & has("e") & has("r") & (F.col("e") != F.col("r")), "stale_content"), F.when(~other & has("r") & ~has("i"), "missing_from_index"),
        F.when(~other & has("r") & has("i") & (F.col("r") != F.col("i")), "content_mismatch"), F.when(~has("e") & has("r"), "orphan_document"), F.when(~has("r") & has("i"), "orphan_index_row"),
    ))
    return both.select("document_key", F.explode(faults).alias("category"))


def index_report(faults: DataFrame, samples: int = 20) -> DataFrame:
    """category, n, the smallest sample keys and how many keys are not shown; a row `healthy` alone if there are no faults.

    Keys are cut to the samples before they are gathered.
    """
    n = faults.groupBy("category").agg(F.count("*").alias("n"))
    few = faults.withColumn("at", F.row_number().over(Window.partitionBy("category").orderBy("document_key"))).filter(F.col("at") <= samples)
    found = n.join(few.groupBy("category").agg(F.array_sort(F.collect_list("document_key")).alias("samples")), "category")
    found = found.select("category", "n", "samples", F.greatest(F.col("n") - samples, F.lit(0)).alias("omitted"))
    well = faults.sparkSession.range(1).select(F.lit("healthy").alias("category"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("samples"), F.lit(0).cast("long").alias("omitted"))
    return found.unionByName(well.join(n.select("category").limit(1).withColumnRenamed("category", "_any"), F.lit(True), "left_anti"))


def sync_plan(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """document_key and action (insert, update, delete, skip) that bring stored documents to the expected ones."""
    e, s = expected.select("document_key", F.col("content_hash").alias("e")), stored.select("document_key", F.col("content_hash").alias("s"))
    action = F.when(F.col("s").isNull(), "insert").when(F.col("e").isNull(), "delete").when(F.col("e") != F.col("s"), "update").otherwise("skip")
    return e.join(s, "document_key", "full_outer").select("document_key", action.alias("action"))


def apply_sync(expected: DataFrame, stored: DataFrame, touched: DataFrame) -> DataFrame:
    """stored with the documents of touched recordings replaced by the expected ones; applying it twice changes nothing."""
    kept = stored.join(touched, "recording_id", "left_anti").select(*stored.columns)
    return kept.unionByName(expected.join(touched, "recording_id", "left_semi").select(*stored.columns))


def removed_keys(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """document_key of documents that touched recordings had before a sync and no longer have: their vectors go too."""
    own = before.join(touched, "recording_id", "left_semi").select("document_key").distinct()
    return own.join(after.select("document_key"), "document_key", "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """missing (rows of a that b lacks) and extra (rows of b that a lacks) for two sets of (document_key, content_hash), from one full join."""
    both = a.select("document_key", "content_hash", F.lit(True).alias("_a")).join(b.select("document_key", "content_hash", F.lit(True).alias("_b")), ["document_key", "content_hash"], "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"))


def set_digest(documents: DataFrame, buckets: int = 256) -> DataFrame:
    """bucket, n, total and mix: count, sum and exclusive or of 60-bit hashes of the (document_key, content_hash) frames.

    Equal sets have equal digests whatever their order; sums combine before the shuffle, so no bucket is gathered.
    """
    hashed = F.sha2(F.concat_ws("|", "document_key", "content_hash"), 256)
    number = F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")
    d = documents.select(number.alias("h"))
    return d.groupBy((F.col("h") % buckets).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor("h").alias("mix"))
