"""Sources: content identity, snapshot reconciliation, transcript parsing and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.text import fold
from voxlake.functions.variants import is_kind, whole_json
from voxlake.operators.scans import running

#: A start may lie this far before the greatest start so far.
REGRESS_MS = 2000


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("wav", "mp3", "m4a")) -> DataFrame:
    """path, path_identity (case-folded), length, modified_at and sha256 of every file below root with one of the extensions, one an identity, in its order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions)
    found = files.filter(wanted).select("path", fold("path").alias("path_identity"), "length", F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"))
    return found.groupBy("path_identity").agg(F.min_by(F.struct("path", "length", "modified_at", "sha256"), "path").alias("f")).select("f.path", "path_identity", "f.length", "f.modified_at", "f.sha256").orderBy("path_identity")


def deduplicate_content(files: DataFrame, order: str) -> DataFrame:
    """files (content columns and sha256) with state: hashed for the first of each content by `order`, else duplicate.

    The first is found by a map-side combined minimum, so a content with a third of all rows costs one row a task.
    """
    first = files.groupBy("sha256").agg(F.min(order).alias("_first"), F.count("*").alias("n_sources"))
    return files.join(first, "sha256").withColumn("state", F.when(F.col(order) == F.col("_first"), "hashed").otherwise("duplicate")).drop("_first")


def reconcile_sources(before: DataFrame, now: DataFrame, key: str, version: str) -> DataFrame:
    """Every key of two listings with change: new, missing, changed or unchanged."""
    b, n = before.select(F.col(key), F.col(version).alias("_b")), now.select(F.col(key), F.col(version).alias("_n"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_n").isNull(), "missing").when(F.col("_b") != F.col("_n"), "changed").otherwise("unchanged")
    return b.join(n, key, "full_outer").select(key, change.alias("change"))


def recorded_at(name: Column, zone: str = "UTC") -> Column:
    """Time in a file name like 2024-05-17 093015 (separators -_.T or none), taken in a zone; null if there is none or it is no time."""
    shape = r"(20\d{2})[-_.]?(\d{2})[-_.]?(\d{2})(?:[-_.T ]?(\d{2})(\d{2})(\d{2})?)?"
    part = lambda k: F.regexp_extract(name, shape, k)
    some = lambda k: F.when(part(k) == "", "00").otherwise(part(k))
    text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), some(4), F.lit(":"), some(5), F.lit(":"), some(6))
    return F.when(name.rlike(shape), F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), zone))


def parse_envelopes(files: DataFrame) -> DataFrame:
    """file_id, category, text and segments (ARRAY<VARIANT>) of transcript files (file_id, raw).

    category: malformed_json for what is no single JSON value (trailing text and repeated keys included), invalid_envelope for
    one that is no object with a string `text` and an array `segments`, else null. Types decide, nothing is converted.
    """
    v = files.select("file_id", whole_json(F.col("raw")).alias("v"))
    text, segments = F.try_variant_get("v", "$.text", "variant"), F.try_variant_get("v", "$.segments", "array<variant>")
    v = v.select("file_id", F.col("v").isNull().alias("bad"), text.alias("text"), segments.alias("segments"))
    category = F.when(F.col("bad"), "malformed_json").when(F.col("segments").isNull() | ~F.coalesce(is_kind(F.col("text"), "STRING"), F.lit(False)), "invalid_envelope")
    return v.select("file_id", category.alias("category"), F.when(category.isNull(), F.try_variant_get("text", "$", "string")).alias("text"), F.when(category.isNull(), F.col("segments")).alias("segments"))


def parse_transcripts(files: DataFrame) -> DataFrame:
    """file_id, ordinal, start_ms, end_ms, speaker, text, category and regression of every segment of files (file_id, raw).

    category is null for a good segment, else its first failing rule; a file with a broken envelope gives one row with a
    null ordinal, one without segments none (parse_envelopes() has it). An absent or null start, end or speaker is no fault.
    """
    rows = parse_envelopes(files).select("file_id", F.col("category").alias("broken"), F.posexplode_outer("segments").alias("ordinal", "s")).filter("broken is not null or ordinal is not null")
    field = lambda c: F.try_variant_get("s", f"$.{c}", "variant")
    absent = lambda c: F.coalesce(is_kind(F.col(c), "VOID"), F.lit(True))
    rows = rows.select("file_id", "broken", "ordinal", F.try_variant_get("s", "$", "map<string, variant>").isNull().alias("no_item"), *(field(c).alias(c) for c in ("start", "end", "speaker", "text")))
    number = lambda c: F.when(is_kind(F.col(c), "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(c, "$", "double"))
    odd = lambda c: ~absent(c) & F.coalesce(_odd_time(number(c)), F.lit(True))
    is_text = lambda c: F.coalesce(is_kind(F.col(c), "STRING"), F.lit(False))
    shape = (
        F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("no_item"), "invalid_segment_item").when(~is_text("text"), "invalid_segment_text")
        .when(~absent("speaker") & ~is_text("speaker"), "invalid_segment_speaker").when(odd("start") | odd("end"), "invalid_timestamp")
    )
    said = lambda c: F.when(is_text(c), F.try_variant_get(c, "$", "string"))
    return segment_faults(rows.select("file_id", "ordinal", number("start").alias("start_ms"), number("end").alias("end_ms"), F.when(~F.col("no_item"), F.coalesce(said("speaker"), F.lit(""))).alias("speaker"), said("text").alias("text"), shape.alias("shape")))


WORDS_JSON = "segments array<struct<words: array<struct<start: double, end: double, text: string>>>>"


def parse_words(files: DataFrame) -> DataFrame:
    """file_id, ordinal, word_no, start_ms, end_ms and text of the words that transcript files (file_id, raw) hold beside their segments."""
    j = files.select("file_id", F.from_json("raw", WORDS_JSON).alias("j")).select("file_id", F.posexplode("j.segments").alias("ordinal", "s"))
    w = j.select("file_id", "ordinal", F.posexplode("s.words").alias("word_no", "w"))
    return w.select("file_id", "ordinal", "word_no", F.col("w.start").cast("long").alias("start_ms"), F.col("w.end").cast("long").alias("end_ms"), F.col("w.text").alias("text"))


def _odd_time(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0)


def segment_faults(rows: DataFrame) -> DataFrame:
    """file_id, ordinal, start_ms, end_ms, speaker, text, category and regression of flat segment rows; shape, if there is such a column, is a fault that was found before.

    The greatest start so far is a two-level scan over blocks of ordinals, so a file with a third of all segments is many groups.
    regression is regress_bucket() of a start that lies too far back.
    """
    start, end = F.col("start_ms").cast("double"), F.col("end_ms").cast("double")
    whole = F.when(~_odd_time(start), start.cast("long"))
    shape = F.col("shape") if "shape" in rows.columns else F.when(F.col("text").isNull(), "invalid_segment_text")
    rows = rows.withColumns({"_start": whole, "_shape": shape})
    placed = running(rows.filter("ordinal is not null"), "file_id", "ordinal", {"_top": F.max("_start")})
    if "shape" in rows.columns:
        placed = placed.unionByName(rows.filter("ordinal is null").withColumn("_top", F.lit(None).cast("long")))
    later = F.when(_odd_time(start) | _odd_time(end), "invalid_timestamp").when(end < start, "end_before_start").when(F.col("_start") < F.col("_top") - REGRESS_MS, "non_monotonic_start")
    category = F.coalesce("_shape", later)
    regression = F.when(category == "non_monotonic_start", regress_bucket(F.col("_top") - F.col("_start")))
    return placed.select("file_id", "ordinal", whole.alias("start_ms"), F.when(~_odd_time(end), end.cast("long")).alias("end_ms"), "speaker", "text", category.alias("category"), regression.alias("regression"))


def regress_bucket(ms: Column) -> Column:
    """How far a start lies before the greatest one so far, as a report shows it."""
    return F.when(ms > 5000, "over_5000_ms").when(ms > REGRESS_MS, "2001_5000_ms")


def quarantine(segments: DataFrame) -> DataFrame:
    """file_id, category, ordinal and regression of the first failing segment of each failing file."""
    bad = segments.filter("category is not null")
    first = bad.groupBy("file_id").agg(F.min_by(F.struct("category", "ordinal", "regression"), F.coalesce("ordinal", F.lit(-1))).alias("f"))
    return first.select("file_id", "f.category", "f.ordinal", "f.regression")


def timestamped_lines(segments: DataFrame) -> DataFrame:
    """recording_id, ordinal and line `[mm:ss] speaker: text`: a null start counts as 0, minutes go beyond 59."""
    ms = F.coalesce("start_ms", F.lit(0))
    clock = F.concat(F.lit("["), F.lpad(F.floor(ms / 60000).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit("] "))
    speaker = F.when(F.trim(F.coalesce("speaker", F.lit(""))) != "", F.concat(F.col("speaker"), F.lit(": "))).otherwise("")
    return segments.select("recording_id", "ordinal", F.concat(clock, speaker, F.coalesce("text", F.lit(""))).alias("line"))


#: Lines of a part of an export: a part is what one row of the result holds.
EXPORT_LINES = 5000


def export_text(lines: DataFrame, column: str, rows: int = EXPORT_LINES) -> DataFrame:
    """recording_id, part and body: a recording's lines in order, one below the other, `rows` ordinals a part.

    Parts follow each other and are joined by a line end; a long recording is many bounded rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", column)))
    part = F.floor(F.col("ordinal") / rows).cast("int").alias("part")
    return lines.groupBy("recording_id", part).agg(F.array_join(F.transform(ordered, lambda x: x[column]), "\n").alias("body"))
