"""Library operators: layout validity, items, filters, listing, status and review reports, histories, tags."""

from __future__ import annotations

import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from voxlake.operators.scans import covering


def title_fault(title: Column) -> Column:
    """blank_title, long_title or control_character; null for a good section title."""
    from voxlake.functions.text import strip

    return F.when(title.isNull() | (strip(title) == ""), "blank_title").when(F.length(title) > 255, "long_title").when(title.rlike(r"[\x00-\x1f\x7f]"), "control_character")


def valid_layouts(layouts: DataFrame, sections: DataFrame) -> DataFrame:
    """transcript_id, valid and n_sections of layouts (transcript_id, is_active, start_ordinal, end_ordinal).

    Valid: active; 2 to 200 sections with ordinals 1..N, good titles (title_fault()), temporary ones as
    `Segment <ordinal> of <12 digits>`, non-empty ranges that follow each other from the layout's start
    to its end. With transcript_active and n columns the transcript must be active and hold the range.
    """
    w = Window.partitionBy("transcript_id").orderBy("ordinal")
    s = sections.withColumn("before", F.lag("end_ordinal").over(w)).withColumn("at", F.row_number().over(w))
    more = [F.col(c).alias(a) for c, a in (("transcript_active", "transcript_active"), ("n", "n_segments")) if c in layouts.columns]
    s = s.join(layouts.select("transcript_id", "is_active", F.col("start_ordinal").alias("lo"), F.col("end_ordinal").alias("hi"), *more), "transcript_id")
    good = (
        (F.col("ordinal") == F.col("at")) & (F.col("start_ordinal") == F.coalesce("before", "lo")) & (F.col("start_ordinal") < F.col("end_ordinal"))
        & title_fault(F.col("title")).isNull() & F.col("is_active")
    )
    if "title_is_temporary" in sections.columns:
        good = good & (~F.col("title_is_temporary") | F.col("title").rlike(r"^Segment \d+ of \d{12}$") & (F.split_part("title", F.lit(" "), F.lit(2)) == F.col("ordinal").cast("string")))
    for c, rule in (("transcript_active", F.col("transcript_active")), ("n", (F.col("lo") >= 0) & (F.col("hi") <= F.col("n_segments")))):
        if c in layouts.columns:
            good = good & rule
    found = s.groupBy("transcript_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("rows_good"), F.count("*").alias("n_sections"), F.max("end_ordinal").alias("last"), F.max("hi").alias("hi"))
    found = found.withColumn("valid", F.col("rows_good") & F.col("n_sections").between(2, 200) & (F.col("last") == F.col("hi")))
    out = layouts.select("transcript_id").join(found.select("transcript_id", "valid", "n_sections"), "transcript_id", "left")
    return out.select("transcript_id", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("n_sections", F.lit(0).cast("long")).alias("n_sections"))


def segment_items(segments: DataFrame, layouts: DataFrame, sections: DataFrame) -> DataFrame:
    """transcript_id, ordinal and item_key: `s:<section>` inside a valid split, `r:<recording>` without one, null between sections."""
    valid = valid_layouts(layouts, sections).filter("valid").select("transcript_id")
    live = sections.join(valid, "transcript_id", "left_semi").select("transcript_id", F.col("start_ordinal").alias("lo"), F.col("end_ordinal").alias("hi"), F.col("section_id").alias("id"))
    placed = covering(segments.select("transcript_id", "ordinal", "recording_id"), live, "transcript_id", "ordinal", "section_id")
    placed = placed.join(valid.withColumn("split", F.lit(True)), "transcript_id", "left")
    key = F.when(F.col("split").isNull(), F.concat(F.lit("r:"), "recording_id")).when(F.col("section_id").isNotNull(), F.concat(F.lit("s:"), F.col("section_id").cast("string")))
    return placed.select("transcript_id", "ordinal", key.alias("item_key"))


def section_durations(segments: DataFrame, sections: DataFrame) -> DataFrame:
    """section_id and duration in seconds from first start to last end of its segments; null unless positive. Sections of a transcript do not overlap."""
    spans = sections.select("transcript_id", F.col("start_ordinal").alias("lo"), F.col("end_ordinal").alias("hi"), F.col("section_id").alias("id"))
    held = covering(segments.select("transcript_id", "ordinal", "start_ms", "end_ms"), spans, "transcript_id", "ordinal", "section_id")
    d = held.filter("section_id is not null").groupBy("section_id").agg(((F.max("end_ms") - F.min("start_ms")) / 1000).alias("d"))
    return sections.select("section_id").join(d, "section_id", "left").select("section_id", F.when(F.col("d") > 0, F.col("d")).alias("duration"))


def local_day_bounds(day: str, zone: str) -> tuple[Column, Column]:
    """Half-open UTC bounds of a local calendar day, whatever the session's zone is."""
    first = datetime.date.fromisoformat(day)
    at = lambda d: F.lit(datetime.datetime.combine(d, datetime.time(), ZoneInfo(zone)).astimezone(datetime.timezone.utc).isoformat()).cast("timestamp")
    return at(first), at(first + datetime.timedelta(days=1))


def library_filter(items: DataFrame, *, since: Column | None = None, until: Column | None = None, statuses: tuple[str, ...] = (), review: bool = False, tags: DataFrame | None = None, every_tag: int = 0) -> DataFrame:
    """items after the given conditions, all optional and joined by AND.

    tags: (recording_id, tag) rows of the wanted tags; with every_tag an item needs that many distinct
    ones, else any. Pushes plain conditions below the semi join.
    """
    if since is not None:
        items = items.filter(F.col("recorded_at") >= since)
    if until is not None:
        items = items.filter(F.col("recorded_at") < until)
    if statuses:
        items = items.filter(F.col("processing_status").isin(*statuses))
    if review:
        items = items.filter(needs_review())
    if tags is not None:
        if every_tag:
            tags = tags.groupBy("recording_id").agg(F.countDistinct("tag").alias("n")).filter(F.col("n") >= every_tag)
        items = items.join(tags.select("recording_id"), "recording_id", "left_semi")
    return items


def needs_review() -> Column:
    return F.col("processing_status").isin("needs_review", "failed")


def page(items: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page in a total order."""
    return items.orderBy(*order).offset((number - 1) * size).limit(size)


def month_label(ts: Column, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "MMMM yyyy")


def status_counts(items: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Count of every known status, zeros included."""
    known = items.sparkSession.createDataFrame([(s,) for s in statuses], "processing_status string")
    found = items.groupBy("processing_status").agg(F.count("*").alias("n"))
    return F.broadcast(known).join(found, "processing_status", "left").select("processing_status", F.coalesce("n", F.lit(0)).alias("n"))


def _reviewable(recordings: DataFrame, split: DataFrame | None) -> tuple[DataFrame, Column]:
    """Recordings that are not archived, and whether one awaits its first summary: a recording whose sections stand in its place (split: recording_id) does not."""
    rows = recordings.filter("archived_at is null")
    if split is None:
        rows = rows.withColumn("_split", F.lit(False))
    else:
        rows = rows.join(split.select("recording_id", F.lit(True).alias("_split")).distinct(), "recording_id", "left").withColumn("_split", F.coalesce("_split", F.lit(False)))
    return rows, (F.col("processing_status") == "transcribed") & (F.col("summary_status") == "missing") & ~F.col("_split")


def review_kinds(recordings: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """recording_id and kind, a row for each review category that a recording (not archived) is in, from one scan."""
    rows, awaiting = _reviewable(recordings, split)
    status, summary = F.col("processing_status"), F.col("summary_status")
    kinds = [
        F.when(status == "needs_review", "needs_review_before_transcription"), F.when((status == "transcribed") & F.col("retranscription_failed"), "failed_retranscription"),
        F.when(status == "failed", F.concat(F.lit("failed_"), F.coalesce("failure_stage", F.lit("unknown")))), F.when(awaiting, "awaiting_summary"),
        F.when(summary == "failed", "failed_summary"), F.when(F.col("resummarization_failed"), "failed_resummarization"), F.when(F.col("audio_status") == "missing", "missing_audio"),
    ]
    return rows.select("recording_id", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def review_badge(recordings: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """One row, badge: recordings (not archived) that ask for attention in any way, each counted once, without a shuffle of them."""
    rows, awaiting = _reviewable(recordings, split)
    status = F.col("processing_status")
    asks = status.isin("needs_review", "failed") | F.col("retranscription_failed") | F.col("resummarization_failed") | (F.col("summary_status") == "failed") | awaiting | (F.col("audio_status") == "missing")
    return rows.agg(F.count_if(F.coalesce(asks, F.lit(False))).alias("badge"))


def summary_counts(recordings: DataFrame) -> DataFrame:
    """One row: recordings that await a summary, failed at it, have one, failed at a second one, or at a second transcription."""
    status, summary = F.col("processing_status"), F.col("summary_status")
    done, again = status == "transcribed", F.col("resummarization_failed")
    return recordings.agg(
        F.count_if(done & (summary == "missing")).alias("awaiting_summary"), F.count_if(summary == "failed").alias("summary_failed"), F.count_if(done & (summary == "current") & ~again).alias("summarized"),
        F.count_if(again).alias("failed_resummarization"), F.count_if(done & F.col("retranscription_failed")).alias("failed_retranscriptions"),
    )


def recent_errors(attempts: DataFrame, limit: int = 20) -> DataFrame:
    """The newest attempts with an error code."""
    return attempts.filter(F.coalesce("error_code", F.lit("")) != "").orderBy(F.desc("started_at"), F.desc("attempt_id")).limit(limit).select("attempt_id", "recording_id", "stage", "error_code", "started_at")


def status_report(recordings: DataFrame, attempts: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """section, name and n: counts of all statuses, the summary counts, failures by stage, recent errors by stage and code."""
    row = lambda df, s, name, n: df.select(F.lit(s).alias("section"), name.alias("name"), n.alias("n"))
    counts = row(status_counts(recordings, statuses), "status", F.col("processing_status"), F.col("n"))
    five = summary_counts(recordings)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in five.columns])).alias("p")
    summary = row(five.select(pairs), "summary", F.col("p.name"), F.col("p.n"))
    failed = recordings.filter("processing_status = 'failed'").groupBy(F.coalesce("failure_stage", F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))
    errors = recent_errors(attempts).groupBy(F.concat_ws("/", "stage", "error_code").alias("name")).agg(F.count("*").alias("n"))
    return counts.unionByName(summary).unionByName(row(failed, "failure", F.col("stage"), F.col("n"))).unionByName(row(errors, "recent_error", F.col("name"), F.col("n")))


def attempt_state(attempts: DataFrame) -> DataFrame:
    """One row a recording: finished and unfinished counts, last finished outcome, number of attempts."""
    return attempts.groupBy("recording_id").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "success").alias("succeeded"),
        F.count_if(F.col("outcome").isNull()).alias("unfinished"),
        F.max_by("outcome", F.when(F.col("outcome").isNotNull(), F.col("ordinal"))).alias("last_outcome"),
    )


def newest(rows: DataFrame, scope: str, order: list[Column], limit: int) -> DataFrame:
    """The newest rows of each scope and whether it has more."""
    w = Window.partitionBy(scope)
    ranked = rows.withColumn("at", F.row_number().over(w.orderBy(*order)))
    ranked = ranked.filter(F.col("at") <= limit + 1)
    return ranked.withColumn("truncated", F.max("at").over(w) > limit).filter(F.col("at") <= limit)


def illegal_transitions(log: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """Steps of a status log (recording_id, ordinal, status) that no edge allows."""
    allowed = log.sparkSession.createDataFrame(edges, "before string, status string")
    step = log.withColumn("before", F.lag("status").over(Window.partitionBy("recording_id").orderBy("ordinal"))).filter("before is not null and before <> status")
    return step.join(F.broadcast(allowed), ["before", "status"], "left_anti").select("recording_id", "ordinal", "before", "status")


def duplicate_active(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Scopes with more than one active row."""
    return rows.filter("is_active").groupBy(*scope).agg(F.count("*").alias("n")).filter("n > 1")


def tag_overview(tags: DataFrame, assignments: DataFrame) -> DataFrame:
    """tag, total and active assignments; tags without any show zeros."""
    counts = assignments.groupBy("tag").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))
    return tags.join(counts, "tag", "left").select("tag", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("active", F.lit(0)).alias("active"))


def materialise_tags(suggested: DataFrame, current: DataFrame) -> DataFrame:
    """item, tag and action for suggestions against assignments (item, tag, origin, is_active, deactivated_by).

    Only rows of origin `suggested` follow the model; what a user set or removed stays.
    """
    both = suggested.select("item", "tag", F.lit(True).alias("wanted")).join(current, ["item", "tag"], "full_outer")
    own = F.col("origin") == "suggested"
    action = (
        F.when(F.col("origin").isNull(), "create").when(F.col("is_active") & own & F.col("wanted"), "refresh").when(F.col("is_active") & own, "deactivate")
        .when(~F.col("is_active") & (F.col("deactivated_by") == "model") & F.col("wanted"), "reactivate").otherwise("keep")
    )
    return both.select("item", "tag", action.alias("action"))


def select_tags(desired: DataFrame, current: DataFrame) -> DataFrame:
    """item, tag and action for a user's full selection against assignments (item, tag, is_active)."""
    both = desired.select("item", "tag", F.lit(True).alias("wanted")).join(current, ["item", "tag"], "full_outer")
    action = (
        F.when(F.col("is_active").isNull(), "create").when(~F.col("is_active") & F.col("wanted"), "reactivate").when(F.col("is_active") & F.col("wanted").isNull(), "suppress").otherwise("unchanged")
    )
    return both.select("item", "tag", action.alias("action"))


def sync_tags(configured: DataFrame, known: DataFrame) -> DataFrame:
    """name_key and changes (an array) for configured tags (name_key, description) against known ones (name_key, description, is_configured, origin)."""
    c = configured.select("name_key", F.col("description").alias("want"), F.lit(True).alias("listed"))
    both = c.join(known, "name_key", "full_outer")
    changes = F.array_compact(F.array(
        F.when(F.col("origin").isNull(), "created"), F.when(F.col("listed") & ~F.col("is_configured"), "reactivated"), F.when(F.col("listed") & (F.col("origin") == "custom"), "promoted"),
        F.when(F.col("listed") & F.col("origin").isNotNull() & ~F.col("want").eqNullSafe(F.col("description")), "updated"),
        F.when(F.col("listed").isNull() & F.col("is_configured") & (F.col("origin") == "config"), "retired"),
    ))
    return both.select("name_key", F.array_join(changes, ",").alias("changes"))


def tag_sync_counts(changes: DataFrame) -> DataFrame:
    """One row: how many tags of sync_tags() were created, updated, retired, reactivated and promoted; one may count several times."""
    kinds = ("created", "updated", "retired", "reactivated", "promoted")
    return changes.agg(*[F.count_if(F.array_contains(F.split("changes", ","), k)).alias(k) for k in kinds])


def kept_names(configured: DataFrame, known: DataFrame) -> DataFrame:
    """name_key and display name after a sync: a known tag keeps its first name, unless it was a custom one that is configured now.

    configured: name_key, name; known: name_key, name, origin.
    """
    c = configured.groupBy("name_key").agg(F.min("name").alias("_c"))
    both = c.join(known.select("name_key", F.col("name").alias("_k"), "origin"), "name_key", "full_outer")
    taken = F.when(F.col("_k").isNull() | ((F.col("origin") == "custom") & F.col("_c").isNotNull()), F.col("_c")).otherwise(F.col("_k"))
    return both.select("name_key", taken.alias("name"))


def eligible(recordings: DataFrame, stage: str) -> DataFrame:
    """Recordings that a stage takes: route (being routed), transcribe (ready), summarise (transcribed, no summary); archived ones never."""
    conditions = {"route": F.col("processing_status") == "routing", "transcribe": F.col("processing_status") == "ready_to_transcribe", "summarise": (F.col("processing_status") == "transcribed") & (F.col("summary_status") == "missing")}
    if stage not in conditions:
        raise ValueError(f"stage is one of {sorted(conditions)}")
    return recordings.filter(F.col("archived_at").isNull() & conditions[stage])


def version_counts(layouts: DataFrame, sections: DataFrame, segments: DataFrame) -> DataFrame:
    """transcript_id, segment_count and topic_count of each layout; zeros where there are none."""
    n = segments.groupBy("transcript_id").agg(F.count("*").alias("segment_count"))
    k = sections.groupBy("transcript_id").agg(F.count("*").alias("topic_count"))
    out = layouts.select("transcript_id").join(n, "transcript_id", "left").join(k, "transcript_id", "left")
    return out.select("transcript_id", F.coalesce("segment_count", F.lit(0)).alias("segment_count"), F.coalesce("topic_count", F.lit(0)).alias("topic_count"))


VARIANT = ["recording_id", "transcript_id", "section_id", "language"]
#: Outcomes of a summary attempt that count as its failure.
FAILED = ("failed", "interrupted")


def section_variant_states(variants: DataFrame, summaries: DataFrame, attempts: DataFrame) -> DataFrame:
    """VARIANT, state, regeneration_failed and failed_at of variants (VARIANT): from active summaries (VARIANT, ordinal of the attempt) and attempts.

    attempts: VARIANT, stage, ordinal, outcome, finished. Only finished attempts of stage summarization with a failing outcome and the very same
    transcript, section and language count, and beside a summary only newer ones. failed_at is the newest such attempt.
    """
    bad = attempts.filter((F.col("stage") == "summarization") & F.col("finished") & F.col("outcome").isin(*FAILED))
    f = bad.groupBy(*VARIANT).agg(F.max("ordinal").alias("f_at"))
    s = summaries.groupBy(*VARIANT).agg(F.max("ordinal").alias("s_at"))
    out = variants.select(*VARIANT).join(s, VARIANT, "left").join(f, VARIANT, "left")
    state = F.when(F.col("s_at").isNotNull(), "current").when(F.col("f_at").isNotNull(), "failed").otherwise("missing")
    newer = F.when(F.col("s_at").isNull() | (F.col("f_at") > F.col("s_at")), F.col("f_at"))
    return out.select(*VARIANT, state.alias("state"), (F.col("s_at").isNotNull() & newer.isNotNull()).alias("regeneration_failed"), newer.alias("failed_at"))


def rolled_up(states: DataFrame, transcripts: DataFrame) -> DataFrame:
    """recording_id, summary_status and resummarization_failed: the state of section 0 in the default language of each active transcript; not_ready without a transcript.

    transcripts: recording_id, transcript_id (null without one), default_language.
    """
    whole = states.filter("section_id = 0").select("recording_id", "transcript_id", F.col("language").alias("default_language"), "state", "regeneration_failed")
    out = transcripts.join(whole, ["recording_id", "transcript_id", "default_language"], "left")
    status = F.when(F.col("transcript_id").isNull(), "not_ready").otherwise(F.coalesce("state", F.lit("missing")))
    return out.select("recording_id", status.alias("summary_status"), F.coalesce("regeneration_failed", F.lit(False)).alias("resummarization_failed"))


def variant_states(variants: DataFrame, summaries: DataFrame, failures: DataFrame) -> DataFrame:
    """state and regeneration_failed of variants (recording_id, language): current with a summary, failed with a failure alone, else missing.

    summaries: (recording_id, language, ordinal of its attempt); failures: (recording_id, language, ordinal).
    """
    keys = ["recording_id", "language"]
    s = summaries.groupBy(*keys).agg(F.max("ordinal").alias("s_at"))
    f = failures.groupBy(*keys).agg(F.max("ordinal").alias("f_at"))
    out = variants.join(s, keys, "left").join(f, keys, "left")
    state = F.when(F.col("s_at").isNotNull(), "current").when(F.col("f_at").isNotNull(), "failed").otherwise("missing")
    return out.select(*keys, state.alias("state"), F.coalesce(F.col("f_at") > F.col("s_at"), F.lit(False)).alias("regeneration_failed"))


def resolve_output(selector: str) -> Column:
    """The language that a selector (default, original, en, zh-Hant) means for a transcript row; empty for the original of an unknown source."""
    from voxlake.functions.text import original_language

    if selector not in ("default", "original", "en", "zh-Hant"):
        raise ValueError(f"unsupported language target: {selector}")
    return default_language() if selector == "default" else original_language(F.col("observed")) if selector == "original" else F.lit(selector)


def default_language() -> Column:
    """Language of a transcript's default summary: the user's word first, then routing, then what was observed."""
    from voxlake.functions.text import output_language

    seen = F.coalesce("observed", F.lit(""))
    return (
        F.when((seen != "") & (F.col("verified_by") == "user"), output_language(F.col("observed"))).when(F.col("route").isin("cantonese", "mandarin"), "zh-Hant")
        .when(seen != "", output_language(F.col("observed"))).otherwise("en")
    )


def recover(attempts: DataFrame, active: DataFrame) -> DataFrame:
    """Unfinished attempts with the status that their recording falls back to."""
    lost = attempts.filter("outcome is null").join(active.select("recording_id", F.lit(True).alias("has")), "recording_id", "left")
    return lost.select("attempt_id", "recording_id", F.lit("interrupted").alias("outcome"), F.when(F.col("has"), "transcribed").otherwise("ready_to_transcribe").alias("status"))


def next_ordinals(rows: DataFrame, new: DataFrame, scope: str, order: Column) -> DataFrame:
    """new rows with the ordinals that follow the greatest one of their scope."""
    top = rows.groupBy(scope).agg(F.max("ordinal").alias("_top"))
    at = F.row_number().over(Window.partitionBy(scope).orderBy(order))
    return new.join(top, scope, "left").withColumn("ordinal", F.coalesce("_top", F.lit(-1)) + at).drop("_top")


def work_queue(state: DataFrame) -> DataFrame:
    """recording_id and the next permitted action of each recording (processing_status, archived, has_transcript, summary); a failed transcription outranks a failed summary."""
    status, summary = F.col("processing_status"), F.col("summary")
    action = (
        F.when(F.col("archived"), "none").when(status.isin("discovered", "routing"), "route").when(status == "failed", "retry").when(status == "ready_to_transcribe", "transcribe")
        .when(~F.col("has_transcript"), "none").when(summary == "failed", "retry_summary").when(summary == "missing", "first_summary").otherwise("regenerate")
    )
    return state.select("recording_id", action.alias("action"))


def archived_listing(recordings: DataFrame, sections: DataFrame, limit: int = 200) -> DataFrame:
    """item_key and archived_at of archived recordings, and of archived sections whose recording is not archived, newest first."""
    gone = recordings.filter("archived_at is not null")
    parts = sections.filter("archived_at is not null").join(gone.select("recording_id"), "recording_id", "left_anti")
    both = gone.select(F.concat(F.lit("r:"), F.col("recording_id").cast("string")).alias("item_key"), "archived_at")
    both = both.unionByName(parts.select(F.concat(F.lit("s:"), F.col("section_id").cast("string")).alias("item_key"), "archived_at"))
    return both.orderBy(F.desc("archived_at"), "item_key").limit(limit)


def temporary_title(ordinal: Column, started: Column, zone: str = "UTC") -> Column:
    return F.concat(F.lit("Segment "), ordinal.cast("string"), F.lit(" of "), F.date_format(F.from_utc_timestamp(started, zone), "yyyyMMddHHmm"))
