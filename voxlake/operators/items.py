"""Library items: titles and names, filters over recordings and sections, the listing of both, cards, splitting a transcript."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.text import nfc, strip
from voxlake.operators.library import local_day_bounds, temporary_title, title_fault
from voxlake.operators.scans import kept
from voxlake.operators.search import keyword_search
from voxlake.streaming.jobs import clearing

PLACEHOLDER = "Untitled recording"
#: Columns of both branches that only filters look at.
FILTER_ONLY = ("archived_at", "has_summary")
SORTS = ("newest", "oldest", "title_az", "title_za")
#: Winners of a search that a listing shows.
SEARCH_WINNERS = 200
MAX_TAGS = 10


def source_order() -> Column:
    """Canonical sources first, then the earliest seen, then the smallest id."""
    return F.struct(F.when(F.col("is_canonical"), 0).otherwise(1), "first_seen_at", "source_id")


def preferred_filename(sources: DataFrame) -> DataFrame:
    """recording_id and filename: the first source's name that is not empty."""
    named = sources.filter(F.coalesce("original_filename", F.lit("")) != "")
    return named.groupBy("recording_id").agg(F.min_by("original_filename", source_order()).alias("filename"))


def filename_list(sources: DataFrame) -> DataFrame:
    """recording_id and filenames: all names in source order, trimmed, without blanks and repeats.

    Repeats go before names are gathered, so a recording's array holds its distinct names only.
    """
    named = sources.withColumn("name", strip(nfc("original_filename"))).filter("name <> ''")
    first = named.groupBy("recording_id", "name").agg(F.min(source_order()).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "name")))
    return first.groupBy("recording_id").agg(F.transform(ordered, lambda x: x["name"]).alias("filenames"))


def active_tag_names(assignments: DataFrame, item: str = "recording_id") -> DataFrame:
    """item and tags: names of active assignments (item, name, name_key, is_active) in order of key and name."""
    pairs = F.array_sort(F.collect_set(F.struct("name_key", "name")))
    return assignments.filter("is_active").groupBy(item).agg(F.transform(pairs, lambda x: x["name"]).alias("tags"))


def display_titles(recordings: DataFrame, summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """recording_id and title of recordings (recording_id, default_language).

    The first that is not empty of: the default-language title, any title by ordinal, the preferred
    file name, a placeholder. summaries: active whole-recording ones (recording_id, ordinal, output_language, title).
    """
    named = summaries.filter(F.coalesce("title", F.lit("")) != "").join(recordings.select("recording_id", "default_language"), "recording_id")
    own = F.when(F.col("output_language") == F.col("default_language"), 0).otherwise(1)
    best = named.groupBy("recording_id").agg(F.min_by("title", F.struct(own, "ordinal", "title")).alias("summary_title"))
    out = recordings.select("recording_id").join(best, "recording_id", "left").join(preferred_filename(sources), "recording_id", "left")
    return out.select("recording_id", F.coalesce("summary_title", "filename", F.lit(PLACEHOLDER)).alias("title"))


def summary_is_current() -> Column:
    """Whether a summary row (is_active, transcript_active, section_ordinal) speaks for its recording now."""
    return F.coalesce(F.col("is_active") & F.col("transcript_active") & (F.col("section_ordinal") == 0), F.lit(False))


def lookup_titles(keys: DataFrame, titles: DataFrame) -> DataFrame:
    """keys (recording_id) with title; unknown recordings get an empty one."""
    return keys.join(titles.select("recording_id", "title"), "recording_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


@dataclass(frozen=True)
class Filters:
    """Conditions of a listing; all are optional and joined by AND. Days are ISO dates of the given zone."""

    date: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    tags: tuple[str, ...] = ()
    tag_match: str = "all"
    status: str | None = None
    summary: str | None = None
    review: bool = False
    audio: str | None = None
    has_summary: bool | None = None

    def __post_init__(self):
        if self.tag_match not in ("all", "any") or len(self.tags) > MAX_TAGS:
            raise ValueError(f"tag_match is all or any, and at most {MAX_TAGS} tags are given")
        if self.date and (self.date_from or self.date_to):
            raise ValueError("date excludes date_from and date_to")


def review_reasons(summary: Column) -> Column:
    """Whether a row needs a look: its status, a failed second run, or a failed summary."""
    hit = F.col("processing_status").isin("needs_review", "failed") | F.col("retranscription_failed") | F.col("resummarization_failed") | (summary == "failed")
    return F.coalesce(hit, F.lit(False))


def _filtered(rows: DataFrame, f: Filters, zone: str, tags: DataFrame, key: str, summary: Column) -> DataFrame:
    day = lambda text: local_day_bounds(text, zone)
    at = F.col("effective_at")
    if f.date:
        rows = rows.filter((at >= day(f.date)[0]) & (at < day(f.date)[1]))
    if f.date_from:
        rows = rows.filter(at >= day(f.date_from)[0])
    if f.date_to:
        rows = rows.filter(at < day(f.date_to)[1])
    if f.status:
        rows = rows.filter(F.col("processing_status") == f.status)
    if f.review:
        rows = rows.filter(review_reasons(summary))
    if f.audio:
        rows = rows.filter(F.col("audio_status") == f.audio)
    if f.has_summary is not None:
        rows = rows.filter(F.col("has_summary") == f.has_summary)
    if f.tags:
        wanted = tags.filter(F.col("is_active") & F.col("name_key").isin(*f.tags)).select(key, "name_key")
        if f.tag_match == "all":
            wanted = wanted.groupBy(key).agg(F.countDistinct("name_key").alias("n")).filter(F.col("n") == len(set(f.tags)))
        rows = rows.join(wanted.select(key), key, "left_semi")
    return rows


def filter_recordings(recordings: DataFrame, f: Filters, tags: DataFrame, zone: str = "UTC") -> DataFrame:
    """Recordings that are not archived and meet the conditions; tags are those of the recording, not of its sections."""
    rows = recordings.filter("archived_at is null")
    if f.summary:
        rows = rows.filter(F.col("summary_status") == f.summary)
    return _filtered(rows, f, zone, tags.filter("section_id is null"), "recording_id", F.col("summary_status"))


def filter_sections(sections: DataFrame, f: Filters, tags: DataFrame, zone: str = "UTC") -> DataFrame:
    """Sections, joined to their recording's columns, that meet the conditions.

    Tags and summaries are the section's own: `not_ready` matches none, `missing` also a null state. The
    rest is inherited. Archived sections and those of archived recordings are out.
    """
    rows = sections.filter("archived_at is null and recording_archived_at is null")
    if f.summary == "not_ready":
        rows = rows.filter(F.lit(False))
    elif f.summary:
        rows = rows.filter(F.coalesce("summary_status", F.lit("missing")) == f.summary)
    own = tags.filter("section_id is not null").select("section_id", "name_key", "is_active")
    return _filtered(rows, f, zone, own, "section_id", F.col("summary_status"))


def recording_rows(recordings: DataFrame, titles: DataFrame, routes: DataFrame) -> DataFrame:
    """The columns that filters and listing need: effective time, title, and whether an active route is unverified.

    recordings: recording_id, recorded_at, discovered_at, default_language, the status columns, has_summary, archived_at;
    routes: recording_id, is_active, routing_verified.
    """
    open_ = routes.filter("is_active and not routing_verified").select("recording_id").distinct().withColumn("route_unverified", F.lit(True))
    out = recordings.join(titles, "recording_id", "left").join(open_, "recording_id", "left")
    return out.withColumns({"effective_at": F.coalesce("recorded_at", "discovered_at"), "route_unverified": F.coalesce("route_unverified", F.lit(False))})


def section_rows(sections: DataFrame, rows: DataFrame, summaries: DataFrame, states: DataFrame, durations: DataFrame) -> DataFrame:
    """Valid sections with their recording's columns, their own title, summary state and duration.

    sections: section_id, recording_id, title, start_ordinal, end_ordinal, archived_at; rows: from
    recording_rows(); summaries: active ones with a section (section_id, ordinal, output_language, title);
    states: section_id, output_language, state; durations: section_id, duration. A default-language summary's
    title goes before the stored one.
    """
    parent = rows.select("recording_id", "effective_at", "default_language", "processing_status", "audio_status", "retranscription_failed", "resummarization_failed", "route_unverified", "recorded_at", F.col("archived_at").alias("recording_archived_at"))
    own = sections.join(parent, "recording_id")
    default = own.select("section_id", F.col("default_language").alias("output_language"))
    best = summaries.join(default, ["section_id", "output_language"]).groupBy("section_id").agg(F.min_by("title", "ordinal").alias("summary_title"), F.lit(True).alias("has_summary"))
    state = states.join(default, ["section_id", "output_language"]).groupBy("section_id").agg(F.max("state").alias("summary_status"))
    out = own.join(best, "section_id", "left").join(state, "section_id", "left").join(durations, "section_id", "left")
    return out.withColumn("title", F.coalesce("summary_title", "title")).withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))


def item_listing(recordings: DataFrame, sections: DataFrame) -> DataFrame:
    """One row for each filtered recording without a valid split, and for each filtered section: item_key, item_kind, the range of segments, title_fold,
    section_id, duration, and what both have in common (but FILTER_ONLY).

    recordings: recording_rows() after filter_recordings(), without the split ones; sections: section_rows()
    after filter_sections(). The keys are disjoint, so the union needs no distinct.
    """
    from voxlake.functions.text import fold

    whole = recordings.withColumns({
        "item_key": F.concat(F.lit("r:"), F.col("recording_id").cast("string")), "item_kind": F.lit("recording"), "section_id": F.lit(None).cast("long"),
        "range_start": F.lit(None).cast("int"), "range_end": F.lit(None).cast("int"),
    })
    parts = sections.withColumns({
        "item_key": F.concat(F.lit("s:"), F.col("section_id").cast("string")), "item_kind": F.lit("section"), "range_start": F.col("start_ordinal"), "range_end": F.col("end_ordinal"),
    })
    if "duration" not in whole.columns:
        whole = whole.withColumn("duration", F.lit(None).cast("double"))
    shape = [c for c in whole.columns if c in parts.columns and c not in FILTER_ONLY]
    both = [df.select(*shape, fold("title").alias("title_fold")) for df in (whole, parts)]
    return both[0].unionByName(both[1])


def item_keys(recordings: DataFrame, sections: DataFrame) -> DataFrame:
    """The keys of item_listing() alone, for counts and scopes."""
    key = lambda df, mark, c: df.select(F.concat(F.lit(mark), F.col(c).cast("string")).alias("item_key"))
    return key(recordings, "r:", "recording_id").unionByName(key(sections, "s:", "section_id"))


def item_order(sort: str, backwards: bool = False) -> list[Column]:
    """A total order of items, or the same from its end."""
    if sort not in SORTS:
        raise ValueError(f"sort is one of {SORTS}")
    column, falls = {"newest": ("effective_at", True), "oldest": ("effective_at", False), "title_az": ("title_fold", False), "title_za": ("title_fold", True)}[sort]
    return [F.desc(column) if falls != backwards else F.asc(column), F.desc("item_key") if backwards else F.asc("item_key")]


#: Rows from either end of a listing up to which a page is taken by its first or last rows alone.
NEAR_END = 10_000


def item_page(items: DataFrame, keys: DataFrame, sort: str, number: int, size: int = 25) -> DataFrame:
    """One page of items with page and pages; a page number outside the range is moved to its nearest end.

    A page near an end is that end's first rows. For any other the keys are sorted across all tasks and counted by task, so that no task or
    driver holds what lies before the page.
    """
    with clearing(keys.sparkSession):
        total = keys.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    begin, end = (number - 1) * size, min(number * size, total)
    order = item_order(sort)
    if end <= NEAR_END:
        rows = items.orderBy(*order).offset(begin).limit(size)
    elif total - begin <= NEAR_END:
        rows = items.orderBy(*item_order(sort, backwards=True)).offset(total - end).limit(end - begin)
    else:
        rows = items.join(F.broadcast(_placed(items, sort, begin, end)), "item_key", "left_semi")  # one page
    return rows.orderBy(*order).limit(size).withColumns({"page": F.lit(number), "pages": F.lit(pages)})


def _placed(items: DataFrame, sort: str, begin: int, end: int) -> DataFrame:
    """item_key of the items from place `begin` to `end` (from 0, without) of an order."""
    order = item_order(sort)
    ranged = items.select("item_key", "title_fold", "effective_at").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = kept(ranged.select("item_key", F.monotonically_increasing_id().alias("pos")), "order")
    part, at = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    before, wanted = 0, F.lit(False)
    for p, n in sorted(map(tuple, rows.groupBy(part).count().collect())):  # one row a task
        lo, hi = max(begin - before, 0), min(end - before, n)
        if lo < hi:
            wanted = wanted | ((part == p) & (at >= lo) & (at < hi))
        before += n
    return rows.filter(wanted).select("item_key")


def cards(page: DataFrame, summaries: DataFrame, tags: DataFrame, sources: DataFrame) -> DataFrame:
    """A page of items (item_key, recording_id, section_id, place) with languages of its summaries, tags and file names; vanished keys drop out.

    Children are cut to the page by a semi join before they are gathered. The page is read several times: store one that is costly to make.
    """
    on = page.select("item_key", "recording_id", "section_id", "place")
    here = on.select("recording_id").distinct()
    same = (F.col("c.recording_id") == F.col("p.recording_id")) & F.col("c.section_id").eqNullSafe(F.col("p.section_id"))
    own = lambda df: df.join(here, "recording_id", "left_semi").alias("c").join(on.alias("p"), same)
    langs = own(summaries.filter("is_active")).groupBy("p.item_key").agg(F.array_sort(F.collect_set("c.output_language")).alias("languages"))
    named = own(tags).select("p.item_key", "c.name", "c.name_key", "c.is_active")
    files = filename_list(sources.join(here, "recording_id", "left_semi"))
    none = F.array().cast("array<string>")
    out = on.join(langs, "item_key", "left").join(active_tag_names(named, "item_key"), "item_key", "left").join(files, "recording_id", "left")
    return out.select("item_key", "place", *[F.coalesce(c, none).alias(c) for c in ("languages", "tags", "filenames")])


def archive_requests(requests: DataFrame, recordings: DataFrame, attempts: DataFrame) -> DataFrame:
    """recording_id and result of requests to archive: archived, unchanged, or refused while an attempt is unfinished."""
    busy = attempts.filter("outcome is null").select("recording_id").distinct().withColumn("busy", F.lit(True))
    rows = requests.join(recordings.select("recording_id", "archived_at"), "recording_id").join(busy, "recording_id", "left")
    result = F.when(F.col("archived_at").isNotNull(), "unchanged").when(F.col("busy"), "refused").otherwise("archived")
    return rows.select("recording_id", result.alias("result"))


def plan_splits(requests: DataFrame, transcripts: DataFrame, layouts: DataFrame, sections: DataFrame, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(results, sections) of requests to split transcripts.

    requests: transcript_id, start, end, splits, titles, temporary (arrays); transcripts: transcript_id, is_active,
    archived_at, started_at, n, first, last (of segment ordinals); layouts: transcript_id, revision, is_active,
    start_ordinal, end_ordinal; sections: those of active layouts. results has fault (null if none), action
    (create or unchanged) and the new revision. A blank temporary title is derived; any other one must equal
    the derived one.
    """
    r = requests.withColumns({"splits": F.array_sort("splits"), "n_splits": F.size("splits"), "n_titles": F.size("titles")})
    r = r.join(transcripts, "transcript_id", "left")
    bounds = F.concat(F.array("start"), F.col("splits"), F.array("end"))
    parts = F.when(F.col("n_splits") > 0, F.transform(F.slice(bounds, 1, F.col("n_splits") + 1), lambda lo, i: F.struct((i + 1).cast("int").alias("ordinal"), lo.cast("int").alias("lo"), F.get(bounds, i + 1).cast("int").alias("hi"), F.get("titles", i).alias("given"), F.get("temporary", i).alias("flag"))))
    derived = lambda p: temporary_title(p.ordinal, F.col("started_at"), zone)
    parts = F.transform(F.coalesce(parts, F.array().cast("array<struct<ordinal:int,lo:int,hi:int,given:string,flag:boolean>>")), lambda p: F.struct(p.ordinal.alias("ordinal"), p.lo.alias("lo"), p.hi.alias("hi"), F.when(p.flag & (p.given == ""), derived(p)).otherwise(p.given).alias("title"), p.flag.alias("flag")))
    r = r.withColumn("parts", parts)
    wrong_title = F.exists("parts", lambda p: ~p.flag & title_fault(p.title).isNotNull())
    forged = F.exists("parts", lambda p: p.flag & (p.title != derived(p)))
    fault = (
        F.when((F.col("n_splits") > 199) | (F.col("n_titles") > 200), "too_many_topics").when(F.size("temporary") != F.col("n_titles"), "title_flag_count_mismatch")
        .when(F.col("n_titles") != F.when(F.col("n_splits") > 0, F.col("n_splits") + 1).otherwise(0), "title_count_mismatch")
        .when(F.size(F.array_distinct("splits")) != F.col("n_splits"), "duplicate_split").when(F.col("is_active").isNull(), "transcript_not_found")
        .when(F.col("archived_at").isNotNull(), "recording_archived").when(~F.col("is_active"), "transcript_not_active").when(F.col("n") == 0, "transcript_empty")
        .when((F.col("first") != 0) | (F.col("last") != F.col("n") - 1), "segments_not_contiguous").when((F.col("start") < 0) | (F.col("end") > F.col("n")), "range_out_of_bounds")
        .when(F.col("start") >= F.col("end"), "empty_range").when(F.exists("splits", lambda s: (s < F.col("start")) | (s > F.col("end"))), "split_out_of_range")
        .when(F.exists("splits", lambda s: (s == F.col("start")) | (s == F.col("end"))), "split_at_endpoint").when(wrong_title, "invalid_title").when(forged, "title_flag_forgery")
    )
    r = r.withColumn("fault", fault)
    live = layouts.groupBy("transcript_id").agg(F.max("revision").alias("top"), F.max(F.when(F.col("is_active"), F.struct("start_ordinal", "end_ordinal"))).alias("now"))
    held = F.array_sort(F.collect_list(F.struct("ordinal", F.col("start_ordinal").alias("lo"), F.col("end_ordinal").alias("hi"), "title", F.col("title_is_temporary").alias("flag"))))
    have = sections.groupBy("transcript_id").agg(held.alias("have"))  # at most 200 sections a layout
    r = r.join(live, "transcript_id", "left").join(have, "transcript_id", "left")
    empty = F.array().cast("array<struct<ordinal:int,lo:int,hi:int,title:string,flag:boolean>>")
    now = F.coalesce("now", F.struct(F.lit(0).alias("start_ordinal"), F.col("n").cast("int").alias("end_ordinal")))
    same = (now["start_ordinal"] == F.col("start")) & (now["end_ordinal"] == F.col("end")) & (F.coalesce("have", empty) == F.col("parts"))
    r = r.withColumn("action", F.when(F.col("fault").isNull(), F.when(same, "unchanged").otherwise("create")))
    r = r.withColumn("revision", F.when(F.col("action") == "create", F.coalesce("top", F.lit(0)) + 1))
    made = r.filter("action = 'create'").select("transcript_id", "revision", F.explode("parts").alias("p"))
    made = made.select("transcript_id", "revision", "p.ordinal", F.col("p.lo").alias("start_ordinal"), F.col("p.hi").alias("end_ordinal"), "p.title", F.col("p.flag").alias("title_is_temporary"))
    return r.select("transcript_id", "fault", "action", "revision"), made


def winners_in_order(winners: DataFrame, items: DataFrame, sort: str = "relevance") -> DataFrame:
    """Search winners (item_key, rank) joined to their items and placed by rank or by a library sort; vanished items drop out."""
    rows = winners.join(items, "item_key")
    order = [F.asc("rank")] if sort == "relevance" else item_order(sort)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over at most 200 winners


def search_request(f: Filters, sort: str | None, known_tags: set[str], known_status: set[str]) -> tuple[Filters, str, bool]:
    """(filters, sort, unscoped) of a search inside a listing: an unknown or missing sort is relevance and changes nothing else; see scope_filters()."""
    f, unscoped = scope_filters(f, known_tags, known_status)
    return f, sort if sort in (*SORTS, "relevance") else "relevance", unscoped


def search_page(documents: DataFrame, query: str, items: DataFrame, sort: str = "relevance", number: int = 1, size: int = 25, limit: int = SEARCH_WINNERS) -> DataFrame:
    """A page of search results as the listing shows them: item columns with document_key, rank, place, page, pages and matched (all winners), truncated (more items matched).

    documents: folded search documents with an item_key; items: the filtered listing (item_listing()), which is the search's scope. The best
    `limit` items by relevance are placed by the sort, all of them before a page is cut; a page number outside the range is
    moved to its nearest end. One plan: nothing is counted beforehand.
    """
    if sort not in (*SORTS, "relevance"):
        raise ValueError(f"sort is relevance or one of {SORTS}")
    won = keyword_search(documents, query, unit="item_key", scope=items.select("item_key"), limit=limit + 1)
    cut = F.count("*").over(Window.partitionBy()) > limit  # over at most limit + 1 winners, as are the windows below
    won = won.withColumn("truncated", cut).filter(F.col("rank") <= limit).select("item_key", "document_key", "rank", "truncated")
    placed = winners_in_order(won, items, sort).withColumn("matched", F.count("*").over(Window.partitionBy()))
    pages = F.ceil(F.col("matched") / size).cast("int")
    placed = placed.withColumn("pages", pages).withColumn("page", F.least(F.greatest(F.lit(number), F.lit(1)), F.col("pages")))
    return placed.filter(F.ceil(F.col("place") / size) == F.col("page"))


def scope_filters(f: Filters, known_tags: set[str], known_status: set[str]) -> tuple[Filters, bool]:
    """(filters, unscoped) for a search inside a listing: unknown tags or statuses make it an unscoped search, with a flag."""
    bad = any(t not in known_tags for t in f.tags) or (f.status is not None and f.status not in known_status)
    return (replace(f, tags=(), status=None, date=None, date_from=None, date_to=None, summary=None, review=False, audio=None, has_summary=None), True) if bad else (f, False)
