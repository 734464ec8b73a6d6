"""Summaries: chunk planning, map and reduce with caller's functions, payload checks, rendering."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.text import CJK, canonical_language, strip, visible
from voxlake.operators.scans import kept, running

CHUNK, OVERLAP, MAX_CHUNKS, MAX_CHARS = 24000, 1000, 8, 960000


#: Chunk lengths of a block of a transcript that is planned in one task.
BLOCK_CHUNKS = 64


def chunk_from(places: np.ndarray, at: int, limit: int, overlap: int) -> tuple[int, int | None]:
    """(end, next start) of the chunk that starts with piece `at`; places: where pieces start, with the end of the last one, in characters of the
    transcript written with a line end behind each piece. The next start is None behind the last piece.

    A chunk takes all pieces that fit, so its end is a search in the places. A full chunk hands nothing on; else the next one starts with the
    first piece from which on the trailing pieces have at most `overlap` characters and leave room for the piece that did not fit.
    """
    end = int(np.searchsorted(places, places[at] + limit + 1, "right")) - 1
    if end == len(places) - 1:
        return end, None
    if places[end] - places[at] - 1 == limit:
        return end, end
    return end, int(np.searchsorted(places, max(places[end] - 1 - overlap, places[end + 1] - 1 - limit)))


def pack(texts: list[str], limit: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Whole texts in chunks of at most limit characters, joined by line ends; longer texts are cut, empty ones left out. See chunk_from()."""
    pieces = [t[i : i + limit] for t in texts for i in range(0, len(t), limit)]
    places = np.cumsum([0, *(len(p) + 1 for p in pieces)])
    chunks, at = [], 0 if pieces else None
    while at is not None:
        end, after = chunk_from(places, at, limit, overlap)
        chunks.append("\n".join(pieces[at:end]))
        at = after
    return chunks


def transcript_sizes(segments: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """transcript_id, characters and status: too_long for transcripts that are refused."""
    found = segments.groupBy("transcript_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))
    return found.withColumn("status", F.when(F.col("characters") > max_chars, "too_long").otherwise("ok"))


def plan_chunks(segments: DataFrame, limit: int = CHUNK, overlap: int = OVERLAP, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """transcript_id, chunk_no and text of the chunks of transcripts (transcript_id, ordinal, text) of any length; segments without text carry nothing.

    A running sum gives each piece its place, and a transcript is cut into blocks of places. A task has a block and as much of the
    next as a chunk can reach. For each place where a chunk can enter a block it follows the chunks to where they leave it; pointer doubling over
    these links finds the chunks that really start, in as many rounds as the greatest number of blocks has binary digits; then
    each block writes its chunks. So a transcript with a third of all segments is planned in many tasks.
    """
    overlap = min(overlap, limit)
    width = block_chunks * (limit + 1)
    length = F.length("text")
    held = segments.select("transcript_id", F.col("ordinal").cast("long").alias("ordinal"), "text").filter(F.coalesce("text", F.lit("")) != "")
    size = (length + F.ceil(length / limit)).cast("long")
    placed = running(held.withColumn("size", size), "transcript_id", "ordinal", {"before": F.sum("size")})
    cut = F.posexplode(F.sequence(F.lit(0), (length - 1).cast("int"), F.lit(limit))).alias("no", "pos")
    pieces = placed.select("transcript_id", F.coalesce("before", F.lit(0)).alias("before"), "text", cut)
    pieces = pieces.select("transcript_id", (F.col("before") + F.col("pos") + F.col("no")).alias("place"), F.expr(f"substr(text, pos + 1, {limit})").alias("text"))
    blocks = placed.agg(F.floor(F.max(F.coalesce("before", F.lit(0)) + F.col("size")) / width)).first()[0]
    block = F.floor(F.col("place") / width)
    both = F.when((F.col("place") >= width) & (F.col("place") % width <= limit + 1), F.array(block, block - 1)).otherwise(F.array(block))
    pieces = pieces.withColumn("block", F.explode(both))
    starts = held.select("transcript_id").distinct().select("transcript_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("chunk_no"))
    if blocks:
        starts = _entered(pieces, starts, limit, overlap, width, blocks)
    rows = pieces.select("transcript_id", "block", "place", "text", F.lit(None).cast("long").alias("chunk_no")).unionByName(starts.withColumn("text", F.lit(None).cast("string")))

    def write(df: pd.DataFrame) -> pd.DataFrame:
        if not df["text"].isna().any():  # the last chunk began in the block before
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("transcript_id", "chunk_no", "text")})
        entry = df[df["text"].isna()].iloc[0]
        own = df[df["text"].notna()].sort_values("place")
        texts, places = own["text"].tolist(), _places(own["place"].to_numpy(), own["text"].str.len().to_numpy())
        edge, out, at = (entry["block"] + 1) * width, [], int(np.searchsorted(places, entry["place"]))
        while at is not None and places[at] < edge:
            end, after = chunk_from(places, at, limit, overlap)
            out.append("\n".join(texts[at:end]))
            at = after
        return pd.DataFrame({"transcript_id": entry["transcript_id"], "chunk_no": int(entry["chunk_no"]) + np.arange(len(out)), "text": out})

    return rows.groupBy("transcript_id", "block").applyInPandas(write, "transcript_id long, chunk_no int, text string")


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.append(starts, starts[-1:] + lengths[-1:] + 1).astype(np.int64)


def _entered(pieces: DataFrame, starts: DataFrame, limit: int, overlap: int, width: int, blocks: int) -> DataFrame:
    """transcript_id, block, place and chunk_no of the first chunk that starts in each block."""
    def leave(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("place")
        number = int(df["block"].iloc[0])
        places, edge = _places(df["place"].to_numpy(), df["n"].to_numpy()), (number + 1) * width
        out: dict[int, tuple[int | None, int]] = {}
        for start in range(len(places) - 2, -1, -1):  # from behind, so that a link is one step
            if places[start] < edge:
                after = chunk_from(places, start, limit, overlap)[1]
                far, n = out.get(after, (None, 0)) if after is None or places[after] < edge else (int(places[after]), 0)
                out[start] = far, n + 1
        near = [s for s in out if places[s] - number * width <= limit + 1 or s == 0 and number == 0]
        return pd.DataFrame({"transcript_id": df["transcript_id"].iloc[0], "place": places[near] if near else [], "after": pd.array([out[s][0] for s in near], "Int64"), "chunks": [out[s][1] for s in near]})

    links = pieces.select("transcript_id", "block", "place", F.length("text").alias("n")).groupBy("transcript_id", "block").applyInPandas(leave, "transcript_id long, place long, after long, chunks long")
    links = kept(links.filter("after is not null"), "links")
    found = starts.select("transcript_id", "place", "chunk_no")
    for _ in range(int(blocks).bit_length()):
        step = found.join(links, ["transcript_id", "place"]).select("transcript_id", F.col("after").alias("place"), (F.col("chunk_no") + F.col("chunks")).alias("chunk_no"))
        found = kept(found.unionByName(step), "entries")
        far = links.select("transcript_id", F.col("place").alias("after"), F.col("after").alias("far"), F.col("chunks").alias("more"))
        links = kept(links.join(far, ["transcript_id", "after"]).select("transcript_id", "place", F.col("far").alias("after"), (F.col("chunks") + F.col("more")).alias("chunks")), "links")
    return found.select("transcript_id", F.floor(F.col("place") / width).alias("block"), "place", "chunk_no")


def planned(segments: DataFrame, limit: int = CHUNK, overlap: int = OVERLAP, max_chunks: int = MAX_CHUNKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """transcript_id, status, chunks, characters, chunk_no and text: plan_chunks() of transcripts within the limits, and for each other one row
    without a chunk that tells what it exceeds (too_long before too_many_chunks) and how many chunks it has."""
    chunks = kept(plan_chunks(segments, limit, overlap), "chunks")
    counts = transcript_sizes(segments, max_chars).join(chunks.groupBy("transcript_id").agg(F.count("*").alias("chunks")), "transcript_id", "left")
    counts = counts.withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("status", F.when((F.col("status") == "ok") & (F.col("chunks") > max_chunks), "too_many_chunks").otherwise(F.col("status")))
    good = chunks.join(counts.filter("status = 'ok'"), "transcript_id")
    bad = counts.filter("status <> 'ok'").withColumns({"chunk_no": F.lit(None).cast("int"), "text": F.lit(None).cast("string")})
    return good.select("transcript_id", "status", "chunks", "characters", "chunk_no", "text").unionByName(bad)


def chunk_limits(chunks: DataFrame, max_chunks: int = MAX_CHUNKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """transcript_id, chunks, characters and status of a plan."""
    found = chunks.groupBy("transcript_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))
    return found.withColumn("status", F.when(F.col("characters") > max_chars, "too_long").when(F.col("chunks") > max_chunks, "too_many_chunks").otherwise("ok"))


def summarise(chunks: DataFrame, map_fn: Callable[[list[str]], list[str]], reduce_fn: Callable[[list[str]], str], cap: int = CHUNK) -> DataFrame:
    """transcript_id, chunks, status and summary: map_fn over batches of chunks, reduce_fn over a transcript's mapped chunks in order.

    A single chunk goes to reduce_fn as it is. Mapped chunks of more than cap characters together are reduced in
    two halves once; if a half or the two results are still over the cap, the transcript is `too_long`.
    """
    only = Window.partitionBy("transcript_id")
    counted = chunks.withColumn("_n", F.count("*").over(only).cast("int"))

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            several = df["_n"] > 1
            df = df.copy()
            if several.any():
                df.loc[several, "text"] = map_fn(list(df.loc[several, "text"]))
            yield df

    def reduced(df: pd.DataFrame) -> pd.DataFrame:
        texts = list(df.sort_values("chunk_no")["text"])
        size = lambda parts: sum(map(len, parts))
        if size(texts) > cap and len(texts) > 1:
            half = len(texts) // 2
            parts = [texts[:half], texts[half:]]
            texts = [reduce_fn(p) for p in parts] if all(size(p) <= cap for p in parts) else texts
        good = len(texts) == 1 or size(texts) <= cap
        return pd.DataFrame({"transcript_id": [df["transcript_id"].iloc[0]], "chunks": [len(df)], "status": ["ok" if good else "too_long"], "summary": [reduce_fn(texts) if good else None]})

    schema = "transcript_id long, chunk_no int, text string, _n int"
    out = counted.select("transcript_id", "chunk_no", "text", "_n").mapInPandas(mapped, schema)
    return out.groupBy("transcript_id").applyInPandas(reduced, "transcript_id long, chunks int, status string, summary string")


def detect_languages(texts: DataFrame, detector: Callable[[list[str]], list[str | None]], retries: int = 1, batch: int = 64) -> DataFrame:
    """transcript_id, language, provenance and failure of transcripts (transcript_id, observed, sample).

    An observed language stays as it is; else the caller's detector is asked, again for replies that are no language
    tag, `retries` times at most. Failures: no_text, no_reply, invalid_reply.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            said = pd.Series([None] * len(df), index=df.index, dtype=object)
            todo = [i for i in df.index if not df["observed"][i] and (df["sample"][i] or "").strip()]
            for _ in range(retries + 1):
                again = []
                for at in range(0, len(todo), batch):
                    part = todo[at : at + batch]
                    for i, reply in zip(part, detector([df["sample"][i] for i in part])):
                        said[i] = reply
                        if not re.fullmatch(r"[A-Za-z]{2,3}([-_][A-Za-z]{4})?([-_]([A-Za-z]{2}|[0-9]{3}))?", reply or ""):
                            again.append(i)
                todo = again
            yield df.assign(said=said)[["transcript_id", "observed", "sample", "said"]]

    rows = texts.select(F.col("transcript_id").cast("long").alias("transcript_id"), F.coalesce("observed", F.lit("")).alias("observed"), "sample")
    rows = rows.mapInPandas(run, "transcript_id long, observed string, sample string, said string")
    known, found = canonical_language(F.col("observed")), canonical_language(F.col("said"))
    failure = F.when(known != "", None).when(F.trim(F.coalesce("sample", F.lit(""))) == "", "no_text").when(F.col("said").isNull(), "no_reply").when(found == "", "invalid_reply")
    return rows.select(
        "transcript_id", F.coalesce(F.nullif(known, F.lit("")), F.nullif(found, F.lit(""))).alias("language"),
        F.when(known != "", "observed").when(found != "", "detected").alias("provenance"), failure.alias("failure"),
    )


def language_fault(text: Column, language: Column) -> Column:
    """en with at least 10 and a tenth of CJK, or zh-Hant with more than 50 visible characters and under a twentieth of it."""
    n, c = visible(text), F.regexp_count(text, F.lit(CJK))
    return F.when((language == "en") & (c >= 10) & (c * 10 >= n), "unexpected_cjk").when((language == "zh-Hant") & (n > 50) & (c * 20 < n), "missing_cjk").otherwise("ok")


def key_point_lines(points: Column) -> Column:
    """Lines of an array of (text, level): numbers like 1., 1.1, 1.1.1 at levels 1 to 3, bullets at any other; blank points are left out."""
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.array().cast("array<string>").alias("lines"))
    kept = F.filter(F.transform(points, lambda p: F.struct(strip(F.coalesce(p.text, F.lit(""))).alias("text"), F.when(p.level.between(1, 3), p.level).otherwise(0).alias("level"))), lambda p: p.text != "")

    def step(acc: Column, p: Column) -> Column:
        a = F.when(p.level == 1, acc.a + 1).otherwise(acc.a)
        b = F.when(p.level == 2, acc.b + 1).when(p.level == 1, 0).otherwise(acc.b)
        c = F.when(p.level == 3, acc.c + 1).when(p.level.isin(1, 2), 0).otherwise(acc.c)
        s = lambda x: x.cast("string")
        mark = F.when(p.level == 0, F.lit("-")).when(p.level == 1, F.concat(s(a), F.lit("."))).when(p.level == 2, F.concat_ws(".", s(a), s(b))).otherwise(F.concat_ws(".", s(a), s(b), s(c)))
        return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.concat(acc.lines, F.array(F.concat_ws(" ", mark, p.text))).alias("lines"))

    return F.aggregate(kept, zero, step, lambda acc: acc.lines)


def action_line(text: Column, owner: Column, due: Column) -> Column:
    """An action item as text, with owner and due date in brackets where there are any."""
    some = lambda c, mark: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c))
    detail = F.concat_ws("; ", some(owner, "owner: "), some(due, "due: "))
    return F.concat(F.coalesce(text, F.lit("")), F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""))


def _lines(values: Column, mark: str = "- ") -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(mark), x))


LISTS = (("people", "People"), ("organizations", "Organizations"), ("topics", "Topics"))


def _rendered(title: str, overview: str, points: str, actions: str, section: Callable[[str], list[str]], gap: list[str], tags: Callable[[Column], Column]) -> Column:
    none = F.array().cast("array<string>")
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else none
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    parts = [
        F.array(F.concat(F.lit(title), F.coalesce("title", F.lit(""))), F.lit(""), *[F.lit(x) for x in gap], F.concat(F.lit(overview), F.coalesce("overview", F.lit("")))),
        F.when(some("key_points"), F.concat(lit("", points), key_point_lines(F.col("key_points")))).otherwise(none), lit("", actions),
        F.when(some("action_items"), F.transform("action_items", lambda x: F.concat(F.lit("- "), action_line(x.text, x.owner, x.due_date)))).otherwise(lit("- No action items identified.")),
        *[F.when(some(c), F.concat(lit(*section(name)), _lines(F.col(c)))).otherwise(none) for c, name in LISTS],
        F.when(some("tags"), tags(F.array_join("tags", ", "))).otherwise(none),
    ]
    return F.concat(F.array_join(F.concat(*parts), "\n"), F.lit("\n"))


def summary_markdown() -> Column:
    """A summary row (title, overview, key_points, action_items, people, organizations, topics, tags) as Markdown."""
    return _rendered("# ", "", "## Key points", "## Action items", lambda n: ["", f"## {n}"], ["## Overview", ""], lambda t: F.array(F.lit(""), F.lit("## Tags"), F.lit(""), t))


def summary_text() -> Column:
    """The same as plain text."""
    return _rendered("Title: ", "Overview: ", "Key points:", "Action items:", lambda n: ["", f"{n}:"], [], lambda t: F.array(F.lit(""), F.concat(F.lit("Tags: "), t)))


def summary_json() -> Column:
    """The same as JSON with all fields."""
    return F.to_json(F.struct("title", "overview", "key_points", "action_items", "people", "organizations", "topics", "tags"), {"ignoreNullFields": "false"})


def summary_body() -> Column:
    """Searchable prose of a summary row: overview, then the texts of key points and action items, blank ones left out."""
    edge = lambda x: F.regexp_replace(x, r"^[\r\n]+|[\r\n]+$", "")
    none = F.array().cast("array<string>")
    texts = lambda c: F.coalesce(F.transform(c, lambda x: edge(F.coalesce(x.text, F.lit("")))), none)
    return F.array_join(F.filter(F.concat(F.array(edge(F.coalesce("overview", F.lit("")))), texts("key_points"), texts("action_items")), lambda x: x != ""), "\n")


def summary_aux(tag_names: Column | None = None) -> Column:
    """Searchable names of a summary row: people, organisations, topics, and a section's tag names."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none) for c, _ in LISTS] + ([] if tag_names is None else [F.coalesce(tag_names, none)])
    return F.array_join(F.filter(F.transform(F.concat(*lists), strip), lambda x: x != ""), "\n")


def render_markdown(title: Column, overview: Column, points: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), overview, F.lit("\n\n"), F.array_join(key_point_lines(points), "\n"), F.lit("\n"))


PAYLOAD = "title string, overview string, key_points array<struct<text: string, level: int>>, tags array<string>"


def check_payloads(payloads: DataFrame, allowed: list[str], max_title: int = 255, max_points: int = 50) -> DataFrame:
    """id, fault (the first broken rule, `ok` for none), tags that are allowed, and unknown tags of payloads (id, raw)."""
    p = payloads.select("id", F.get_json_object("raw", "$").isNull().alias("bad"), F.from_json("raw", PAYLOAD).alias("j"))
    j = F.col("j")
    known = F.array(*[F.lit(t) for t in allowed])
    tags = F.coalesce(F.array_distinct(j["tags"]), F.array().cast("array<string>"))
    fault = (
        F.when(F.col("bad"), "malformed_json").when(j["title"].isNull() | (F.trim(j["title"]) == ""), "missing_title").when(F.length(j["title"]) > max_title, "long_title")
        .when(j["overview"].isNull(), "missing_overview").when(F.size(j["key_points"]) > max_points, "too_many_points")
        .when(F.exists(F.coalesce(j["key_points"], F.array().cast("array<struct<text: string, level: int>>")), lambda x: x.text.isNull() | ~x.level.between(0, 3)), "invalid_point").otherwise("ok")
    )
    return p.select("id", fault.alias("fault"), F.array_sort(F.array_intersect(tags, known)).alias("tags"), F.array_sort(F.array_except(tags, known)).alias("unknown_tags"))


def embedding_text(marker: str = "voxlake-embedding-v1") -> Column:
    """What a document's vector is made from: type, title, body and aux, each with its length in bytes."""
    part = lambda c: F.concat(F.lit(f"{c} "), F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n", F.lit(marker), part("doc_type"), part("title_text"), part("body_text"), part("aux_text"))
