"""Exact removal of repeated byte strings by column-wise Burrows-Wheeler construction over many documents.

Suffixes are compared in aligned collections. Every `length`-byte string picks an anchor inside
itself (the place of its least gram hash, first of equal ones), by its own bytes alone, so equal
strings pick equal anchors at equal offsets. Around each anchor that occurs more than once lies a
segment: all bytes of the strings that picked it. Segments of one anchor form a collection, laid
out with the anchor in the same column. From the last column to the first, each round inserts one
symbol for each segment, updates the order of all segment suffixes (the collection's transform)
and the common prefixes of neighbours; both, and the columns, are sequential files in the shared folder.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import forget, new_folder, returning_memory, small_batches, stored, table
from voxlake.llm.jaccard import BLOB, GATHER, U, _frame, _groups, _received, _send, mixed
from voxlake.llm.urls import listed_keys

LENGTH, GRAM = 200, 50
#: Distinct segments of one anchor that meet in a task; a larger collection is cut into chunks that meet pair by pair.
CHUNK = 20_000
#: Bytes of text for each group of collections that share their rounds, on average.
GROUP_BYTES = 4_000_000
#: Places of one segment that a task joins.
PLACES = 100_000
PAD = 256  # symbol outside a segment
PIECE = 1 << 19  # strings of a document that are looked at in one go
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 4096), _powers(_INVERSE, 4096)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every gram of bytes, from sums of bytes times powers of an odd base, modulo 2**64."""
    global _UP, _DOWN
    if len(data) >= len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * len(data)), _powers(_INVERSE, 2 * len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _UP[: len(data)], out=total[1:])
    return mixed((total[gram:] - total[:-gram]) * _DOWN[: len(data) + 1 - gram])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its hash, first string, last string) by place: the strings first..last pick that anchor."""
    strings = len(data) - length + 1
    if strings <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(U), none, none
    span = length - gram + 1
    found = []
    for start in range(0, strings, PIECE):
        n = min(PIECE, strings - start)
        h = gram_hashes(data[start : start + n + length - 1], gram)
        key = (h & ~U((1 << 21) - 1)) | np.arange(len(h), dtype=U)
        rows = -(-len(key) // span)
        grid = np.full(rows * span, ~U(0), U)
        grid[: len(key)] = key
        grid = grid.reshape(rows, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
        pick = (least & U((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, pick[1:] != pick[:-1]))
        last = np.append(first[1:], n) - 1
        found.append((pick[first] + start, h[pick[first]], first + start, last + start))
    return tuple(np.concatenate(c) for c in zip(*found))


def repeated_strings(segments: list[bytes], left: list[int], collection: np.ndarray, length: int = LENGTH, gram: int = GRAM, folder: str | None = None) -> np.ndarray:
    """(segments, length - gram + 1) booleans: whether the string that starts in a column occurs in another segment of its collection.

    left: how many bytes a segment has before its anchor. The columns of symbols and, after each round,
    the order of all suffixes (whose symbols are the collection's transform) and the common
    prefixes of neighbours are files below folder (a URI) that are written and read from front to back; a
    round holds one column and one state.
    """
    span = length - gram
    width, m = 2 * span + gram, len(segments)
    out = np.zeros((m, span + 1), bool)
    if m < 2:
        return out
    with _Files(folder) as files:
        grid = np.full((m, width), PAD, np.uint16)
        for i, (s, before) in enumerate(zip(segments, left)):
            grid[i, span - before : span - before + len(s)] = np.frombuffer(s, np.uint8)
        files.write("columns", (np.ascontiguousarray(grid[:, j]) for j in range(width - 1, -1, -1)))
        del grid
        group = np.unique(collection, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(group, kind="stable")
        common = np.where(np.append(True, group[order][1:] != group[order][:-1]), -1, 0)  # -1: another collection
        files.write("state-0", (order.astype(np.int32), common.astype(np.int16)))
        columns = files.read("columns")
        for turn, j in enumerate(range(width - 1, -1, -1)):
            state = files.read(f"state-{turn}")
            order, common = np.frombuffer(state.read(4 * m), np.int32), np.frombuffer(state.read(2 * m), np.int16).astype(np.int64)
            files.drop(f"state-{turn}")
            g = group[order]
            key = g * (PAD + 1) + np.frombuffer(columns.read(2 * m), np.uint16)[order]  # the transform, by collection
            place = np.argsort(key, kind="stable")
            key = key[place]
            same = np.append(False, key[1:] == key[:-1])
            fresh = np.where(np.append(True, g[place][1:] != g[place][:-1]), -1, 0)
            at = np.flatnonzero(same)
            if len(at):
                fresh[at] = np.minimum(length, 1 + _range_min(common, place[at - 1] + 1, place[at]))
            order, common = order[place], fresh
            files.write(f"state-{turn + 1}", (order, common.astype(np.int16)))
            if j <= span:
                hit = common >= length
                both = hit.copy()
                both[:-1] |= hit[1:]
                out[order[both], j] = True
    return out


class _Files:
    """Sequential files in a folder of their own below a URI that all executors can write to, gone at the end; a task that dies leaves them behind, and its next try takes another folder."""

    def __init__(self, folder: str | None):
        self.fs, self.path = pa_fs.FileSystem.from_uri(f"{folder or 'file://' + tempfile.gettempdir()}/columns-{uuid.uuid4().hex}")

    def __enter__(self) -> _Files:
        self.fs.create_dir(self.path)
        return self

    def __exit__(self, *_) -> None:
        self.fs.delete_dir(self.path)

    def write(self, name: str, parts) -> None:
        with self.fs.open_output_stream(f"{self.path}/{name}", buffer_size=1 << 20) as f:
            for part in parts:
                f.write(part.tobytes())

    def read(self, name: str):
        return self.fs.open_input_stream(f"{self.path}/{name}", buffer_size=1 << 20)

    def drop(self, name: str) -> None:
        self.fs.delete_file(f"{self.path}/{name}")


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high] for each pair, both ends included, from doubling tables."""
    need = high - low + 1
    out = np.empty(len(low), values.dtype)
    level = np.frexp(need.astype(float))[1] - 1
    row, step = values, 1
    for k in range(int(level.max()) + 1):
        now = level == k
        if now.any():
            out[now] = np.minimum(row[low[now]], row[high[now] - step + 1])
        row, step = np.minimum(row[:-step], row[step:]) if len(row) > step else row, 2 * step
    return out


def _pick_hashes(batch: pa.RecordBatch, length: int, gram: int):
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        data = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)
        yield key, data, anchors(data, length, gram)


def _shared_anchors(texts: DataFrame, groups: int, length: int, gram: int) -> DataFrame:
    """(key, hashes): for each text (key, text) the anchors' hashes that also occur elsewhere, in one or more rows."""
    names = ["key", "hashes"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            once = []
            for k, h in held.items():
                u, n = np.unique(h, return_counts=True)
                once.append(u)
                if (n > 1).any():
                    rows.append({"p": k % groups, "key": k, "tokens": u[n > 1].tobytes()})
            keys = np.fromiter(held, np.int64, len(held))
            toks = np.concatenate([np.zeros(0, U), *once])
            yield _frame(rows + _send(keys, np.repeat(np.arange(len(keys)), [len(u) for u in once]), toks, groups))

        for batch in returning_memory(batches):
            for key, _, (_, h, _, _) in _pick_hashes(batch, length, gram):
                if len(h) and key not in held:
                    held[key] = h
                    size += len(h)
            if size >= GATHER:
                yield from flush()
                held, size = {}, 0
        if held:
            yield from flush()

    def count(group: pa.Table) -> pa.Table:
        own = group.filter(group["key"].is_valid())
        toks, keys = _received(group.filter(group["key"].is_null()))
        first = np.flatnonzero(np.append(True, toks[1:] != toks[:-1])) if len(toks) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(toks)))
        shared = np.repeat(keys[first] != keys[first + size - 1], size)
        toks, keys = toks[shared], keys[shared]
        order = np.argsort(keys, kind="stable")
        toks, keys = toks[order], keys[order]
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        blobs = [toks[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(keys)])]
        more = pa.table([pa.array(keys[cut], pa.int64()), pa.array(blobs, pa.binary())], names)
        return pa.concat_tables([own.select(["key", "tokens"]).rename_columns(names), more])

    return texts.mapInArrow(send, BLOB).groupBy("p").applyInArrow(count, "key long, hashes binary")


def _segment_key(segment: bytes, before: int) -> int:
    return xxhash.xxh3_64_intdigest(segment, seed=before) >> 1


def _segments(texts: DataFrame, with_bytes: bool, length: int, gram: int) -> DataFrame:
    """Rows of texts' (key, text, wanted) shared anchors: (key, anchor, lo, hi, seg), or distinct (anchor, seg, left, bytes) for wanted segments.

    wanted: packed hashes of anchors, or an array of segment keys with with_bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in returning_memory(batches):
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                cols: list[list] = [[], [], [], [], []]
                for (key, data, (at, h, lo, hi)), wanted in zip(_pick_hashes(batch, length, gram), batch.column(2)):
                    raw = data.tobytes()
                    if with_bytes:
                        take, chosen = np.arange(len(h)), set(wanted.as_py())
                    else:
                        take = np.flatnonzero(np.isin(h, np.frombuffer(b"".join(wanted.as_py()), U)))
                    for i in take.tolist():
                        a, b, c = int(lo[i]), int(hi[i]), int(at[i])
                        piece = raw[a : b + length]
                        seg = _segment_key(piece, c - a)
                        if not with_bytes:
                            row = (key, int(h[i]) >> 1, a, b, seg)
                        elif seg in chosen:
                            row = (int(h[i]) >> 1, seg, c - a, b - a, piece)
                        else:
                            continue
                        for col, v in zip(cols, row):
                            col.append(v)
                kinds = [pa.int64()] * 4 + [pa.binary() if with_bytes else pa.int64()]
                names = ["anchor", "seg", "left", "more", "bytes"] if with_bytes else ["key", "anchor", "lo", "hi", "seg"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    schema = "anchor long, seg long, left long, more long, bytes binary" if with_bytes else "key long, anchor long, lo long, hi long, seg long"
    return texts.mapInArrow(run, schema)


def _compare(segments: DataFrame, seen: DataFrame, groups: int, length: int, gram: int) -> DataFrame:
    """(seg, firsts, lasts): for each segment the runs of columns (counted from its first byte) whose strings occur elsewhere in its collection.

    seen: anchor, seg, n. A segment that occurs more than once is in its collection twice, so the construction
    finds its strings repeated. A collection of more than CHUNK distinct segments is cut into
    chunks, and each pair of its chunks is a group of its own: any two segments still meet.
    """
    chunks = seen.groupBy("anchor").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = segments.join(chunks, "anchor").join(seen.select("anchor", "seg", "n"), ["anchor", "seg"])
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("seg"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pair = F.concat_ws(":", "anchor", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = dealt.withColumn("p", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("string")).otherwise(pair))
    span = length - gram
    folder = new_folder(segments.sparkSession, "columns")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        anchor, seg, left, more, n = (group[c].to_numpy() for c in ("anchor", "seg", "left", "more", "n"))
        data = group["bytes"].to_pylist()
        twice = np.flatnonzero(n > 1)
        found = repeated_strings(data + [data[i] for i in twice], [*left.tolist(), *left[twice].tolist()], np.append(anchor, anchor[twice]), length, gram, folder)
        firsts, lasts = [], []
        for row, before, last in zip(found, left.tolist(), more.tolist()):
            own = np.diff(np.concatenate([[0], row[span - before : span - before + last + 1].astype(np.int8), [0]]))
            firsts.append(np.flatnonzero(own == 1).tolist())
            lasts.append((np.flatnonzero(own == -1) - 1).tolist())
        cols = [pa.array(seg, pa.int64()), pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32()))]
        return pa.table(cols, ["seg", "firsts", "lasts"])

    return dealt.select("p", "anchor", "seg", "left", "more", "bytes", "n").groupBy("p").applyInArrow(run, "seg long, firsts array<int>, lasts array<int>")


def spans_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, to) of bytes that strings with these starts cover; runs that touch are one."""
    starts = np.unique(starts)
    if not len(starts):
        return starts, starts
    first = np.append(True, starts[1:] > starts[:-1] + length)
    return starts[first], starts[np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)] + length


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts) for docs (doc_id, text): rows has doc_id, key, n_bytes, sha, copies of every row; cuts has key, from, to, kept_sha256, n_removed, kept for texts that lose bytes.

    key names a text (60 bits of its SHA-256). Texts that occur more than once lose everything if
    they have `length` bytes; they are looked at once, so a large group of copies is one text.
    """
    spark = small_batches(docs).sparkSession
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.select("doc_id", data.alias("data")).withColumn("sha", F.sha2("data", 256))
    keyed = keyed.withColumn("key", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))
    rows = stored(keyed.select("doc_id", "key", F.octet_length("data").cast("long").alias("n_bytes"), "sha"), "rows")
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    long_enough = keyed.filter(F.octet_length("data") >= length).select("key", F.col("data").alias("text"))
    shared = stored(_shared_anchors(long_enough, _groups(spark, size / 40), length, gram), "anchors")
    wanted = shared.groupBy("key").agg(F.collect_list("hashes").alias("wanted"))
    some = listed_keys(long_enough.withColumnRenamed("key", "_key"), shared.select(F.col("key").alias("_key")).distinct()).filter("_listed")
    texts = some.select(F.col("_key").alias("key"), "text").join(wanted, "key").dropDuplicates(["key"])
    texts = stored(texts.select("key", "text", "wanted"), "texts")

    places = stored(_segments(texts, False, length, gram), "places")
    seen = places.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    some = seen.groupBy("anchor").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("anchor")
    seen = stored(seen.join(some, "anchor", "left_semi"), "seen")  # collections of one place hold no repeat
    asked = seen.groupBy("key").agg(F.collect_set("seg").alias("wanted"))
    pieces = _segments(texts.select("key", "text").join(asked, "key").select("key", "text", "wanted"), True, length, gram).dropDuplicates(["anchor", "seg"])
    few = max(2 * spark.sparkContext.defaultParallelism, int(size // GROUP_BYTES) + 1)  # a round of a small group costs as much as one of a large one
    compared = stored(_compare(pieces, seen, few, length, gram).filter(F.size("firsts") > 0), "compared")

    # a segment with very many places is dealt by text as well, so that no task holds all of them
    often = seen.groupBy("seg").agg(F.sum("n").alias("n")).filter(F.col("n") > PLACES)
    often = often.select("seg", F.ceil(F.col("n") / PLACES).alias("parts"))  # never more rows than places / PLACES
    parts = lambda df: df.join(F.broadcast(often), "seg", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    mine = parts(places).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    told = parts(compared).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    runs = mine.select("key", "seg", "part", "lo").join(told.select("seg", "part", "firsts", "lasts"), ["seg", "part"])
    runs = runs.select("key", F.transform("firsts", lambda x: F.col("lo") + x).alias("firsts"), F.transform("lasts", lambda x: F.col("lo") + x).alias("lasts"))
    found = runs.groupBy("key").agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("lasts")).alias("lasts"))
    cuts = stored(_cut(texts.select("key", "text").join(found, "key"), length), "cuts")
    forget(shared, texts, places, seen, compared)
    return rows, cuts


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Kept bytes and removed runs of each text (key, text, firsts, lasts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in returning_memory(batches):
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                cols: list[list] = [[], [], [], [], [], []]
                for key, text, firsts, lasts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                    data = text.as_buffer().to_pybytes()
                    a, b = firsts.values.to_numpy(), lasts.values.to_numpy()
                    mark = np.zeros(len(data) + 1, np.int64)
                    np.add.at(mark, a, 1)
                    np.add.at(mark, b + 1, -1)
                    begin, end = spans_of(np.flatnonzero(np.cumsum(mark)[:-1] > 0), length)
                    kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
                    for col, v in zip(cols, (key, begin.tolist(), end.tolist(), kept, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))):
                        col.append(v)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), longs, longs, pa.binary(), pa.string(), pa.string()))], ["key", "from", "to", "kept", "kept_sha256", "kept_text"])

    return texts.select("key", "text", "firsts", "lasts").mapInArrow(run, "key long, from array<long>, to array<long>, kept binary, kept_sha256 string, kept_text string")


def repeats_removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (null: the text unchanged) for each row of docs (doc_id, text).

    A byte goes if a `length`-byte string that covers it also starts anywhere else in the input,
    the same document included. Null and empty texts are no bytes and lose none; texts shorter
    than `length` stay; repeated rows and ids each give their row, and null ids stay null; an
    empty table gives an empty result; other columns are ignored.
    """
    rows, cuts = repeated_spans(docs, length, gram)
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("gone"))
    cuts = cuts.withColumn("n_removed", F.expr("aggregate(zip_with(to, from, (t, f) -> t - f), 0L, (a, x) -> a + x)"))
    found = rows.join(copies, "key", "left").join(cuts, "key", "left")
    gone = F.coalesce("gone", F.lit(False))
    return found.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.when(F.col("from").isNull(), 0).otherwise(F.size("from"))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated byte strings cut out of text; the other columns stay, n_chars follows the text where there is one.

    Characters that lose a byte go whole. Rows stay even if nothing of their text does.
    """
    rows, cuts = repeated_spans(docs, length, gram)
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("_key"), F.lit("").alias("_left"))
    left = cuts.select(F.col("key").alias("_key"), "kept_text").join(copies.select("_key"), "_key", "left_anti").withColumnRenamed("kept_text", "_left").unionByName(copies)
    left = stored(left, "left")
    key = F.conv(F.substring(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256), 1, 15), 16, 10).cast("long")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"))  # whole rows, whatever their columns are called
    dealt = listed_keys(packed, left.select("_key"))
    row = F.col("_row").withField("text", F.col("_left"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_left").cast(docs.schema["n_chars"].dataType))
    changed = dealt.filter("_listed").join(left, "_key").select(row.alias("_row"))
    return dealt.filter("not _listed").select("_row.*").unionByName(changed.select("_row.*"))


def op1_suffix_dedup(spark, sf_dir):
    return repeats_removed(table(spark, sf_dir, "documents")).drop("kept")
