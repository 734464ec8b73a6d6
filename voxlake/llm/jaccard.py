"""Exact Jaccard join of word-shingle sets by universe partition and the pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import forget, returning_memory, small_batches, stored, table
from voxlake.llm.urls import listed_keys

WORDS, NUM, DEN = 5, 75, 100
#: Tokens that a task gathers before it sends them on, and tokens of a group of the shuffle, on average.
GATHER, GROUP = 1_000_000, 1_000_000
#: Segments per difference that the pigeonhole principle asks for: with more, true pairs share many segments.
SLACK = 1.5
#: Rounds that join clusters through likely links before what remains is compared exhaustively.
ROUNDS = 1
#: Centers that a set is compared with in such a round.
TRIES = 3
#: Tokens of a block in the final comparison, on average.
BLOCK_TOKENS = 1_000_000
#: One in so many index entries serves those rounds; the final comparison uses all of them.
LIKELY = 4
U = np.uint64
A, B, C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # odd multipliers of splitmix64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * B
    x = (x ^ (x >> U(27))) * C
    return x ^ (x >> U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; one for all words if there are fewer; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, U)
    h = np.array([*map(xxhash.xxh3_64_intdigest, found)], U)
    if len(h) < words:
        return mixed(np.atleast_1d((h * (A ** np.arange(1, len(h) + 1, dtype=U))).sum(dtype=U) + U(len(h))))
    total = np.zeros(len(h) - words + 1, U)
    for j in range(words):
        total = (total + h[j : j + len(total)]) * A
    return np.unique(mixed(total))


def set_key(tokens: np.ndarray) -> int:
    """63-bit identity of a set, for nodes of the link graph."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def band_starts(largest: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """First size of each band; linked sets lie in the same band or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * den // num)))
    return np.array(starts, np.int64)


def allocate(low: int, high: int, difference: int) -> tuple[int, int, int]:
    """(segments compared exactly, segments compared up to one deletion, differences) for a pair of bands.

    x exact and y one-deletion segments catch every pair if x + 2y > difference. The exact plan
    takes SLACK times as many; its price is one entry a segment, plus what its empty segments
    cost, as they match everywhere. The deletion plan's price is an entry a token and segment.
    """
    size = max(1, low)
    exact = max(difference + 1, int(SLACK * (difference + 1)))
    near = (difference + 1) // 2
    rest = difference + 1 - 2 * near
    empty = np.exp(-size / exact) * exact
    price_exact = exact + (200 * empty if empty + 2 * np.sqrt(empty) > exact - difference else 0)
    return (exact, 0, difference) if price_exact <= size + near + rest + 1 else (rest, near, difference)


def plan(group: int, starts: np.ndarray, num: int, den: int) -> tuple[int, int, int]:
    """allocate() for the bands group and group + 1."""
    low, high = int(starts[group]), int(starts[min(group + 2, len(starts) - 1)]) - 1
    mid = int(starts[group + 1]) - 1
    return allocate(low, high, (den - num) * (mid + high) // (den + num))


def segment_of(tokens: np.ndarray, m: int) -> np.ndarray:
    return (((tokens >> U(32)) * U(m)) >> U(32)).astype(np.int64)


def needed(tokens: np.ndarray, group: int, starts: np.ndarray, num: int = NUM, den: int = DEN) -> int:
    """How many entries, at least, this set shares in the pair of bands with every set that it links to.

    At most `difference` segments of a linked pair differ. The equal ones are entries of both sets,
    but for segments that are empty in both: no more than this set has.
    """
    exact, near, difference = plan(group, starts, num, den)
    if near:
        return 1
    return max(1, len(np.unique(segment_of(tokens, exact))) - difference)


def signatures(tokens: np.ndarray, group: int, starts: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Index entries of a set for the bands group and group + 1: its segments' contents, or those and all one-deletion neighbours."""
    n = len(tokens)
    exact, near, difference = plan(group, starts, num, den)
    m = exact + near
    seg = segment_of(tokens, m)
    first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
    item = mixed(tokens + A)
    sums = np.add.reduceat(item, first)
    which = seg[first]
    base = U((group + 1) * int(A) % 2**64)
    tag = lambda s, w: mixed(s + mixed(base + w.astype(U) * C))
    out = [tag(sums, which)]
    empties = np.setdiff1d(np.arange(m), which) if m - len(which) else np.zeros(0, np.int64)
    if near or m - len(which) >= m - difference:
        out.append(tag(np.zeros(len(empties), U), empties))
    if near:  # the first `exact` segments are compared exactly
        soft = seg >= exact
        whole = np.repeat(sums, np.diff(np.append(first, n)))
        out.append(tag(whole[soft] - item[soft], seg[soft]))
    return np.unique(np.concatenate(out) & ~U(2) | U(2 * (group & 1)))  # bit 1 tells the two pairs of bands of a set apart


def _send(keys: np.ndarray, of: np.ndarray, tokens: np.ndarray, groups: int) -> list[dict]:
    """Rows for the shuffle: tokens by hash range, each with the place of its set among keys."""
    p = ((mixed(tokens) >> U(40)) % U(groups)).astype(np.int64)
    order = np.lexsort((of, p))
    p, of, tokens = p[order], of[order], tokens[order]
    cut = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else []
    rows = []
    for a, b in zip(cut, [*cut[1:], len(p)]):
        held, at = np.unique(of[a:b], return_inverse=True)
        rows.append({"p": int(p[a]), "keys": keys[held].tobytes(), "places": np.diff(at, prepend=0).astype(np.uint16 if len(held) < 65536 else np.uint32).tobytes(), "tokens": tokens[a:b].tobytes()})
    return rows


def _received(group: pa.Table, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, keys) of a group, sorted by both; with a width, keys are rows of so many numbers."""
    shape = (-1,) if width == 1 else (-1, width)
    toks, keys = [np.zeros(0, U)], [np.zeros(0, np.int64).reshape(shape)]
    for k, places, t in zip(*([x.as_buffer() for x in group[c] if x.is_valid] for c in ("keys", "places", "tokens"))):
        places = memoryview(places)
        t, k = np.frombuffer(t, U), np.frombuffer(k, np.int64).reshape(shape)
        at = np.cumsum(np.frombuffer(places, np.uint16 if places.nbytes == 2 * len(t) else np.uint32).astype(np.int64))
        toks.append(t)
        keys.append(k[at])
    toks, keys = np.concatenate(toks), np.concatenate(keys)
    order = np.lexsort((keys if width == 1 else keys[:, 0], toks))
    return toks[order], keys[order]


BLOB = "p int, doc_id long, t long, n long, c long, key long, shared long, keys binary, places binary, tokens binary"


def _frame(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"p": pa.int32(), "keys": pa.binary(), "places": pa.binary(), "tokens": pa.binary()}
    cols = ["p", "doc_id", "t", "n", "c", "key", "shared", "keys", "places", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.int64())) for c in cols], cols)


def _support(sets: DataFrame, read, half: bool, groups: int) -> DataFrame:
    """(doc_id, t, n, c, key, shared): a row for each input row, and rows that add to a key's shared.

    shared counts (never too low) how many of a set's c looked-at tokens some other set holds. half:
    only tokens in the upper half of the hash range are looked at.
    """
    names = ["doc_id", "t", "n", "c", "key", "shared"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, which = np.unique(np.array([k for k, _ in held], np.int64), return_index=True)
            looked = [held[i][1] for i in which]
            of = np.repeat(np.arange(len(keys)), [len(t) for t in looked])
            toks = np.concatenate([np.zeros(0, U), *looked])
            order = np.argsort(toks, kind="stable")
            toks, of = toks[order], of[order]
            same = toks[1:] == toks[:-1] if len(toks) else np.zeros(0, bool)
            again, before = np.append(False, same)[: len(toks)], np.append(same, False)[: len(toks)]
            known = np.bincount(of[again | before], minlength=len(keys))
            third = np.append([False, False], again[2:] & again[1:-1])[: len(toks)] if len(toks) > 2 else np.zeros(len(toks), bool)
            rows = [{"p": int(k % groups), "key": int(k), "shared": int(s)} for k, s in zip(keys, known) if s]
            yield _frame(rows + _send(keys, of[~third], toks[~third], groups))  # two sets are enough to make a token shared

        for batch in returning_memory(batches):
            rows = []
            for doc_id, t, key, toks in read(batch):
                looked = toks[np.searchsorted(toks, U(1) << U(63)) :] if half else toks
                rows.append({"p": key % groups, "doc_id": doc_id, "t": t, "n": len(toks), "c": len(looked), "key": key})
                if len(looked):
                    held.append((key, looked))
                    size += len(looked)
                if size >= GATHER:
                    yield from flush()
                    held, size = [], 0
            yield _frame(rows)
        if held:
            yield from flush()

    def count(group: pa.Table) -> pa.Table:
        toks, keys = _received(group)
        first = np.flatnonzero(np.append(True, toks[1:] != toks[:-1])) if len(toks) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(toks)))
        shared = np.repeat(keys[first] != keys[first + size - 1], size)
        held, number = np.unique(keys[shared], return_counts=True)
        number = number.astype(np.int64)
        q = held % groups
        order = np.argsort(q, kind="stable")
        held, number, q = held[order], number[order], q[order]
        cut = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        spans = [*zip(cut.tolist(), [*cut[1:].tolist(), len(q)])]
        none = pa.nulls(len(cut), pa.int64())
        packed = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (held, number)]
        more = pa.table([pa.array(q[cut], pa.int32()), *[none] * len(names), *packed], ["p", *names, "held", "number"])
        plain = group.filter(pc.is_null(group["tokens"])).select(["p", *names])
        blank = pa.nulls(plain.num_rows, pa.binary())
        return pa.concat_tables([plain.append_column("held", blank).append_column("number", blank), more])

    def add(group: pa.Table) -> pa.Table:
        """The sums of a range of keys: one row a key, beside the input's rows."""
        blobs = group.filter(group["held"].is_valid())
        parts = [[np.frombuffer(x.as_buffer(), np.int64) for x in blobs[c]] for c in ("held", "number")]
        held, at = np.unique(np.concatenate([np.zeros(0, np.int64), *parts[0]]), return_inverse=True)
        number = np.bincount(at, weights=np.concatenate([np.zeros(0, np.int64), *parts[1]]), minlength=len(held)).astype(np.int64)
        none = pa.nulls(len(held), pa.int64())
        sums = pa.table([none, none, none, none, pa.array(held, pa.int64()), pa.array(number, pa.int64())], names)
        return pa.concat_tables([group.filter(group["held"].is_null()).select(names), sums])

    schema = ", ".join(f"{n} long" for n in names)
    counted = sets.mapInArrow(send, BLOB).groupBy("p").applyInArrow(count, f"p int, {schema}, held binary, number binary")
    return counted.groupBy("p").applyInArrow(add, schema)


def _groups(spark, tokens: float) -> int:
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens // GROUP) + 1)


def _living(support: DataFrame, num: int, den: int) -> DataFrame:
    """(key, doc_id, t, n): sets that can have a partner, each with the id of one of its rows, and a text's hash where no row has an id: all but n - ceil(n num/den) tokens must be shared."""
    sums = support.groupBy("key").agg(F.max("n").alias("n"), F.max("c").alias("c"), F.sum("shared").alias("shared"), F.min("doc_id").alias("doc_id"), F.min("t").alias("t"))
    spare = F.expr(f"n - ({num} * n + {den - 1}) div {den}")
    return sums.filter((F.col("n") > 0) & (F.coalesce("shared", F.lit(0)) >= F.col("c") - spare)).select("key", "doc_id", "t", "n")


def _sets_of(docs: DataFrame, living: DataFrame, words: int) -> DataFrame:
    """(key, n, tokens) of the chosen sets, hashed again from their texts."""
    chosen = living.filter("doc_id is not null").select("key", F.col("doc_id").alias("_key"))
    near = listed_keys(docs.select(F.col("doc_id").alias("_key"), "text"), chosen.select("_key").distinct()).filter("_listed").select("_key", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in returning_memory(batches):
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [(k, shingles(t, words)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                found = [(k, t) for k, t in found if set_key(t) == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([len(t) for _, t in found], pa.int64()), pa.array([t.tobytes() for _, t in found], pa.binary())], ["key", "n", "tokens"])

    bare = living.filter("doc_id is null").select("key", "t")
    lone = docs.filter("doc_id is null").select(F.xxhash64("text").alias("t"), "text").dropDuplicates().join(bare, "t").select("key", "text")
    return near.join(chosen, "_key").select("key", "text").unionByName(lone).mapInArrow(read, "key long, n long, tokens binary").dropDuplicates(["key"])


def _read_sets(batch: pa.RecordBatch):
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        yield None, None, k, np.frombuffer(t, U)


def _candidates(sets: DataFrame, groups: int, starts: np.ndarray, num: int, den: int, one_in: int) -> DataFrame:
    """(cell, key, root, weight, members): which sets of different clusters share index entries.

    sets: key, tokens, root (the cluster so far). A cell stands for `weight` entries of one pair of
    bands (told by the cell's last bit) that the same `members` sets share; entries whose sets are
    all of one cluster are left out. one_in: looks at one in so many entries, 1 for all.
    """
    names = ["cell", "key", "root", "weight", "members"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sigs, size = [], [], 0
        for batch in batches:
            for (_, _, key, toks), root in zip(_read_sets(batch), batch.column(2).to_pylist()):
                band = int(np.searchsorted(starts, len(toks), "right")) - 1
                found = np.concatenate([signatures(toks, g, starts, num, den) for g in (band - 1, band) if g >= 0])
                found = found[(found >> U(8)) % U(one_in) == 0] if one_in > 1 else found
                nodes.append((key, root))
                sigs.append(found)
                size += len(found)
                if size >= GATHER:
                    yield _frame(_send(np.array(nodes, np.int64), np.repeat(np.arange(len(nodes)), [len(s) for s in sigs]), np.concatenate(sigs), groups))
                    nodes, sigs, size = [], [], 0
        if nodes:
            yield _frame(_send(np.array(nodes, np.int64), np.repeat(np.arange(len(nodes)), [len(s) for s in sigs]), np.concatenate(sigs), groups))

    def gather(group: pa.Table) -> pa.Table:
        sig, node = _received(group, 2)
        key, root = node[:, 0], node[:, 1]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
        if not len(first):
            return pa.table([pa.array([], pa.int64())] * 5, names)
        size = np.diff(np.append(first, len(sig)))
        several = np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), size)
        sig, key, root = sig[several], key[several], root[several]
        if not len(sig):
            return pa.table([pa.array([], pa.int64())] * 5, names)
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(first, len(sig)))
        parity = sig[first] & U(2)
        content = mixed(np.add.reduceat(mixed(key.astype(U) + A), first) + parity)
        _, rep, weight = np.unique(content, return_index=True, return_counts=True)
        share = np.zeros(len(first), np.int64)
        share[rep] = weight
        rows = np.repeat(share > 0, size)
        sig, key, root, size, share = sig[rows], key[rows], root[rows], size[share > 0], share[share > 0]
        cols = (sig >> U(1)).astype(np.int64), key, root, np.repeat(share, size), np.repeat(size, size)
        return pa.table([pa.array(c, pa.int64()) for c in cols], names)

    return sets.select("key", "tokens", "root").mapInArrow(send, BLOB).groupBy("p").applyInArrow(gather, ", ".join(f"{n} long" for n in names))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection."""
    one = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    fits = (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                good.append(both * den >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").filter(fits).select("a", "b", "t_a", "t_b").mapInArrow(check, "a long, b long")


def _stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    roles = edges.select(F.col("a").alias("k"), F.lit(1).alias("r")).unionByName(edges.select(F.col("b").alias("k"), F.lit(2).alias("r")))
    odd = roles.groupBy("k").agg(F.bit_or("r").alias("r"), F.count_if(F.col("r") == 1).alias("n")).filter("r = 3 or n > 1")
    return not odd.limit(1).count()


def connected(edges: DataFrame, label: str) -> DataFrame:
    """(key, root) for every node of edges (a, b): root is the smallest key of its component.

    Alternating large-star and small-star steps; each step is a table in the shared folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not _stars(now):
        least = both(now).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both(now).join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.filter("a <> b").distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b")))
        before, now = now, stored(small.filter("a <> b").distinct(), label)
        forget(before)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("key"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("key"), "root").distinct())


def jaccard_classes(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """n_shingles and component_id for every row of docs (doc_id, text), whose shingle sets link at Jaccard >= num/den.

    Steps: a cheap exact test removes sets that cannot have a partner (too few of their shingles occur
    elsewhere); the others enter the universe-partition index; likely links join clusters first, then
    every pair that shares enough entries and still lies in different clusters is compared. Null, empty or
    word-less texts have no shingles and link with nothing; equal texts are in one class whatever
    their number; null ids stay null unless their class has another row; repeated ids are kept;
    other columns are ignored; an empty table gives an empty result. component_id is the smallest
    doc_id of the class.
    """
    return _classes(_labelled_rows(docs, words, num, den))


def _labelled_rows(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, t, n, label) for every row of docs: t is its text's hash, label its class, null without shingles."""
    spark = small_batches(docs).sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def read(batch: pa.RecordBatch):
        for doc_id, text, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            toks = shingles(text, words)
            yield doc_id, t, set_key(toks), toks

    support = stored(_support(docs, read, True, _groups(spark, size / 12)), "support")
    rows = support.filter("n is not null").select("doc_id", "t", "n", "key")
    sets = stored(_sets_of(docs, _living(support, num, den), words), "sets")
    totals = sets.agg(F.sum("n"), F.max("n")).first()
    if not totals[0]:
        return _labelled(rows, None)
    again = _support(sets.select("key", "tokens"), _read_sets, False, _groups(spark, totals[0]))
    alive = _living(again.withColumn("doc_id", F.col("key")), num, den).select("key")
    first, sets = sets, stored(sets.join(alive, "key", "left_semi"), "living")
    forget(first)
    starts, groups = band_starts(int(totals[1]) * 2, num, den), _groups(spark, totals[0])
    links = roots = None
    for turn in range(ROUNDS):
        cells = stored(_candidates(_rooted(sets, roots), groups, starts, num, den, LIKELY), "cells")
        degree = cells.groupBy("key").agg(F.sum("weight").alias("degree"))
        mark = F.struct(F.col("degree") if turn % 2 == 0 else F.xxhash64("key", F.lit(turn)), "key")
        center = cells.join(degree, "key").groupBy("cell").agg(F.max_by(F.struct("key", "root"), mark).alias("c"))
        likely = cells.join(center, "cell").filter("root <> c.root").groupBy(F.col("key").alias("b"), F.col("c.key").alias("a")).agg(F.sum("weight").alias("w"))
        likely = likely.groupBy("b").agg(F.expr(f"slice(sort_array(collect_list(struct(w, a)), false), 1, {TRIES})").alias("best")).select("b", F.explode("best.a").alias("a"))
        found = stored(_verified(likely, sets, num, den), "links")
        forget(cells)
        links = found if links is None else links.unionByName(found)
        roots = stored(connected(links, "stars"), "roots")
    cells = stored(_candidates(_rooted(sets, roots), groups, starts, num, den, 1), "cells")
    links = links.unionByName(stored(_remaining_links(cells, sets, starts, num, den), "links"))
    forget(cells, sets)
    return _labelled(rows, stored(connected(links, "stars"), "roots"))


def _remaining_links(cells: DataFrame, sets: DataFrame, starts: np.ndarray, num: int, den: int) -> DataFrame:
    """Links (a, b) that join what cells still hold apart: enough of them to connect all that is linked.

    A set leaves out its entries with most members, as long as a linked partner must still share one with it:
    needed() says how many they share at least, and all sets leave entries out in the same order. Sets
    that the other entries connect form a neighbourhood; only inside one can links remain. One of more
    than BLOCK_TOKENS tokens is cut into blocks, and each pair of its blocks is a group of the shuffle
    under a key of its own. No pairs leave a task but links found.
    """
    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, key, toks in _read_sets(batch):
                band = int(np.searchsorted(starts, len(toks), "right")) - 1
                rows += [(key, g & 1, needed(toks, g, starts, num, den)) for g in (band - 1, band) if g >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["key", "side", "need"])

    need = sets.select("key", "tokens").mapInArrow(needs, "key long, side long, need long")
    hottest = Window.partitionBy("key", "side").orderBy(F.desc("members"), F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    own = cells.withColumn("side", F.col("cell").bitwiseAND(F.lit(1))).join(need, ["key", "side"])
    own = stored(own.withColumn("out", F.sum("weight").over(hottest)).filter("out >= need").select("cell", "key", "root"), "entries")
    first = own.groupBy("cell").agg(F.min("key").alias("a"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("cell", "a")
    near = stored(connected(own.join(first, "cell").select("a", F.col("key").alias("b")).distinct(), "stars"), "near")
    near = near.select("key", F.col("root").alias("place"))
    large = near.join(sets.select("key", "n"), "key").groupBy("place").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK_TOKENS)
    blocks = large.select("place", F.ceil(F.col("n") / BLOCK_TOKENS).alias("blocks"))  # never more rows than tokens / BLOCK_TOKENS
    held = near.join(F.broadcast(blocks), "place", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    held = held.join(own.groupBy("key").agg(F.min("root").alias("root")), "key").join(sets.select("key", "tokens"), "key")
    mine = F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks"))
    dealt = held.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    dealt = dealt.select(F.concat_ws(":", "place", "i", "j").alias("task"), "i", "j", "mine", "key", "root", "tokens")

    def compare(group: pa.Table) -> pa.Table:
        keys, roots, side = (group[c].to_numpy() for c in ("key", "root", "mine"))
        data = [np.frombuffer(t.as_buffer(), U) for t in group["tokens"]]
        size = np.array([len(t) for t in data])
        across = group["i"][0].as_py() != group["j"][0].as_py()
        token = np.unique(np.concatenate(data), return_inverse=True)[1]
        of = np.repeat(np.arange(len(data)), size)
        ends = np.cumsum(size)
        names, root, members = np.unique(roots, return_inverse=True, return_counts=True)
        parent = np.arange(len(names))

        def top(r: int) -> int:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        found = []
        asks = root != int(np.argmax(members))  # sets of the largest cluster need not ask: the others ask them
        for held in np.unique(side) if across else (None,):
            mine = np.ones(len(data), bool) if held is None else side == held
            at = np.flatnonzero(mine[of])
            order = at[np.argsort(token[at], kind="stable")]
            holders = of[order]
            begin = np.concatenate([[0], np.cumsum(np.bincount(token[at], minlength=int(token.max()) + 1))])
            for b in np.flatnonzero(asks if held is None else asks & ~mine).tolist():
                own = token[ends[b] - size[b] : ends[b]]
                low, many = begin[own], begin[own + 1] - begin[own]
                places = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                count = np.bincount(holders[places], minlength=len(data))
                link = (count * den >= num * (size + size[b] - count)) & (root != root[b]) & mine
                for c in np.flatnonzero(link).tolist():
                    x, y = top(int(root[b])), top(int(root[c]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        found.append((keys[b], keys[c]))
        cols = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
        return pa.table(cols, ["a", "b"])

    return dealt.groupBy("task").applyInArrow(compare, "a long, b long")


def _rooted(sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return sets.withColumn("root", F.col("key"))
    return sets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    label: Column = F.col("key")
    if roots is not None:
        rows, label = rows.join(roots, "key", "left"), F.coalesce("root", "key")
    return rows.select("doc_id", "t", "n", F.when(F.col("n") > 0, label).alias("label"))


def _classes(rows: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "label")
    least = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = rows.filter("label is not null").join(least, "label").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.filter("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_each(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs without all but one row of each class: the one with the smallest doc_id (null last), then text hash.

    Rows are told apart by id and text together, so a repeated id loses only the texts that are copies.
    Of rows with the same id and text one stays. Texts without shingles are in no class and all stay.
    """
    rows = stored(_labelled_rows(docs, words, num, den).filter("label is not null"), "rows")
    many = rows.groupBy("label", "doc_id", "t").agg(F.count("*").alias("many"))
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "t")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("t") == F.col("best.t"))
    marks = stored(many.join(best, "label").select(F.col("doc_id").alias("_i"), F.col("t").alias("_h"), stays.alias("stays"), "many").filter("not stays or many > 1"), "marks")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_t"))  # whole rows, whatever their columns are called
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_h"))
    out = packed.join(marks.filter("not stays"), same, "left_anti")
    repeated = marks.filter("stays")
    if repeated.limit(1).count():
        order = F.xxhash64(*[F.col(f"_row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
        one = out.join(repeated, same, "left_semi").groupBy("_id", "_t").agg(F.min_by("_row", order).alias("_row"))
        out = out.join(repeated, same, "left_anti").select("_row").unionByName(one.select("_row"))
    return out.select("_row.*")


def op10_jaccard(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))
