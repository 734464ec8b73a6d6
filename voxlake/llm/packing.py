"""Packing token sequences: best-fit decreasing with a segment tree over the windows' remaining capacities."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.bpe import LATE, byte_letters, public_vocabulary
from voxlake.llm.common import returning_memory, small_batches, table

#: The pattern that splits text into words before merging (a fixed value of this public vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Tokens of a sequence, the token behind each document, and tokens that are packed together (which bounds a task's memory).
SIZE, END_ID, BLOCK_TOKENS = 4096, 2, 4_000_000
#: Windows with at most so many free places stay as best fit left them; larger gaps are closed by cutting.
SLACK = 8
#: Bytes of new words that are merged side by side.
MERGE_BYTES = 1_000_000
#: Tokens in a Python worker's cache; beyond that it starts anew (results do not depend on it).
CACHE_TOKENS = 600_000
#: Marks that are a word of their own behind letters.
MARKS = frozenset(".,;:!?")


def rare_characters():
    """A test for what the libraries at hand may take differently: separators at which Arrow parts words, and code points that this Python does not know.

    Three patterns, as one with all planes would try its ranges one by one at each character.
    """
    def pattern(start: int, end: int):
        unknown = [c for c in range(start, end) if unicodedata.category(chr(c)) == "Cn"]
        first = [c for c, before in zip(unknown, [-2, *unknown]) if c != before + 1]
        last = [c for c, after in zip(unknown, [*unknown[1:], -2]) if c != after - 1]
        return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last))

    separators = re.compile("[\x1c-\x1f]").search
    basic = re.compile(f"[\x1c-\x1f{pattern(0x80, 0x10000)}]").search
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    unknown = re.compile(f"[{pattern(0x10000, 0x20000)}\U00020000-\U0010ffff]").search
    return lambda text: separators(text) if text.isascii() else basic(text) or (beyond(text) and unknown(text))


class WordEndBpe:
    """Encoder for a vocabulary file of the `tokenizers` library: BPE with word ends, lower case, white space dropped.

    Each distinct word is merged once, many words side by side; texts with special tokens or rare code points go
    through the library itself. The ids equal those of the library (tests/llm holds all code points against it).
    """

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letter = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([ids[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[letter[b] + end] for b in range(256)], np.int64)
        self.n = max(ids.values()) + 1
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.n + ids[b] for a, b in merges], np.int64)
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks, self.results = first.astype(np.int64), np.array([ids[a + b] for a, b in merges], np.int64)[first]
        self.find = regex.compile(SPLIT).findall
        self.rare = rare_characters()
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word: in each round every unfinished word merges all places of its pair of lowest rank."""
        raws = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        flat = np.frombuffer(b"".join(raws), np.uint8)
        sym, ends = self.inner[flat], np.cumsum(sizes)
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(raws)), sizes)
        done_sym, done_word = [], []
        slot, rank = self._pairs(sym, word)
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = best == LATE
            done_sym.append(sym[over])
            done_word.append(word[over])
            hit = (rank == best) & ~over
            if (twice := hit[1:] & hit[:-1]).any():  # runs of one symbol: from the left, every other place
                at = np.arange(len(sym))
                run = np.maximum.accumulate(np.where(np.append(True, ~twice), at, 0))
                hit &= (at - run) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.results[slot[at]]
            old = np.ones(len(sym), bool)  # pairs that stay as they were
            old[at] = False
            old[at[at > 0] - 1] = False
            stay = ~over
            stay[at + 1] = False
            sym, word, rank, slot, old = sym[stay], word[stay], rank[stay], slot[stay], old[stay]
            new = np.flatnonzero(~old)
            slot[new], rank[new] = self._pairs(sym, word, new)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        raw = sym[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(raws))) * 4
        start = 0
        for end in ends.tolist():
            yield raw[start:end]
            start = end

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Slot and rank of the merge of each symbol with its successor in the word; LATE where there is none."""
        at = np.arange(len(sym)) if at is None else at
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * self.n + sym[after]
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (self.keys[slot] == key) & (after > at) & (word[after] == word[at])
        return slot, np.where(fits, self.ranks[slot], LATE)

    def lowered(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lowers each character alone
        return text.lower()

    def parted(self, token: str) -> list[str]:
        """The words of a token; most are letters alone or with one mark behind them, which needs no pattern."""
        if token.isalpha():
            return [token]
        if token[-1:] in MARKS and token[:-1].isalpha():
            return [token[:-1], token[-1:]]
        return self.find(token)

    def learn(self, tokens: list[str]) -> list[bytes]:
        """Ids of new tokens (what white space parts) by way of their words; both go to the cache."""
        parts = list(map(self.parted, tokens))
        group, size = [], 0
        for w in [*{w for ws in parts for w in ws}.difference(self.cache), None]:
            if group and (w is None or size > MERGE_BYTES):
                self.cache.update(zip(group, self.merge(group)))
                group, size = [], 0
            if w is not None:
                group.append(w)
                size += len(w)
        get = self.cache.__getitem__
        raws = [get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws)) for ws in parts]
        self.cache.update(zip(tokens, raws))
        return raws

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null one has none."""
        texts = [t or "" for t in texts]
        odd = {i: np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") for i, t in enumerate(texts) if self.rare(t) or any(s in t for s in self.special)}
        split = pc.utf8_split_whitespace(pa.array(["" if i in odd else self.lowered(t) for i, t in enumerate(texts)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        tokens = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > CACHE_TOKENS:
            self.cache.clear()
        raws = list(map(self.cache.get, tokens))
        if missing := [i for i, r in enumerate(raws) if r is None]:
            for i, r in zip(missing, self.learn([tokens[i] for i in missing])):
                raws[i] = r
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        starts, codes = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(raws), "<u4")[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [odd[i] if i in odd else flat[a:b] for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEndBpe:
    return WordEndBpe(path)


class OpenWindows:
    """Windows by remaining capacity; a segment tree over the capacities counts them, so the tightest fit is one walk."""

    def __init__(self, size: int):
        self.size, self.leaves = size, 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, window: int, room: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the tightest window with at least `need` places, and its room; None if there is none."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right neighbour holds a window
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not count[2 * node])
        room = node - self.leaves
        self._add(room, -1)
        return self.at[room].pop(), room

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], size: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length) for documents of these lengths.

    Overlong documents are first cut into full windows; what is left goes, longest first, into the tightest open window.
    """
    windows = [[(i, start, size)] for i, n in enumerate(lengths) for start in range(0, n - size + 1, size)]
    open_windows = OpenWindows(size)
    rest = [(n % size, i) for i, n in enumerate(lengths) if n % size]
    for n, i in sorted(rest, key=lambda p: (-p[0], p[1])):
        found = open_windows.take(n)
        if found is None:
            found = len(windows), size
            windows.append([])
        window, room = found
        windows[window].append((i, lengths[i] - n, n))
        if room > n:
            open_windows.put(window, room - n)
    return windows


def close_gaps(windows: list[list[tuple[int, int, int]]], size: int = SIZE, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """The windows with gaps above `slack` filled by cutting up the emptiest ones; the last is cut into powers of two, which need no padding."""
    room = [size - sum(p[2] for p in w) for w in windows]
    done = [w for w, r in zip(windows, room) if r <= slack]
    wide = sorted((i for i, r in enumerate(room) if r > slack), key=lambda i: (room[i], i))
    first, last = 0, len(wide) - 1
    donor = sorted(windows[wide[last]], key=lambda p: p[2]) if wide else []
    while first < last:
        target, gap = windows[wide[first]], room[wide[first]]
        while gap and first < last:
            if not donor:
                last -= 1
                donor = sorted(windows[wide[last]], key=lambda p: p[2]) if first < last else []
                continue
            i, start, n = donor.pop()
            cut = min(n, gap)
            target = [*target, (i, start, cut)]
            gap -= cut
            if n > cut:
                donor.append((i, start + cut, n - cut))
        if first == last:  # the donors ran out: this window is the last one
            donor = target
            break
        done.append(target)
        first += 1
    left = sum(p[2] for p in donor)
    for power in (1 << b for b in range(left.bit_length() - 1, -1, -1)):
        if left & power:
            window, need = [], power
            while need:
                i, start, n = donor.pop()
                cut = min(n, need)
                window.append((i, start, cut))
                need -= cut
                if n > cut:
                    donor.append((i, start + cut, n - cut))
            done.append(window)
    return done


def packed(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, slack: int = SLACK, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pack the tokens of docs (doc_id, text) into sequences of at most `size`; one row per piece, no shuffle.

    Each task packs what it reads, in blocks of about block_tokens tokens, so its memory is bounded (one document's ids
    above that) and a lost executor costs only its tasks. Sequences are padded to `size` except at a power of two: at
    most `slack` places of a sequence are padding. path: the vocabulary file, present on every worker.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids also ids (ARRAY<INT>).
    A null or empty text is a document of its end token alone; very long texts are taken whole; repeated rows and null
    doc_ids are documents like any other; extra columns are ignored; an empty table gives an empty result. sequence_id
    is unique within the result: the partition of docs and a running number.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def rows(names: list, ids: list[np.ndarray], base: int) -> tuple[pa.RecordBatch, int]:
        windows = close_gaps(best_fit_decreasing([len(x) for x in ids], size), size, slack)
        out: list[list] = [[] for _ in range(7 + with_ids)]
        for k, window in enumerate(windows):
            offset = 0
            for i, start, n in window:
                piece = ids[i][start : start + n]
                for column, v in zip(out, (names[i], start, n, zlib.crc32(piece.tobytes()), len(ids[i]), base + k, offset, piece)):
                    column.append(v)
                offset += n
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[f.split(" ")[0] for f in schema.split(", ")]), base + len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(path), np.array([end_id], "<u4")
        names, ids, held, base, part = [], [], 0, 0, None
        for whole in returning_memory(batches):
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                if part is None:
                    part = batch.column(2)[0].as_py()
                    base = part << 32
                names += batch.column(0).to_pylist()
                new = [np.append(x, end).astype("<u4") for x in bpe.encode(batch.column(1).to_pylist())]
                ids += new
                held += sum(map(len, new))
                if held >= block_tokens:
                    found, base = rows(names, ids, base)
                    yield found
                    names, ids, held = [], [], 0
        if names:
            yield rows(names, ids, base)[0]

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id()).mapInArrow(run, schema)


def op13_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))
