"""Byte-level BPE by speculation: greedy longest match, vectorised pair checks, exact merging of failing words."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxlake.llm.common import returning_memory, small_batches, table

#: The pattern that splits text into words before merging (a fixed value of this public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in each of a Python worker's two caches; a full one replaces the older (results do not depend on it).
CACHE_WORDS = 300_000
#: Characters that are encoded in one go.
BATCH_CHARS = 2_000_000
LATE = np.int64(1) << 40  # later than any merge


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in such vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    """Encoder and decoder for one vocabulary file of the `tokenizers` library (byte-level BPE, no normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {raw(s): i for s, i in ids.items() if s not in self.special}
        self.reach: dict[bytes, int] = {}  # length of the longest token with these first three bytes
        for t in self.id_of:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 3))
        self.of_byte = np.array([self.id_of[bytes((b,))] for b in range(256)], np.int64)
        n = max([*ids.values(), *self.special.values()]) + 1
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        self.made = np.full(n, -1, np.int64)  # the merge that makes a token; -1: a single byte
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merges.setdefault((x, y), (rank, z))
            if self.made[z] < 0:
                self.left[z], self.right[z], self.made[z] = x, y, rank
        keys = np.array([x * n + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.n, self.keys = n, keys[order]
        self.ranks, self.results = (np.array(v, np.int64)[order] for v in zip(*self.merges.values()))
        parts = [b""] * n
        for t, i in self.id_of.items():
            parts[i] = t
        for s, i in self.special.items():
            parts[i] = s.encode()
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.whole = np.zeros(n, np.int8)  # 1: merging the token's bytes gives the token itself; -1: it does not; 0: not yet known
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge_exactly(self, word: bytes) -> list[int]:
        """Standard merging: the pair of lowest rank first, leftmost of equal ones."""
        parts = [self.id_of[bytes((b,))] for b in word]
        while len(parts) > 1:
            best = min((self.merges.get(p, (LATE, -1)) for p in zip(parts, parts[1:])), default=(LATE, -1))
            if best[1] < 0:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.merges.get((parts[i], parts[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def merge_all_exactly(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge_exactly for many words side by side: (their ids one after the other, ids per word).

        In each round every unfinished word merges all places of its best pair; finished words leave.
        """
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        sym = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        word = np.repeat(np.arange(len(raws)), sizes)
        kept_sym, kept_word = [], []
        while len(sym):
            slot, rank = self._pair(sym[:-1], sym[1:])
            rank = np.append(np.where(word[:-1] == word[1:], rank, LATE), LATE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(sym))))
            over = best == LATE
            kept_sym.append(sym[over])
            kept_word.append(word[over])
            hit = (rank == best) & ~over
            if (twice := hit[1:] & hit[:-1]).any():  # only in runs of one symbol: from the left, every other place
                at = np.arange(len(sym))
                run = np.maximum.accumulate(np.where(np.append(True, ~twice), at, 0))
                hit &= (at - run) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.results[slot[at]]
            stay = ~over
            stay[at + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate(kept_sym), np.concatenate(kept_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(raws))

    def _pair(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and rank of each pair's merge; LATE where there is none."""
        key = x * self.n + y
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return slot, np.where(self.keys[slot] == key, self.ranks[slot], LATE)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, get, reach = [], 0, len(word), self.id_of.get, self.reach.get
        while i < n:
            for j in range(min(n, i + reach(word[i : i + 3], 3)), i, -1):
                if (t := get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair of tokens: whether merging their joint bytes keeps the boundary.

        Walks back in time over the pieces that touch the boundary (the right edge of a, the left
        edge of b). The boundary falls if two touching pieces have a merge that comes before the
        next merge of the left piece, and not after the next one of the right piece (of equal
        merges the leftmost is done first).
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        next_x, next_y = np.full(len(a), LATE), np.full(len(a), LATE)
        while len(at):
            rank = self._pair(x, y)[1]
            falls = (rank < next_x) & (rank <= next_y) & (rank < LATE)
            ok[at[falls]] = False
            made_x, made_y = self.made[x], self.made[y]
            undo_x = made_x > made_y
            go = ~falls & (np.maximum(made_x, made_y) >= 0)
            next_x, next_y = np.where(undo_x, made_x, next_x)[go], np.where(undo_x, next_y, made_y)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go]
            at = at[go]
        return ok

    def _is_whole(self, token: int) -> bool:
        if not self.whole[token]:
            start = self.starts[token]
            self.whole[token] = 1 if self.merge_exactly(self.flat[start : start + self.lengths[token]].tobytes()) == [token] else -1
        return self.whole[token] > 0

    def learn(self, words: list[str]) -> int:
        """Encode new words into the cache; returns how many had to be merged exactly."""
        raws = [w.encode() for w in words]
        tokens = [self.propose(r) for r in raws]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(counts.sum()))
        word = np.repeat(np.arange(len(words)), counts)
        same = word[:-1] == word[1:]
        fails = np.zeros(len(words), bool)
        fails[word[:-1][same][~self.compatible(flat[:-1][same], flat[1:][same])]] = True
        used = np.unique(flat)
        broken = np.array([t for t in used.tolist() if not self._is_whole(t)], np.int64)
        if len(broken):
            fails[word[np.isin(flat, broken)]] = True
        passed, failed = np.flatnonzero(~fails), np.flatnonzero(fails)
        self._keep(words, passed, flat[~fails[word]], counts[passed])
        if len(failed):
            self._keep(words, failed, *self.merge_all_exactly([raws[i] for i in failed]))
        return int(fails.sum())

    def _keep(self, words: list[str], which: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
        for i, start, end in zip(which.tolist(), (ends - counts * 4).tolist(), ends.tolist()):
            self.cache[words[i]] = raw[start:end]

    def _pieces(self, text: str) -> list[tuple[bool, str]]:
        if self.cut is None or not any(s in text for s in self.special):
            return [(False, text)]
        return [(i % 2 == 1, p) for i, p in enumerate(self.cut(text)) if p]

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        done: list[bytes] = []
        for group in self._groups(texts):
            split = [[(s, p if s else self.find(p)) for s, p in self._pieces(t or "")] for t in group]
            new = {w for d in split for s, ws in d if not s for w in ws}
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.cache, self.older = {}, self.cache
            for w in (new := new.difference(self.cache)).intersection(self.older):
                self.cache[w] = self.older[w]
            if new := list(new.difference(self.older)):
                self.learn(new)
            get = self.cache.__getitem__
            for d in split:
                done.append(b"".join(int(self.special[ws]).to_bytes(4, "little") if s else b"".join(map(get, ws)) for s, ws in d))
        return done

    def _groups(self, texts: list[str | None]) -> Iterator[list[str | None]]:
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size >= BATCH_CHARS:
                yield group
                group, size = [], 0
        if group:
            yield group

    def decode_bytes(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)
        return self.flat[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode each row's text and decode it again; one row per row of docs (doc_id, text), no shuffle.

    path: the vocabulary file, present on every worker. Returns doc_id, n_tokens, ids_sha256,
    decoded_sha256, round_trip (decoded text equals the input), and with with_ids also ids
    (ARRAY<INT>) and decoded. A null text counts as empty: no tokens, digests of nothing.
    Very long texts are taken whole; repeated rows and null doc_ids stay as they are; extra
    columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in returning_memory(batches):
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(1).to_pylist()
                found = bpe.encode_bytes(texts)
                decoded = [bpe.decode_bytes(np.frombuffer(ids, "<u4")) for ids in found]
                cols = {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array([len(ids) // 4 for ids in found], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids in found], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    "round_trip": pa.array([d == (t or "") for d, t in zip(decoded, texts)], pa.bool_()),
                }
                if with_ids:
                    ends = np.cumsum([0, *(len(ids) // 4 for ids in found)]).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                    cols["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"), public_vocabulary()).drop("round_trip")
