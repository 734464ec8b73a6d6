"""The prefix trie, the structure repair and the packing against brute force, on odd tables too."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from voxlake.llm import repair as R
from voxlake.llm.packing import OpenWindows, best_fit_decreasing, close_gaps, encoder, packed
from voxlake.llm.prefixes import band_floor, prefix_trie
from voxlake.llm.repair import repaired

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def crc(text):
    return zlib.crc32(text.encode())


def grouped(rows, key):
    found = defaultdict(list)
    for r in sorted(rows, key=key):
        found[r[0]].append(r)
    return found


def trie(rows):
    by = grouped([r for r in rows if r[0] is not None], lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}:{r[3] or ''}".encode()).hexdigest()))
    own = {c: [(r[2] or "", r[3] or "") for r in rs] for c, rs in by.items()}
    full = {c: own.get(c - c % 20, [])[: crc(str(c)) % 4] + own[c][crc(str(c)) % 4 :] for c in own}
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if len(full[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), sum(not children[x] for x in below), saved, sha(ends)))
    return sorted(out, key=repr)


def talk(rng, convs, turns, texts="a|b b|c."):
    return [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*texts.split("|"), None, ""])) for c in convs for t in range(rng.randint(1, turns))]


def test_trie_equals_brute_force(spark):
    rng = random.Random(11)
    rows = talk(rng, range(0, 45), 7) + [(50, None, "user", "x"), (50, None, "user", "x"), (None, 1, "user", "y"), (61, 0, "user", "z")]
    rows += [(c, t, "user", f"long {t}") for c in (100, 101, 102) for t in range(150 if c < 102 else 70)]  # copies and prefixes deeper than a band
    rows += [(c, t, "user", f"deep {t} {c if t > 90 else ''}") for c in (140, 160) for t in range(130)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'k' as key")
    got = prefix_trie(df)
    assert [*got.columns] == [*COLUMNS]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = [(7, 0, "user", "w " * 50_000)]  # conversation 0 is absent and 7 loses its first turns: a turnless member of the root
    assert sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(lone, SCHEMA)).collect()), key=repr) == trie(lone)


def test_bands_follow_each_other():
    floors = [band_floor(b) for b in range(12)]
    assert floors == [0, 1, 2, 4, 8, 16, 32, 64, 128, 192, 256, 320]


def cheapest(kinds):
    """All edit sequences with at most one useful insertion before a row, by exhaustive search."""
    best = None
    frontier = {0: (0, "")}
    for kind in [*kinds, "end"]:
        inserted = {}
        for s, (c, a) in frontier.items():
            for n in range(3):
                t, ok = s, True
                for _ in range(n):
                    t = 3 if t == 2 else 2
                v = (c + 3 * n, a + "I" * n)
                inserted.setdefault(t, []).append(v)
        if kind == "end":
            best = min(v for s in (0, 3) for v in inserted.get(s, []) if s == 3 or v in [frontier.get(0)])
            return best
        after = defaultdict(list)
        for s, vs in inserted.items():
            for c, a in vs:
                after[s].append((c + 4, a + "D"))
                if kind == "x":
                    continue
                cut = 3 * kind.isupper()
                k = kind.lower()
                if k == "s" and s == 0:
                    after[1].append((c + cut, a + "K"))
                if s == 2:
                    after[3] += [(c + cut + 3, a + "R")] + [(c + cut, a + "K")] * (k == "a")
                else:
                    after[2] += [(c + cut + 3, a + "R")] + [(c + cut, a + "K")] * (k == "u")
        frontier = {s: min(v) for s, v in after.items()}


def test_divide_and_conquer_gives_the_least_edits():
    for n in range(5):
        for kinds in map("".join, product("suaoSx", repeat=n)):
            costs, ranks = R.forward(kinds, 0)
            end = [R.ENDING[s][1] for s in range(4)]
            s = R.crossing(costs, ranks, end)
            audit = "".join(e for _, e in R.reconstruct(kinds, 0, s)) + R.ENDING[s][0]
            assert (costs[s] + end[s], audit) == cheapest(kinds), kinds


def repair_plainly(rows):
    out = []
    for c in {r[0] for r in rows}:
        kept = []
        for _, t, role, text in (r for r in rows if r[0] == c):
            role, text = " " if role is None else role, " " if text is None else text
            fate = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
            if fate:
                text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
                kept += [(t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in kept:
            faults.append("blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(R.WHITE)[-1] not in ".!?" else "")
            seen.add((role, text))
        kinds = ["x" if f in ("blank", "duplicate") else (k := role[:1] if role[:1] in tuple("sua") else "o").upper() if f else (role[:1] if role[:1] in tuple("sua") else "o") for f, (_, role, _) in zip(faults, kept)]
        cost, audit = cheapest(kinds) if kept else (0, "")
        lines, state, at = [], 0, iter(kept)
        for e in audit:
            if e == "I":
                role, text = ("assistant" if state == 2 else "user"), ""
            else:
                _, role, text = next(at)
                if e == "D":
                    continue
                if e == "R":
                    role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1, 16])
def test_repair_equals_brute_force(spark, bits):
    rng = random.Random(12)
    rows = talk(rng, range(60), 9, "Yes.|no|b b! |?\t|. x") + [(None, 2, "user", "q."), (70, None, "tool", "t."), (70, None, "tool", "t."), (71, 5, "", "a" * 100_000 + ".\x0b")]
    rows += [(80, t, rng.choice(["user", "assistant", "system"]), f"{t}.") for t in range(200)]
    got = repaired(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "'f' as fault").repartition(5), bits)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == repair_plainly(rows)


def test_repair_of_empty_tables_and_dropped_conversations(spark):
    assert repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    c = next(c for c in range(1000) if crc(f"{c}:0") % 20 == 0)
    (row,) = repaired(spark.createDataFrame([(c, 0, "user", "x.")], SCHEMA)).collect()
    assert tuple(row) == (c, 0, 0, 0, 0, 0, 0, "", sha(""))


def test_tightest_window():
    rng, tree, rooms = random.Random(13), OpenWindows(64), {}
    for i in range(3000):
        if rng.random() < 0.5:
            rooms[i] = rng.randint(1, 64)
            tree.put(i, rooms[i])
        else:
            need = rng.randint(1, 64)
            found = tree.take(need)
            fits = [r for r in rooms.values() if r >= need]
            assert (found is None) == (not fits)
            if found:
                assert found[1] == min(fits) == rooms.pop(found[0])


@pytest.mark.parametrize("slack", [0, 3])
def test_windows_are_full(slack):
    rng = random.Random(14)
    for n in (0, 1, 2, 50, 400):
        lengths = [rng.choice([1, 5, 30, 64, 65, 300, rng.randint(1, 200)]) for _ in range(n)]
        plain = best_fit_decreasing(lengths, 64)
        assert all(sum(p[2] for p in w) <= 64 for w in plain) and sum(w[0][2] == 64 for w in plain) >= sum(x // 64 for x in lengths)
        for windows in (plain, close_gaps(best_fit_decreasing(lengths, 64), 64, slack)):
            places = sorted((i, a + k) for w in windows for i, a, m in w for k in range(m))
            assert places == [(i, k) for i, x in enumerate(lengths) for k in range(x)]
        sizes = [sum(p[2] for p in w) for w in windows]
        assert all(64 - slack <= s <= 64 or s & (s - 1) == 0 for s in sizes)


def test_packing_keeps_every_id(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(15)
    texts = [None, "", "It's ΑΣ Σ  <|endoftext|> x", "Ünïcödé ﬁ ²³ 12x", "\U0002ebf0 rare", *(" ".join(rng.choices(["Alpha", "beta,", "gamma!", "it's", "don’t", "«x»"], k=rng.randint(1, 900))) for _ in range(300)), "word " * 30_000]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again")]
    got = packed(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3), path, block_tokens=50_000, with_ids=True).collect()
    want = sorted(((d, tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t, _ in rows), key=repr)
    by, used = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for d, ids in want:
        copies = sum(w[0] == d for w in want)
        pieces = sorted(by[d], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(ids) and all(r.doc_tokens == len(ids) and tuple(r.ids) == ids[r.start : r.start + r.length] for r in pieces)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 4096 - 8 <= at <= 4096 or at & (at - 1) == 0
    assert packed(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_words_as_the_library_has_them():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    bpe = encoder(public.path("word_bpe_49k.json"))
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} A{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        assert [x.tolist() for x in bpe.encode(part)] == [e.ids for e in bpe.library.encode_batch_fast(part, add_special_tokens=False)]
