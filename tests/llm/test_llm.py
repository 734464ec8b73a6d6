"""The operators against brute force and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import bpe, jaccard, licences, mixing, suffixes, toxicity, urls, vectors, warc
from voxlake.llm.common import new_folder

SF = "/root/testdata/sf0.001"
WORDS = [a + b + c for a in ("ba", "ko", "ri", "té") for b in ("lu", "mi", "zo", "ße") for c in ("", "n", "r", "s")]
#: Columns whose names the operators use inside.
CLASH = {"key": "k", "_key": "k", "rank": 1, "score": 2.0, "n": 3, "tokens": "t", "p": 4, "_listed": True, "rate": 5.0, "root": "r"}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def frame(spark, texts, clash=True):
    df = spark.createDataFrame(list(texts), "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


def corpus():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 5, 6, 30, 80, 150, 400)]
    texts = list(base) + [base[4]] * 3 + ["", None, "  \n", "one", "x" * 500, "ab" * 300]
    for b in base[3:]:
        for share in (0.01, 0.05, 0.2):
            words = b.split()
            for i in range(len(words)):
                if rng.random() < share:
                    words[i] = "edit" + str(rng.randint(0, 10**6))
            texts.append(" ".join(words))
    passage = prose(rng, 40)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    return list(enumerate(texts)) + [(None, base[5]), (2, base[2]), (2, prose(rng, 60))]


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark):
    rows = corpus()
    got = suffixes.repeats_removed(frame(spark, rows)).collect()
    want = brute_removed([t for _, t in rows], 200)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((d, *w) for (d, _), w in zip(rows, want))
    assert any(w[2] > 1 for w in want) or any(0 < w[1] < w[0] for w in want)


def test_suffix_dedup_in_parts_of_a_collection(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 2)
    rows = corpus()
    got = suffixes.repeats_removed(frame(spark, rows, False)).collect()
    want = brute_removed([t for _, t in rows], 200)
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == Counter((d, w[1], w[3]) for (d, _), w in zip(rows, want))


def test_suffix_dedup_empty_and_columns(spark):
    assert suffixes.repeats_removed(frame(spark, [])).count() == 0
    df = frame(spark, [(1, "é" * 300), (2, "x" + "é" * 300), (3, "short"), (4, None)]).withColumn("n_chars", F.length("text").cast("long"))
    out = suffixes.drop_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("", 0), 2: ("x", 1), 3: ("short", 5), 4: (None, None)}


def test_repeated_strings_small_alphabet():
    rng = random.Random(2)
    segs = ["".join(rng.choice("ab") for _ in range(22)).encode() for _ in range(40)]
    found = suffixes.repeated_strings(segs, [8] * 40, np.zeros(40, np.int64), length=14, gram=6)
    for i, s in enumerate(segs):
        for j in range(9):
            window = s[j : j + 14]
            inside = len(window) == 14 and any(o is not s and o[j : j + 14] == window for o in segs)
            assert bool(found[i, j]) == inside


def brute_classes(rows):
    sets, parent = [], {}
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if top(k) == top(i) and rows[k][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out


def test_jaccard_equals_brute_force(spark):
    rows = corpus()
    got = jaccard.jaccard_classes(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_classes(rows))


def test_jaccard_many_edits_of_one_text(spark):
    rng = random.Random(9)
    base = prose(rng, 120).split()
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = "w" + str(rng.randint(0, 10**6))
        rows.append((i, " ".join(words)))
    got = jaccard.jaccard_classes(frame(spark, rows, False)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_classes(rows))


def test_jaccard_hot_entries_and_blocks(spark, monkeypatch):
    """Texts that share a passage and are else apart, beside near copies: entries are left out, neighbourhoods dealt in blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 300)
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = []
    for i in range(40):
        words = rows[-1][1].split()[60:] if i % 2 else prose(rng, 25).split()  # pairs of near copies
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join([*passage.split(), *words])))
    got = jaccard.jaccard_classes(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_classes(rows))


def test_jaccard_empty_and_kept_rows(spark):
    assert jaccard.jaccard_classes(frame(spark, [])).count() == 0
    df = frame(spark, [(1, "a b c d e f g h"), (5, "A b C d e f g h"), (7, "other words in this one here"), (8, None), (9, "")])
    out = jaccard.keep_one_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 7, 8, 9]


def test_jaccard_keeps_rows_not_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = lambda text, k: " ".join(w if i != k else "edit" for i, w in enumerate(text.split()))
    rows = [(5, a), (5, b), (3, b), (6, c), (6, c), (None, d), (None, d), (None, near(d, 30)), (None, None), (None, None), (8, ""), (8, "")]
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_one_each(frame(spark, rows)).collect())
    d_kept = [t for t in (d, near(d, 30)) if got[(None, t)]]
    assert len(d_kept) == 1
    assert got == Counter({(5, a): 1, (3, b): 1, (6, c): 1, (None, d_kept[0]): 1, (None, None): 2, (8, ""): 2})


def test_jaccard_links_through_rows_without_id(spark):
    words = prose(random.Random(13), 100).split()
    edit = lambda *at: " ".join("edit" if i in at else w for i, w in enumerate(words))
    rows = [(1, edit(10, 30)), (None, edit()), (2, edit(60, 80))]
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    ratio = lambda x, y: len(x & y) / len(x | y)
    assert ratio(sets[0], sets[2]) < 0.75 <= min(ratio(sets[0], sets[1]), ratio(sets[1], sets[2]))
    assert {r.component_id for r in jaccard.jaccard_classes(frame(spark, rows)).collect()} == {1}


@pytest.mark.parametrize("low", [1, 2, 3, 5, 9, 17, 40, 90, 200, 1000])
def test_allocation_catches_every_pair(low):
    starts = jaccard.band_starts(2000)
    rng = np.random.default_rng(low)
    band = int(np.searchsorted(starts, low, "right")) - 1
    for _ in range(30):
        n = int(rng.integers(low, int(starts[band + 1])))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        lost = int(rng.integers(0, n // 7 + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[lost:]], rng.integers(0, 2**63, lost).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or both * 100 < 75 * (len(a) + len(b) - both):
            continue
        bands = [int(np.searchsorted(starts, len(x), "right")) - 1 for x in (a, b)]
        g = min(bands)
        assert len(np.intersect1d(jaccard.signatures(a, g, starts), jaccard.signatures(b, g, starts)))


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_vocabulary())


def test_bpe_equals_library(spark):
    lib = tokenizer()
    rng = random.Random(1)
    letters = "aaab  \n\tst'll<|endoftext|>09éöß日🙂.,"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["<|endoftext|>", "a<|endoftext|> b", "", "a" * 5000, "  ", prose(rng, 20000), None]
    got = bpe.encode_decode(frame(spark, enumerate(texts)), bpe.public_vocabulary(), with_ids=True).collect()
    for r in got:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_cache_turnover_and_empty(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 200)
    lib, own = tokenizer(), bpe.SpeculativeBpe(bpe.public_vocabulary())
    texts = [prose(random.Random(i), 40) for i in range(30)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_bytes(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encode_decode(frame(spark, []), bpe.public_vocabulary()).count() == 0


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, list(rows[5][1])) for i in range(40)]  # equal vectors
    rows += [(1000, None), (1001, [float("nan")] * 8), (1100, [1.0, None] + [0.0] * 6), (1200, [0.0] * 8), (None, [1.0] * 8), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("block", [50, 4096])
def test_exact_top_k(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", F.lit(1)).withColumn("query", F.lit(2))
    got = vectors.exact_top_k(df, F.col("vec_id") % 100 == 0, block_rows=block, query_rows=3).collect()
    ints = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ints if i % 100 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_neighbours_recall_and_scores(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.near_neighbours(df.withColumns({"rank": F.lit(1), "score": F.lit(2.0), "vec": F.lit(3)}), F.col("vec_id") % 100 == 0).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    want = {(q, i) for q in good if q % 100 == 0 for _, i in sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    assert all(abs(r.score - np.sqrt(((good[r.query_id] - good[r.vec_id]) ** 2).sum())) < 1e-9 for r in got)


@pytest.mark.parametrize("clusters", [0, 200])
def test_neighbours_of_full_blocks(spark, clusters):
    """Default parameters on 20,000 rows: without structure a large part of a block must be offered, with it a small one; recall holds for both."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(20_000, 64))
    if clusters:
        data = data * 0.05 + rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(data))]
    share = vectors.calibrated(data[:4096], 10)
    assert share < 0.2 if clusters else share > 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = {}
    for r in vectors.near_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(data), 100):
        far = ((data - data[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(found[q] & set(np.argpartition(far, 10)[:10].tolist()))
    assert hits >= 0.9 * 10 * 200


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.exact_top_k(df, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert vectors.near_neighbours(one, F.col("vec_id") % 100 == 0).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://Sub.Example.ORG/es/x?y"), (2, "http://example.org/en/12"), (3, "http://a.com/fr/"), (4, "http://a.com/de/1#z"), (5, "http://com.net/de/"), (6, "nothing"), (7, None), (8, "http://www.b.net/q/"), (9, "http://b.net/q"), (10, "http://example.org"), (10, "http://c.net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_key", F.lit(1))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, urls.repeated_urls(df), urls.RULES).collect()}
    assert got == {
        (1, "sub.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "a.com", "/fr/", "com/fr/", "allow"),
        (4, "a.com", "/de/1", "com/de/", "block"), (5, "com.net", "/de/", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "www.b.net", "/q/", None, "block"), (9, "b.net", "/q", None, "block"), (10, "example.org", "", None, "allow"), (10, "c.net", "/", None, "allow"),
    }


def test_urls_full_filter_stays_exact(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 300}.net/{i % 300 if i < 350 else i}") for i in range(400)], "page_id long, url string")
    got = urls.judge_urls(df, urls.repeated_urls(df), (), blocks=1).filter("listed").count()
    assert got == 100  # one block only: almost everything passes the filter, the join decides


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u\r\nx", ""), (5, "http://c", "é" * 30000), (None, "http://d", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = new_folder(spark, "warc")
    warc.write_warc(pages, path)
    back = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert bytes(back[5].payload).decode() == "é" * 30000 and back[5].payload_bytes == 60000
    assert (back[1].record_type, back[1].refers_to, back[1].payload) == ("revisit", 2, None) and back[2].record_type == "response"
    assert (back[3].record_type, back[3].refers_to) == ("revisit", 4) and back[None].record_type == "response"
    heads = warc.read_warc(spark, path, payload=False)
    assert heads.filter("record_type = 'revisit'").count() == 2 and heads.filter("page_id in (2, 5)").filter("payload is null").count() == 2
    assert warc.read_warc(spark, new_folder(spark, "none")).count() == 0


def test_warc_common_payloads_empty_tables_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(warc, "MANY", 2)
    rows = [(i, "u", "common") for i in range(6)] + [(7, "u", "twice"), (8, "u", "twice"), (9, "u", None), (9, "u", None), (None, "u", "common"), (10, "u", "common")]
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload is None) for r in warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = Counter([(i, "revisit", 10, True) for i in range(6)] + [(10, "response", None, False), (7, "revisit", 8, True), (8, "response", None, False), (None, "revisit", 10, True)] + [(9, "response", None, False)] * 2)
    assert got == want
    path = new_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_pushes_header_predicates():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = warc.WarcReader("/none", True, 1)
    rest = [*reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (1, 2)), GreaterThan(("payload_bytes",), 5), EqualTo(("payload",), b"")])]
    assert [type(f).__name__ for f in rest] == ["GreaterThan", "EqualTo"] and len(reader.wanted) == 2


def test_licences(spark):
    lines = {1: "Released under the MIT License.", 2: "x\n  This work is licensed under the GNU General Public License, version 3. \ny", 3: "the work is good\nand the license of words", 4: None, 5: "", 6: "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", 7: "word " * 20000}
    df = frame(spark, lines.items())
    got = {r.doc_id: (r.licences, r.n_notices) for r in licences.scan_licences(df).collect()}
    assert got == {1: (["mit"], 1), 2: (["gpl-3.0"], 1), 3: ([], 0), 4: ([], 0), 5: ([], 0), 6: (["apache-2.0", "cc-by-nc-4.0"], 2), 7: ([], 0)}
    assert licences.scan_licences(frame(spark, [])).count() == 0


def test_licences_over_several_lines(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    bsd = "Redistribution and use in source\nand binary forms, with or without\nmodification, are permitted provided that"
    texts = {
        1: gpl, 2: "words before\n\n" + bsd + "\n \nwords after", 3: bsd.replace("\n", "\r\n") + "\n" + gpl, 4: gpl + "\n\n" + gpl,
        5: "Licensed under the European Union Public License, version 1.2", 8: "under the GNU Lesser General Public License", 6: "Redistribution and use in\n\nsource and binary forms with\n\nor without modification", 7: "one\ntwo\n\nthree",
    }
    got = {r.doc_id: (r.licences, r.n_notices) for r in licences.scan_licences(frame(spark, texts.items())).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 7)} == {1: (["gpl-3.0"], 1), 2: (["bsd-3-clause"], 1), 3: (["bsd-3-clause", "gpl-3.0"], 2), 4: (["gpl-3.0"], 2), 7: ([], 0)}
    assert got[5][0] in (["unknown"], []) and got[8][0] == ["lgpl-3.0"] and "bsd-3-clause" not in got[6][0]


def test_licences_short_forms_and_negations(spark):
    said = {
        1: ("SPDX-License-Identifier: MIT", ["mit"]), 2: ("This code is MIT licensed.", ["mit"]), 3: ("Licensed under GPLv3", ["gpl-3.0"]), 4: ("# SPDX-License-Identifier: MPL-2.0", ["mpl-2.0"]),
        5: ("Not licensed under the MIT License; all rights reserved.", []), 6: ("This work is not licensed under the GNU General Public License, version 3.", []), 7: ("You need a valid driver license.", []),
        8: ("Text is available under the Creative Commons Attribution-ShareAlike License; other terms may apply.", ["cc-by-sa-4.0"]), 9: ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", ["isc"]),
    }
    rows = [(k, t) for k, (t, _) in said.items()] + [(1, "SPDX-License-Identifier: MIT"), (None, "Licensed under the ISC License.")]
    got = {}
    for r in licences.scan_licences(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.licences, r.n_notices))
    assert got[1] == [(["mit"], 1)] * 2 and got[None] == [(["isc"], 1)]  # rows of one id are judged together, equal places once
    assert {k: got[k][0][0] for k in said if k != 1} == {k: want for k, (_, want) in said.items() if k != 1}


def test_licence_scores_equal_brute_force(spark):
    """The weights are those of gradient descent in numpy on the same examples, but for the corpus paragraphs, of which there are none here."""
    few = {"mit": licences.TEMPLATES["mit"][:3], "isc": licences.TEMPLATES["isc"][:2]}
    got = {(r.family, r.pair): r.w for r in licences.fit_licences(frame(spark, [], False), few, epochs=40).collect()}

    def pairs(t):
        w = [x for x in licences.re.split("[^a-z0-9]+", t.lower()) if x]
        return [p for p in dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])) if not set(p.split()) <= set(licences.STOP)]

    own = [(f, pairs(t)) for f, ts in few.items() for t in ts]
    bad = [("unknown", pairs(t)) for t in [*licences.HARD, *licences.negated(few)]]
    vocabulary = sorted({p for _, ps in own + bad for p in ps})
    fit = [(f, ps, 20) for f, ps in own] + [(f, ps[: len(ps) - len(ps) // 4], 20) for f, ps in own] + [(f, ps, 20) for f, ps in bad] + [("unknown", [], 1)]
    x = np.array([[p in ps for p in vocabulary] + [True] for _, ps, _ in fit], float)
    n = np.array([k for _, _, k in fit], float)
    for family in few:
        y, w = np.array([f == family for f, _, _ in fit], float), np.zeros(len(vocabulary) + 1)
        for _ in range(40):
            r = n / n.sum() * (y - 1 / (1 + np.exp(-x @ w)))
            w = w + licences.RATE * (x.T @ r - licences.DECAY * w)
        assert np.allclose([got[(family, p)] for p in [*vocabulary, ""]], w)
        score = lambda ps: sum(w[vocabulary.index(p)] for p in ps) + w[-1]  # noqa: E731,B023
        others = [score(ps) for f, ps, *_ in [*fit, *[(f, ps[len(ps) // 4 :]) for f, ps in own]] if f != family]
        mine = [score(ps[len(ps) // 4 :]) for f, ps in own if f == family]
        assert abs(got[(family, "?")] - (max(others) + min(mine)) / 2) < 1e-9


def test_mixing_meets_targets_and_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 200)) if i % 4 else "%% ## " * rng.randint(5, 80)) for i in range(200)] + [(500, None), (501, ""), (None, "a b")]
    labels = spark.createDataFrame([(i, "low" if i % 4 == 0 else "high") for i in range(0, 200, 2)], "doc_id long, domain string")
    out = mixing.mixing_rates(frame(spark, rows), labels, {"low": 0.3, "high": 0.7}).toPandas()
    p, tokens, rate = out[["p_high", "p_low"]].to_numpy(), out["tokens"].to_numpy(), out["rate"].to_numpy()
    assert len(out) == len(rows) and (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    totals = (p * (tokens * rate)[:, None]).sum(axis=0) / tokens.sum()
    assert np.allclose(totals, [0.7, 0.3], atol=1e-3)
    w = np.ones(len(out))  # the same steps, in numpy
    gram = np.linalg.inv((p * tokens[:, None]).T @ p / tokens.sum() + 1e-9 * np.eye(2))
    for _ in range(mixing.STEPS):
        gap = (p * (tokens * w)[:, None]).sum(axis=0) / tokens.sum() - [0.7, 0.3]
        if np.abs(gap).max() < 1e-5:
            break
        w = np.maximum(0, w - p @ (gram @ gap))
    assert np.allclose(w, rate, atol=1e-6)
    assert mixing.mixing_rates(frame(spark, []), labels).count() == 0


def test_mixing_tells_domains_by_words(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 40) + (" vile " if i % 5 == 0 else " ") + prose(rng, 40)) for i in range(300)]
    labels = spark.createDataFrame([(i, "toxic" if i % 5 == 0 else "high") for i in range(200)], "doc_id long, domain string")
    out = mixing.mixing_rates(frame(spark, rows), labels, {"toxic": 0.05, "high": 0.95}).toPandas()
    bad = out["doc_id"] % 5 == 0
    assert out["p_toxic"][bad].min() > 0.9 and out["p_toxic"][~bad].max() < 0.1
    true = (out["rate"] * out["tokens"])[bad].sum() / (out["rate"] * out["tokens"]).sum()
    assert abs(true - 0.05) < 0.02  # the true share, not only the expected one
    counts = frame(spark, [(1, "a  b\t\nc "), (2, " "), (3, None)]).select(mixing.token_count(F.col("text"))).collect()
    assert [r[0] for r in counts] == [3, 0, 0]


def test_mixing_posteriors_equal_brute_force(spark):
    """Traits, log-odds of words, and the Gaussian posteriors, all again in numpy."""
    import regex

    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(1, 60)) + (" vile. " if i % 5 == 0 else "\n# ") + prose(rng, 9)) for i in range(150)] + [(200, None), (201, ""), (None, "a. b")]
    labels = spark.createDataFrame([(i, "toxic" if i % 5 == 0 else "high") for i in range(0, 120)], "doc_id long, domain string")
    domains = ["high", "low", "toxic"]
    out = mixing.mixing_rates(frame(spark, rows), labels, {"toxic": 0.05, "high": 0.9, "low": 0.05}).toPandas()
    few = {r.doc_id: (r.domain, r.fits_words) for r in mixing.few_labelled(labels).collect()}
    text = {i: t or "" for i, t in rows}
    words = {i: {w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w} for i, t in text.items()}
    fit = [i for i, (_, f) in few.items() if f]
    odds = {}
    for w in set().union(*(words[i] for i in fit)):
        n = sum(w in words[i] for i in fit)
        row = []
        for d in domains:
            own, held = sum(few[i][0] == d for i in fit), sum(w in words[i] for i in fit if few[i][0] == d)
            row.append(np.log((held + 0.5) / (own + 1)) - np.log((n - held + 0.5) / (len(fit) - own + 1)) if own and len(fit) - own else 0.0)
        if n >= mixing.SUPPORT and max(row) >= mixing.STRONG:
            odds[w] = row

    def measures(i):
        t = text[i]
        size, lines = len(t), t.count("\n")
        own = [odds[w] for w in words[i] if w in odds]
        traits = [np.log1p(size), t.count(" ") / (size + 1), np.log1p(lines), min(2.0, sum(map(t.count, "%$&*#|@~^")) / (size + 1) * 10), 2 * t.count(". ") / (size + 1) * 10, np.log1p(size / (lines + 1)), np.log1p(len(t.encode()) - size)]
        return traits + [max([0.0, *(o[k] for o in own)]) for k in range(3)]

    x = {i: np.array(measures(i)) for i in text}
    logs = {i: [] for i in text}
    for d in domains:
        own = [i for i in few if few[i][0] == d]
        fresh = [i for i in own if not few[i][1]] or own
        if own:
            pick = lambda f: np.append(f([x[i][:7] for i in own], axis=0), f([x[i][7:] for i in fresh], axis=0))
            prior, mean, dev = np.log(len(own) / len(few)), pick(np.mean), np.maximum(0.05, pick(np.std))
        else:
            prior, mean, dev = np.log(1e-3 / len(few)), np.zeros(10), np.ones(10)
        for i in text:
            logs[i].append(prior - (((x[i] - mean) / dev) ** 2).sum() / 2 - np.log(dev).sum())
    for r in out.itertuples():
        z = np.exp(np.array(logs[None if r.doc_id != r.doc_id else int(r.doc_id)]) - max(logs[None if r.doc_id != r.doc_id else int(r.doc_id)]))
        assert np.allclose([r.p_high, r.p_low, r.p_toxic], z / z.sum(), atol=1e-9)


def test_mixing_measures_texts_in_generated_code(spark, monkeypatch):
    """No lambda in what is stored: it would be interpreted, and keep the explosion of words out of generated code."""
    plans, kept = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, label: (plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())), kept(df, label))[1])
    rows = [(i, ("vile " if i % 5 == 0 else "kind ") * 5 + str(i)) for i in range(60)] + [(None, None)]
    labels = spark.createDataFrame([(i, "toxic" if i % 5 == 0 else "high") for i in range(50)], "doc_id long, domain string")
    assert mixing.mixing_rates(frame(spark, rows), labels, {"toxic": 0.1, "high": 0.9}).count() == len(rows)
    assert {"lexicon", "posteriors"} <= {label for label, _ in plans}
    assert [label for label, plan in plans if "lambdafunction" in plan.lower()] == []


def test_mixing_measures_of_odd_texts(spark):
    import regex

    texts = ["", " ", "a", " a", "a ", "\t\n\x0b\f\r", "a\x0bb\fc\rd", "a\u00a0b\u2028c", "%$&*#|@~^", "%\n^ \U0001f600|é", "%%a%%\n\n##", "ÄÖ١٢x²-Ⅷ", "-a-", "--", "İstanbul ẞ", "x" * 5000 + "~"]
    symbols = mixing.TRAITS.index("symbols")
    got = frame(spark, list(enumerate(texts)), clash=False).select("doc_id", mixing.token_count(F.col("text")).alias("n"), mixing.words_of(F.col("text")).alias("w"), mixing.traits(F.col("text"))[symbols].alias("s")).collect()
    for r in got:
        t = texts[r.doc_id]
        assert r.n == len([w for w in regex.split(r"[ \t\n\x0b\f\r]+", t) if w])
        assert r.w == [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]
        assert abs(r.s - min(2.0, sum(map(t.count, "%$&*#|@~^")) / (len(t) + 1) * 10)) < 1e-12
    nothing = spark.createDataFrame([(None,)], "text string").select(mixing.token_count(F.col("text")), mixing.words_of(F.col("text"))).first()
    assert tuple(nothing) == (0, None)


def test_mixing_rates_of_many_pulls(spark):
    rng = np.random.default_rng(3)
    p, pulls = rng.random((20, 3)), (rng.normal(size=(400, 3)) * 0.3).tolist()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, p array<double>")
    want = np.ones(20)
    for v in pulls:
        want = np.maximum(0, want + p @ np.array(v))
    got = {r["id"]: r["rate"] for r in rows.select("id", mixing.rate_of(pulls).alias("rate")).collect()}
    assert np.allclose([got[i] for i in range(20)], want) and {r[0] for r in rows.select(mixing.rate_of([])).collect()} == {1.0}


def test_toxicity_finds_held_out_words(spark):
    rng = random.Random(6)
    bad = ["vile", "nasty", "foul"]
    rows, labels = [], []
    for i in range(1200):
        words = prose(rng, 40).split()
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad)
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "vile nasty"), (5002, "fine " * 20000)]
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score_toxicity(df.select("doc_id", "text"), toxicity.fit_toxicity(df, lab)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.held and r.doc_id < 1200]
    right = sum(r.predicted == int(r.doc_id % 8 == 0) for r in held)
    assert len(out) == len(rows) and right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.predicted for r in out if r.doc_id in (5000, 5001, 5002)} == {5000: 0, 5001: 0, 5002: 0}
    none = toxicity.fit_toxicity(df, lab.filter("toxic = 2"))
    assert none.score("anything") == 0.0
    assert toxicity.score_toxicity(frame(spark, []), none).count() == 0


def test_risk_never_goes_negative_for_ever():
    rng = np.random.default_rng(0)
    pos = [rng.choice(20, 3, replace=False) for _ in range(30)]
    unl = [rng.choice(np.arange(20, 60), 3, replace=False) for _ in range(200)]
    w, b = toxicity.train_nnpu(pos, unl, 60, 0.1)
    assert np.isfinite(w).all() and w[:20].mean() > w[20:].mean() and np.isfinite(b)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.without_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows and all(r.round_trip for r in rows) and {r.doc_id for r in rows} <= ids


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline_stages_equal_brute_force(spark):
    """The two stages that decide exactly, on small tables: who stays, and what is cut."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    one = corpus_pipeline.without_near_copies(spark, docs, SF)
    stays = {d for d, _, c in brute_classes(rows) if d == c}
    assert {r.doc_id for r in one.collect()} == stays
    cut = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, SF).collect()}
    for (d, t), (n, gone, _, sha) in zip(rows, brute_removed([t for _, t in rows], 200)):
        assert (cut[d] == t) == (gone == 0)
        if gone in (0, n):
            assert hashlib.sha256(cut[d].encode()).hexdigest() == sha


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline_stages_on_odd_tables(spark):
    """Empty tables, null ids and texts, repeated rows and clashing names, for each stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    blank = [(None, None), (None, ""), (7, None), (7, None), (None, "a text without an id"), (None, "a text without an id")]
    odd = spark.createDataFrame(blank, "doc_id long, text string")
    odd = docs.limit(20).unionByName(odd.withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in ("doc_id", "text")}))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert name == "bpe" or out.columns == docs.columns
        rows = out.collect()
        assert sum(r.doc_id is None for r in rows) == (3 if name == "ngram_jaccard_join" else 4), name
        assert stage(spark, docs.limit(0), SF).count() == 0
