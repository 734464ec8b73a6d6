"""Listing, splitting, routing, versions, search and answers on hand-made rows."""

import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import text as T
from voxlake.operators import documents as D
from voxlake.operators import items as N
from voxlake.operators import library as L
from voxlake.operators import routing as R
from voxlake.operators import search as S
from voxlake.operators import summaries as M
from voxlake.operators import vectors as V
from voxlake.operators.hashtree import HashTree, tree_differences, unequal_leaves
from voxlake.operators.postings import TrigramIndex
from voxlake.operators.scans import covering
from voxlake.plans import registry
from voxlake.sources import generations as E
from voxlake.sources import ingest as I  # noqa: E741
from voxlake.sources import versions as G
from voxlake.streaming.changelog import IndexLog, no_faults
from voxlake.streaming.jobs import shared_folder

SF = "/root/testdata/sf0.001"


def test_places_of_matches(spark):
    """Against a search that tries every place, where folding lengthens characters too."""
    for text, term in (("Straße STRASSE sßs", "ss"), ("ßßß", "sss"), ("ﬃ office", "ffi"), ("xﬃ", "fi"), ("aaaa", "aa"), ("e\u0301té", "é"), ("", "a"), ("İi", "i")):
        plain = unicodedata.normalize("NFC", text)
        owner = [i for i, c in enumerate(plain) for _ in c.casefold()]
        flat, at, want = "".join(c.casefold() for c in plain), 0, []
        while at <= len(flat) - len(term):
            if flat[at : at + len(term)] == term:
                want.append((owner[at], owner[at + len(term) - 1] + 1))
                at += len(term)
            else:
                at += 1
        assert S.places_of(text, [term]) == {term: want}
    d = documents(spark, [("segment:1:0", "segment", "r", None, "Aha aha", "ha")])
    assert sorted((r.field, r.start, r.end) for r in S.match_positions(d, "ha").collect()) == [("aux", 0, 2), ("body", 1, 3), ("body", 5, 7)]


def test_hash_trees(spark):
    """The same faults as the three-way join, from few rows."""
    rows = [(f"k{i}", f"h{i}", "2") for i in range(4000)]
    e = spark.createDataFrame(rows, "document_key string, content_hash string, index_version string")
    odd = F.col("document_key").isin("k5", "k77")
    r = e.filter("document_key <> 'k9'").withColumns({"content_hash": F.when(odd, "old").otherwise(F.col("content_hash")), "index_version": F.when(F.col("document_key") == "k11", "1").otherwise(F.col("index_version"))})
    i = r.filter("document_key <> 'k13'").withColumn("content_hash", F.when(F.col("document_key") == "k17", "old").otherwise(F.col("content_hash"))).drop("index_version")
    trees = [HashTree(spark, shared_folder(spark, "tree")).build(x) for x in (e, r, i)]
    assert sorted(map(tuple, tree_differences(*trees).collect())) == sorted(map(tuple, D.index_differences(e, r, i).collect()))
    leaves = unequal_leaves(trees[0], trees[1])
    assert len(leaves) <= 4 and trees[0].rows(leaves).count() < 40
    assert unequal_leaves(trees[0], trees[0]) == [] and tree_differences(trees[0], trees[0], trees[0]).count() == 0
    none = HashTree(spark, shared_folder(spark, "tree")).build(e.limit(0))
    assert tree_differences(none, none, none).count() == 0 and tree_differences(trees[0], none, none).count() == 4000


def test_generations(spark):
    path = shared_folder(spark, "vectors")
    assert E.active(spark, path)[0]["generation"] is None and E.active(spark, path)[1].count() == 0
    d = spark.createDataFrame([(f"d{i}", f"h{i}", f"text {i}") for i in range(500)], "document_key string, content_hash string, text string").repartition(3)
    E.rebuilt(d, path, "a", V.hash_embedder(4))
    known, vectors = E.active(spark, path)
    assert known == {"generation": "a", "rows": 500, "dimensions": 4} and vectors.count() == 500
    with pytest.raises(E.GenerationError):
        E.rebuilt(d, path, "b", lambda ts: [[float("nan")] * 4 for _ in ts])
    with pytest.raises(E.GenerationError):  # a batch fails
        E.rebuilt(d, path, "b", lambda ts: [[1.0] * 4 for t in ts if 1 / (t != "text 77")])
    assert E.active(spark, path)[0]["generation"] == "a" and E.active(spark, path)[1].count() == 500
    E.rebuilt(d.limit(0), path, "c", V.hash_embedder(4))
    assert E.active(spark, path)[0] == {"generation": "c", "rows": 0, "dimensions": None}


def test_covering_a_hot_key(spark):
    """A sweep equals a range join, also where a key holds most points; points without a key or a place lie in nothing."""
    points = spark.createDataFrame([(1, i % 900, i) for i in range(2000)] + [(2, 5, -1), (None, 5, -2), (1, None, -3)], "k long, at int, v int")
    spans = spark.createDataFrame([(1, 10, 20, 7), (1, 20, 25, 8), (1, 100, 800, 9), (2, 6, 9, 1), (3, 0, 9, 2)], "k long, lo int, hi int, id int")
    got = covering(points, spans, "k", "at", "span")
    want = points.alias("p").join(spans.alias("s"), F.expr("p.k = s.k and at >= lo and at < hi"), "left").selectExpr("p.k", "at", "v", "id as span")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_text_functions(spark):
    df = spark.createDataFrame([("é", " Straße ", "a \n b  c"), ("é", "\x1fx ", "")], "a string, b string, c string")
    got = df.select(T.nfc("a").alias("a"), T.tag_name_key(F.col("b")).alias("k"), T.strip("b").alias("s"), T.excerpt(F.col("c"), 3).alias("x")).collect()
    assert [r.a for r in got] == ["é", "é"] and got[0].k == "strasse" and [r.s for r in got] == ["Straße", "x"] and [r.x for r in got] == ["a b", ""]
    T.register(spark)
    assert spark.sql("SELECT fold('ﬃ')").first()[0] == "ffi"


def test_output_identity(spark):
    df = spark.createDataFrame([("en",), ("EN",), ("und",), ("yue",), ("zh-Hant",), ("zh-HK",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(T.is_output_identity(F.col("c"))).collect()] == [True, False, False, False, True, False, False, False]
    with pytest.raises(ValueError):
        L.resolve_output("fi")


def test_error_detail(spark):
    rows = [("Transcribing /a/b.wav\n\nError: no /x/y.wav\none\ntwo\nthree",), ("first\nlast  \n",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.error_detail(F.col("t"))).collect()]
    assert got == ["Error: no <path> | one | two", "last", "", ""]


def test_local_day_in_any_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            lo, hi = L.local_day_bounds("2024-03-31", "Europe/Helsinki")  # 23 hours long
            assert spark.range(1).select(lo.cast("long"), hi.cast("long")).first()[:] == (1711836000, 1711836000 + 23 * 3600)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("bad", [{"tag_match": "some"}, {"tags": tuple("abcdefghijk")}, {"date": "2024-01-01", "date_to": "2024-01-02"}])
def test_filter_rules(bad):
    with pytest.raises(ValueError):
        N.Filters(**bad)
    assert N.scope_filters(N.Filters(tags=("x",), status="failed"), {"y"}, {"failed"}) == (N.Filters(), True)
    with pytest.raises(ValueError):
        N.item_order("size")


def test_valid_layout_rules(spark):
    lay = spark.createDataFrame([(i, True, i != 2, 0, 6, 5 if i == 3 else 6) for i in range(1, 8)], "transcript_id long, is_active boolean, transcript_active boolean, start_ordinal int, end_ordinal int, n int")
    title = {4: " ", 5: "a\x07", 6: "Segment 1 of 202401010000"}
    rows = [(t * 10 + i, t, i + 1, title.get(t, "part"), t >= 6, a, b) for t in range(1, 7) for i, (a, b) in enumerate([(0, 3), (3, 6)])]
    rows += [(70 + i, 7, i + 1, f"Segment {i + 1} of 202401010000", True, a, b) for i, (a, b) in enumerate([(0, 3), (3, 6)])]
    sec = spark.createDataFrame(rows, "section_id long, transcript_id long, ordinal int, title string, title_is_temporary boolean, start_ordinal int, end_ordinal int")
    assert {r.transcript_id: r.valid for r in L.valid_layouts(lay, sec).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}


def split_case(spark, **asked):
    row = {"transcript_id": 1, "start": 0, "end": 9, "splits": [3], "titles": ["a", "b"], "temporary": [False, False]} | asked
    req = spark.createDataFrame([tuple(row.values())], "transcript_id long, start int, end int, splits array<int>, titles array<string>, temporary array<boolean>")
    t = spark.createDataFrame([(1, True, 9, 0, 8), (2, True, 9, 1, 9), (3, True, 0, None, None)], "transcript_id long, is_active boolean, n long, first int, last int")
    t = t.withColumns({"archived_at": F.lit(None).cast("timestamp"), "started_at": F.lit("2024-01-01").cast("timestamp")})
    lay = spark.createDataFrame([], "transcript_id long, revision int, is_active boolean, start_ordinal int, end_ordinal int")
    sec = spark.createDataFrame([], "transcript_id long, ordinal int, start_ordinal int, end_ordinal int, title string, title_is_temporary boolean")
    got, made = N.plan_splits(req, t, lay, sec)
    return got.first(), made.orderBy("ordinal").collect()


def test_splits(spark):
    got, made = split_case(spark, splits=[6, 3], titles=["a", "", "c"], temporary=[False, True, False])
    assert (got.fault, got.action, got.revision) == (None, "create", 1)
    assert [(r.ordinal, r.start_ordinal, r.end_ordinal, r.title) for r in made] == [(1, 0, 3, "a"), (2, 3, 6, "Segment 2 of 202401010000"), (3, 6, 9, "c")]
    assert split_case(spark, splits=[], titles=[], temporary=[])[0].action == "unchanged"
    faults = [
        ({"splits": [0]}, "split_at_endpoint"), ({"splits": [10]}, "split_out_of_range"), ({"end": 10}, "range_out_of_bounds"), ({"transcript_id": 9}, "transcript_not_found"), ({"transcript_id": 2}, "segments_not_contiguous"),
        ({"transcript_id": 3}, "transcript_empty"), ({"temporary": [True]}, "title_flag_count_mismatch"), ({"titles": ["a", "\x00"]}, "invalid_title"), ({"temporary": [False, True]}, "title_flag_forgery"), ({"start": 9, "splits": [], "titles": [], "temporary": []}, "empty_range"),
    ]
    for asked, fault in faults:
        assert split_case(spark, **asked)[0].fault == fault


def test_routing(spark):
    """Candidates that speak for one language, for none, and for both; and every reason."""
    yue, cmn, en = "佢哋唔喺嗰度嘅點" * 3, "你们什么吗怎么咱们" * 3, "a plain english sentence with words"
    rows = [(1, yue, "他在那里", en), (2, "他在那里", cmn, en), (3, yue, cmn, en), (4, en, en, en), (5, yue, yue, "x y z")]
    e = R.evidence(spark.createDataFrame(rows, "key int, hk_text string, cn_text string, eu_text string"))
    e = e.withColumns({"windows": F.lit(3), "loud": F.lit(3), "enabled": F.lit(True), "sampling": F.lit(None).cast("string"), "silent": F.lit(False), "complete": F.lit(True), "classifier": F.lit(None).cast("string"), "confidence": F.lit(0.9)})
    got = {r.key: (r.family, r.verdict, r.gate, r.reason) for r in R.routed(e).collect()}
    assert got[1] == ("chinese", "cantonese", "cantonese", "auto_confident_heuristic_unavailable")
    assert got[2] == ("chinese", "mandarin", "mandarin", "auto_confident_heuristic_unavailable")
    assert got[3] == ("chinese", "uncertain", None, "classifier_unavailable") and got[4][:2] == ("european", "uncertain") and got[5][0] == "chinese"
    few = {r.key: r.gate for r in R.routed(e.withColumn("loud", F.lit(1))).collect()}
    assert set(few.values()) == {None}
    cases = [("enabled", F.lit(False), "routing_disabled"), ("sampling", F.lit("too_short"), "too_short"), ("sampling", F.lit("io"), "sampling_failed"), ("silent", F.lit(True), "silent"), ("complete", F.lit(False), "candidates_disagree"),
             ("classifier", F.lit("klingon"), "auto_confident_heuristic_invalid"), ("classifier", F.lit("european"), "contradictory_evidence"), ("classifier", F.lit("cantonese"), "auto_confident"), ("classifier", F.lit("mandarin"), "zh_ambiguous"), ("classifier", F.lit("uncertain"), "low_confidence")]
    for column, value, reason in cases:
        assert R.routed(e.filter("key = 1").withColumn(column, value)).first().reason == reason
    low = R.routed(e.filter("key = 1").withColumns({"classifier": F.lit("cantonese"), "confidence": F.lit(0.5)})).first()
    assert (low.reason, low.route) == ("low_confidence", "cantonese")
    other = R.routed(e.filter("key = 1").withColumn("classifier", F.lit("mandarin"))).first()
    assert (other.reason, other.route) == ("zh_ambiguous", "mandarin")  # the classifier's route stays
    unsure = R.routed(e.filter("key = 1").withColumns({"classifier": F.lit("european"), "eu_cjk": F.lit(0.9), "zh_cjk": F.lit(0.1)})).first()
    assert (unsure.family, unsure.reason, unsure.route) == ("uncertain", "auto_confident", "european")  # no family, no contradiction


def test_classify(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key long, sample string")
    got = R.classify(df, lambda ts: [(None, None) if t == "b" else ("european", 0.7) for t in ts], batch=2)
    assert {r.key: r.classifier for r in got.collect()} == {1: "european", 2: None, 3: "european"}


def test_sources_and_generations(spark, tmp_path):
    for name in ("a.WAV", "b.mp3", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = I.scan_files(spark, str(tmp_path)).collect()
    assert [r.path_identity.rsplit("/", 1)[1] for r in found] == ["a.wav", "b.mp3"] and len({r.sha256 for r in found}) == 2
    root = f"{tmp_path}/index"
    for n in (3, 5):
        G.publish(spark, root, G.store_generation(spark.range(n), root))
        assert G.active_generation(spark, root).count() == n
    path = f"{tmp_path}/parts"
    spark.createDataFrame([(1, "a"), (2, "b")], "p int, v string").write.partitionBy("p").parquet(path)
    G.replace_partitions(spark.createDataFrame([(2, "c")], "p int, v string"), path, "p")
    assert sorted((r.p, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_promotion_refuses_faulty_vectors(spark):
    g = spark.createDataFrame([(1, "active"), (2, "building")], "generation_id int, state string")
    docs = spark.createDataFrame([("a", "h")], "document_key string, content_hash string")
    for vec, states in (([1.0, 0.0], ["superseded", "active"]), ([0.0, 0.0], ["active", "failed"])):
        v = spark.createDataFrame([(2, "a", "h", vec)], "generation_id int, document_key string, source_content_hash string, embedding array<double>")
        assert [r.state for r in G.promoted(g, 2, docs, v, 2).orderBy("generation_id").collect()] == states


def documents(spark, rows):
    d = spark.createDataFrame(rows, "document_key string, doc_type string, recording_id string, title_text string, body_text string, aux_text string")
    return S.folded(d)


def test_all_matches_compete(spark):
    """The best document of a recording wins though a hundred others have smaller keys."""
    rows = [(f"segment:a:{i:04}", "segment", "a", "", "needle", "") for i in range(150)] + [("segment:a:9999", "segment", "a", "", "needle needle", "")]
    d = documents(spark, rows)
    assert S.keyword_search(d, "needle").first().document_key == "segment:a:9999"
    cut = S.search(d, "needle", per_unit=100).first()
    assert (cut.document_key, cut.truncated, cut.more) == ("segment:a:0000", True, 0)
    over = S.search(documents(spark, [(f"segment:u{i}:0", "segment", f"u{i}", "", "needle", "") for i in range(5)]), "needle", limit=2, per_unit=1, total=3).first()
    assert (over.truncated, over.more) == (True, None)
    exact = S.search(documents(spark, [(f"segment:u{i}:0", "segment", f"u{i}", "", "needle", "") for i in range(5)]), "needle", limit=2).first()
    assert (exact.truncated, exact.more) == (False, 3)


def test_search_many_equals_one_by_one(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "Straße", "ab"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    d = documents(spark, [(f"summary:{i}", rng.choice(["summary", "segment"]), f"r{i % 9}", text(2), text(rng.randint(0, 12)), text(1)) for i in range(80)])
    asked = ["alpha", "beta gamma", "strasse ab", "delta epsilon alpha", "missing"]
    q = spark.createDataFrame([(i, S.terms_of(t)) for i, t in enumerate(asked)], "query_id long, terms array<string>")
    got = {(r.query_id, r["rank"]): (r.recording_id, r.document_key, r.worst, r.occurrences, r["first"]) for r in S.search_many(d, q).collect()}
    want = {(i, r["rank"]): (r.recording_id, r.document_key, r.worst, r.occurrences, r["first"]) for i, t in enumerate(asked) for r in S.keyword_search(d, t).collect()}
    assert got == want
    index = TrigramIndex(spark, shared_folder(spark, "trigrams")).build(d.repartition(5))
    for t in asked:
        held = {r.document_key for r in S.keyword_matches(index.matching(t), t).collect()}
        assert held == {r.document_key for r in S.keyword_matches(d, t).collect()} and index.candidates(t).count() <= 80
    blocks = index.blocks.collect()
    assert all(len(b.places) == 2 * b.n and list(np.frombuffer(b.places, np.uint16)) == sorted(set(np.frombuffer(b.places, np.uint16))) for b in blocks) and len({b.range for b in blocks}) > 1
    many = q.select("query_id", "terms", F.explode(F.sequence(F.lit(0), F.lit(20_000), F.lit(10))).alias("more")).select((F.col("query_id") + F.col("more")).alias("query_id"), "terms")
    assert S.search_many(d, many).select("query_id").distinct().count() == 4 * 2001
    stored = S.search_many(d, q, postings=S.trigram_postings(d))
    assert {(r.query_id, r["rank"]): r.recording_id for r in stored.collect()} == {k: v[0] for k, v in want.items()}
    with pytest.raises(ValueError):
        S.search_many(d, spark.createDataFrame([(1, ["ab"])], "query_id long, terms array<string>"))


@pytest.mark.skipif(not registry.QUERIES, reason="no queries")
def test_snippets_equal_brute_force(spark):
    """Each snippet holds the query's first match, and its ranges are where the folded terms are."""
    rows = registry.QUERIES["snippet_ranges"](spark, SF).collect()
    texts = {r.document_key: r for r in registry.QUERIES["search_documents"](spark, SF).collect()}
    assert len(rows) == 50
    fold = lambda s: s.casefold()
    for r in rows:
        doc, snip = texts[r.document_key], r.snippet
        whole = doc[f"{snip.field}_text"]
        assert snip.text in whole and len(snip.text) <= 320 and snip.matches
        assert snip.ellipsis_before == (not whole.startswith(snip.text)) or whole.count(snip.text) > 1
        for m in snip.matches:
            hit = fold(snip.text[m.start : m.end])
            assert any(t in hit or hit in t for t in registry.QUERY.split())
        first = min(fold(whole).find(t) for t in registry.QUERY.split() if t in fold(whole))
        assert fold(whole)[first : first + 2] in fold(snip.text)


def test_vector_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    data = rng.integers(-3, 4, (300, 4)).astype(float)
    data[~data.any(axis=1)] = 1
    rows = [(f"d{i:03}", i % 40, int(i % 3), v.tolist()) for i, v in enumerate(data)]
    v = spark.createDataFrame(rows, "document_key string, unit int, type int, embedding array<double>")
    q = spark.createDataFrame([(i, data[i].tolist()) for i in range(0, 300, 50)], "query_id long, query array<double>")
    got = {}
    for r in V.best_documents(q, v, 2, 12, block_rows=40, query_rows=2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.document_key, round(r.cosine, 9))
    for i in range(0, 300, 50):
        cos = np.einsum("ij,j->i", data, data[i]) / np.sqrt((data**2).sum(1)) / np.sqrt((data[i] ** 2).sum())
        order = sorted(range(300), key=lambda k: (-cos[k], k % 3, f"d{k:03}"))
        held, seen = [], {}
        for k in order:
            seen[k % 40] = seen.get(k % 40, 0) + 1
            if seen[k % 40] <= 2:
                held.append((f"d{k:03}", round(float(cos[k]), 9)))
        assert [c for _, c in held[:12]] == [got[i][n][1] for n in range(1, 13)]


def test_integrity_fails_closed(spark):
    docs = spark.createDataFrame([("a", "h"), ("b", "h")], "document_key string, content_hash string")
    v = spark.createDataFrame([("a", "h", 1, 0, [1.0, 0.0]), ("b", "old", 1, 0, [1.0, 1.0])], "document_key string, source_content_hash string, unit int, type int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    with pytest.raises(V.IntegrityError):
        V.semantic_search(q, v, documents=docs, dimensions=2)
    with pytest.raises(ValueError):
        V.semantic_search(q, v)
    assert V.semantic_search(q, v, unchecked=True).count() == 1


def test_evidence_budget_is_a_prefix(spark):
    v = spark.createDataFrame([(f"d{i}", i, 2, [1.0, i / 10]) for i in range(6)] + [("x", 9, 1, [1.0, 0.0])], "document_key string, unit int, type int, embedding array<double>")
    texts = spark.createDataFrame([(f"d{i}", "h", "t" * n) for i, n in enumerate([50, 0, 60, 200, 5, 5])] + [("x", "h", "t")], "document_key string, content_hash string, text string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    got = V.evidence(q, v, texts, budget=120, chars=100).orderBy("citation").collect()
    assert [(r.citation, r.document_key) for r in got] == [("C1", "d0"), ("C2", "d2")]


def test_ask_retries_once(spark):
    q = spark.createDataFrame([(1, "good"), (2, "never"), (3, "no evidence")], "query_id long, question string")
    e = spark.createDataFrame([(1, "C1", "text"), (1, "C2", "more"), (2, "C1", "text")], "query_id long, citation string, excerpt string")

    def chat(prompts):
        return [json.dumps({"answer": "So [C2][C1].", "citations": [1, 2], "insufficient": False}) if p.startswith("good") else "no json" for p in prompts]

    got = {r.query_id: (r.state, r.citations, r.calls) for r in V.ask(q, e, chat).collect()}
    assert got == {1: ("answered", [1, 2], 1), 2: ("failed", [], 2), 3: ("insufficient", [], 0)}


def test_summaries_over_the_cap(spark):
    c = spark.createDataFrame([(1, i, "x" * 10) for i in range(4)] + [(2, 0, "y" * 99)] + [(3, i, "z" * 40) for i in range(4)], "transcript_id long, chunk_no int, text string")
    got = {r.transcript_id: (r.status, r.summary) for r in M.summarise(c, lambda ts: ts, lambda ts: f"{len(ts)}", cap=25).collect()}
    assert got == {1: ("ok", "2"), 2: ("ok", "1"), 3: ("too_long", None)}
    s = spark.createDataFrame([(1, 0, "a" * 30), (2, 0, "b")], "transcript_id long, ordinal int, text string")
    assert {(r.transcript_id, r.status, r.chunks, r.text) for r in M.planned(s, 10, 2, max_chars=20).collect()} == {(1, "too_long", 3, None), (2, "ok", 1, "b")}
    assert {r.transcript_id: r.status for r in M.transcript_sizes(s, 20).collect()} == {1: "too_long", 2: "ok"}
    assert {r.transcript_id: r.status for r in M.chunk_limits(c, max_chunks=3).collect()} == {1: "too_many_chunks", 2: "ok", 3: "too_many_chunks"}


def test_index_report_when_healthy(spark):
    none = spark.createDataFrame([], "document_key string, category string")
    assert [(r.category, r.n) for r in D.index_report(none).collect()] == [("healthy", 0)]
    some = spark.createDataFrame([(f"k{i:03}", "stale_content") for i in range(25)], "document_key string, category string")
    (r,) = D.index_report(some).collect()
    assert (r.n, r.omitted, r.samples[0], len(r.samples)) == (25, 5, "k000", 20)


def test_sync_marks_removed_documents(spark, tmp_path):
    seg = spark.createDataFrame([("r1", 1, 0, "s", "one"), ("r2", 2, 0, "s", "two"), ("r2", 2, 1, "s", "three")], "recording_id string, transcript_id long, ordinal int, speaker string, text string")
    docs = D.documents_from_segments(seg)
    docs = docs.withColumn("index_hash", F.col("content_hash"))
    index = IndexLog(spark, f"{tmp_path}/index", docs.schema)
    index.write(docs.filter("document_key <> 'segment:1:0'"))
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "recording_id string")
    fault = lambda *ids: spark.createDataFrame([(i, "broken") for i in ids], "recording_id string, fault string")
    run = index.sync(lambda ids: (docs.filter("document_key <> 'segment:2:1'"), fault("r1")), attempts=2)
    for _ in range(2):  # delivered twice
        run(one("r1", "r2"), 0)
    assert sorted(r.document_key for r in index.read().collect()) == ["segment:2:0"]
    assert [r.document_key for r in index.removed().collect()] == ["segment:2:1"]
    said = lambda: {r.recording_id: (r.attempt, r.outcome, r.inserted, r.deleted, r.skipped) for r in index.outcomes().collect()}
    assert said() == {"r1": (1, "failed", 0, 0, 0), "r2": (1, "synced", 0, 1, 1)}
    index.sync(lambda ids: (docs, no_faults(ids)), attempts=2)(one(), 1)  # the failed recording comes along
    assert said()["r1"] == (2, "synced", 1, 0, 0) and index.read().count() == 2
    assert spark.read.parquet(f"{tmp_path}/index/batch=2/changes").count() == 1  # only what changed is written
    before = sorted(map(str, index.rows().collect()))
    assert index.compact() == 2 == index.compact() and sorted(map(str, index.rows().collect())) == before
    hurt = docs.withColumns({"index_hash": F.when(F.col("segment_ordinal") == 0, F.lit(None).cast("string")).otherwise(F.col("index_hash")), "title_text": F.when(F.col("segment_ordinal") == 1, "new").otherwise(F.col("title_text"))})
    index.sync(lambda ids: (hurt, no_faults(ids)))(one("r2", "nobody"), 2)
    (r2,) = index.outcomes().filter("recording_id = 'r2'").collect()
    assert (r2.repaired, r2.inserted, r2.updated, r2.skipped) == (1, 1, 0, 0)
    give_up = index.sync(lambda ids: (docs, fault("r3")), attempts=2)
    give_up(one("r3"), 3)
    give_up(one(), 4)
    give_up(one(), 5)
    assert [(r.attempt, r.outcome, r.batch) for r in index.outcomes().filter("recording_id = 'r3'").collect()] == [(2, "given_up", 5)]
    gone = D.removed_keys(docs, docs.filter("segment_ordinal = 0"), spark.createDataFrame([("r2",)], "recording_id string"))
    assert [r.document_key for r in gone.collect()] == ["segment:2:1"]


def test_empty_tables(spark):
    d = documents(spark, [])
    assert S.keyword_search(d, "x").count() == 0 and S.search(d, "x", per_unit=3).count() == 0
    src = spark.createDataFrame([], "source_id long, recording_id long, original_filename string, path string, first_seen_at timestamp, is_canonical boolean, presence string")
    assert N.filename_list(src).count() == 0 and N.preferred_filename(src).count() == 0 and G.canonical_sources(src).count() == 0


def test_key_point_levels(spark):
    rows = [([("a", 1), ("b", 2), ("c", 3), ("d", 3), ("e", 2), ("f", 0), ("g", 1), (" ", 1), (None, 2), ("h", 3), ("i", 4)],)]
    df = spark.createDataFrame(rows, "p array<struct<text: string, level: int>>")
    assert df.select(M.key_point_lines(F.col("p"))).first()[0] == ["1. a", "1.1 b", "1.1.1 c", "1.1.2 d", "1.2 e", "- f", "2. g", "2.0.1 h", "- i"]


def test_language_faults(spark):
    rows = [("en", "plain words"), ("en", "國" * 10), ("en", "國" * 9), ("en", "國" * 10 + "x" * 91), ("zh-Hant", "x" * 51), ("zh-Hant", "x" * 50), ("zh-Hant", "國" * 5 + "x" * 60), ("fi", "國" * 50)]
    got = [r[0] for r in spark.createDataFrame(rows, "l string, t string").select(M.language_fault(F.col("t"), F.col("l"))).collect()]
    assert got == ["ok", "unexpected_cjk", "ok", "ok", "missing_cjk", "ok", "ok", "ok"]
