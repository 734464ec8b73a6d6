"""Edge cases of single operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from voxlake.functions import text as T
from voxlake.functions import vectors as VF
from voxlake.operators import library as L
from voxlake.operators import search as S
from voxlake.operators import summaries as M
from voxlake.operators import vectors as V
from voxlake.sources import ingest as I  # noqa: E741


def values(df, column):
    return [r[column] for r in df.collect()]


def test_fold(spark):
    df = spark.createDataFrame([("Straße",), ("ﬃ",), ("é",), (None,), ("",)], "t string")
    assert values(df.select(T.fold("t").alias("f")), "f") == ["strasse", "ffi", "é", None, ""]


def test_language_tags(spark):
    df = spark.createDataFrame([("ZH_hant-tw",), ("en",), ("english",), (None,), ("",)], "c string")
    assert values(df.select(T.canonical_language(F.col("c")).alias("l")), "l") == ["zh-Hant-TW", "en", "", "", ""]


def test_frames_differ(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), (None, "a")], "x string, y string")
    assert len(set(values(df.select(T.content_hash([F.col("x"), F.col("y")]).alias("h")), "h"))) == 4


def test_ratios_of_empty_text(spark):
    df = spark.createDataFrame([("",), ("  ",), ("國a",)], "t string")
    got = df.select(T.cjk_ratio(F.col("t")).alias("c"), T.nonsense_ratio(F.col("t")).alias("n")).collect()
    assert [(r.c, r.n) for r in got] == [(0.0, 1.0), (0.0, 1.0), (0.5, 0.0)]


def test_vector_usability(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([1.0],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert values(df.select(VF.usability(F.col("v"), 2).alias("u")), "u") == ["ok", "zero", "invalid", "invalid", "invalid", "invalid"]


@pytest.mark.parametrize("bad", ["", "   ", "x" * 257, "a b c d e f g h i"])
def test_query_rules(bad):
    with pytest.raises(ValueError):
        S.terms_of(bad)


def test_snippet_maps_folded_places_back():
    field, text, found, before, after = S._snippet_of([("title", ""), ("body", "x" * 400 + "Straße" + "y" * 400)], ["strasse"])
    assert field == "body" and len(text) == 320 and before and after
    assert text[found[0]["start"] : found[0]["end"]] == "Straße"


def test_pack():
    assert M.pack([]) == []
    assert M.pack(["aaa", "bbb"], 7, 3) == ["aaa\nbbb"]
    assert M.pack(["aaaa", "bb", "cccc"], 8, 3) == ["aaaa\nbb", "bb\ncccc"]
    assert M.pack(["abcdefghij"], 4, 2) == ["abcd", "efgh", "ij"]


def test_transcript_faults(spark):
    seg = '{"text": "t", "segments": [%s]}'
    one = '{"start": %s, "end": %s, "text": "t"}'
    files = [
        (1, "{broken"), (2, '{"text": "x"}'), (3, seg % (one % (5000, 6000) + "," + one % (3000, 3500))), (4, seg % (one % (5000, 6000) + "," + one % (2999, 3500))),
        (5, seg % (one % (-1, 5))), (6, seg % (one % (9, 5))), (7, seg % '{"start": true, "end": 5, "text": "t"}'), (8, seg % '{"start": 1, "end": 5}'),
        (9, seg % ""), (10, seg % '"text"'), (11, seg % '{"text": 5}'), (12, seg % '{"text": "t", "speaker": 3}'), (13, seg % '{"text": "t", "start": "1"}'), (14, seg % '{"text": "t", "start": 1e999}'),
        (15, '{"segments": []}'), (16, '{"text": 1, "segments": []}'), (17, '{"text": "t", "segments": {}}'), (18, "[]"), (19, "null"), (20, seg % "" + " more"), (21, None), (22, seg % "null"),
        (23, seg % '{"text": "t", "speaker": null, "start": null}'), (24, seg % (one % (20000, 20001) + ',{"text": "t"},' + one % (1000, 1001))),
    ]
    got = {r.file_id: r.category for r in I.quarantine(I.parse_transcripts(spark.createDataFrame(files, "file_id long, raw string"))).collect()}
    assert got.pop(24) == "non_monotonic_start" and {got.pop(i) for i in (10, 22)} == {"invalid_segment_item"} and {got.pop(i) for i in (15, 16, 17, 18, 19)} == {"invalid_envelope"} and {got.pop(i) for i in (20, 21)} == {"malformed_json"}
    assert (got.pop(11), got.pop(12), got.pop(13), got.pop(14)) == ("invalid_segment_text", "invalid_segment_speaker", "invalid_timestamp", "invalid_timestamp")
    assert got == {1: "malformed_json", 2: "invalid_envelope", 4: "non_monotonic_start", 5: "invalid_timestamp", 6: "end_before_start", 7: "invalid_timestamp", 8: "invalid_segment_text"}


def test_recorded_at(spark):
    df = spark.createDataFrame([("rec 2024-03-31 093015.wav",), ("20240517.m4a",), ("2024-13-40.wav",), ("notes",)], "n string")
    got = [str(v) for v in values(df.select(I.recorded_at(F.col("n")).alias("t")), "t")]
    assert got == ["2024-03-31 09:30:15", "2024-05-17 00:00:00", "None", "None"]


def test_valid_layouts(spark):
    lay = spark.createDataFrame([(1, True, 0, 6), (2, True, 0, 6), (3, True, 0, 6), (4, False, 0, 6), (5, True, 0, 6)], "transcript_id long, is_active boolean, start_ordinal int, end_ordinal int")
    rows = []
    for t, parts in {1: [(0, 3), (3, 6)], 2: [(0, 3), (4, 6)], 3: [(0, 6)], 4: [(0, 3), (3, 6)]}.items():
        rows += [(t * 10 + i, t, i + 1, "part", a, b) for i, (a, b) in enumerate(parts)]
    sec = spark.createDataFrame(rows, "section_id long, transcript_id long, ordinal int, title string, start_ordinal int, end_ordinal int")
    assert {r.transcript_id: r.valid for r in L.valid_layouts(lay, sec).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_scope_applies_before_bounds(spark):
    docs = [(f"segment:{u}:{i}", "segment", u, "", "needle", "") for u in ("a", "b") for i in range(150)]
    d = S.folded(spark.createDataFrame(docs, "document_key string, doc_type string, recording_id string, title_text string, body_text string, aux_text string"))
    scope = spark.createDataFrame([("b",)], "recording_id string")
    assert values(S.keyword_search(d, "needle", scope=scope), "recording_id") == ["b"]


def test_repair_restores_all(spark):
    docs = spark.createDataFrame([("a", "h1", "t1"), ("b", "h2", "t2"), ("c", "h3", "t3")], "document_key string, content_hash string, text string")
    vec = spark.createDataFrame([("a", "h1", [1.0, 0.5]), ("b", "old", [1.0, 1.0]), ("z", "h9", [1.0, 1.0])], "document_key string, source_content_hash string, embedding array<float>")
    fixed = V.repair(docs, vec, 2, V.hash_embedder(2))
    assert {r.category for r in V.classify_vectors(docs, fixed, 2).collect()} == {"ok"} and fixed.count() == 3


def test_sections_of_empty_tables(spark):
    lay = spark.createDataFrame([], "transcript_id long, is_active boolean, start_ordinal int, end_ordinal int")
    sec = spark.createDataFrame([], "section_id long, transcript_id long, ordinal int, title string, start_ordinal int, end_ordinal int")
    assert L.valid_layouts(lay, sec).count() == 0


def packed_step_by_step(texts, limit, overlap):
    """One piece after the other, with the chunk in hand as a list."""
    done, held = [], []
    for piece in (t[i : i + limit] for t in texts for i in range(0, len(t), limit)):
        if held and len("\n".join([*held, piece])) > limit:
            done.append("\n".join(held))
            while held and (len("\n".join(held)) > overlap or len("\n".join([*held, piece])) > limit):
                held = held[1:]
        held = [*held, piece]
        if len("\n".join(held)) == limit:
            done.append("\n".join(held))
            held = []
    return done + ["\n".join(held)] * bool(held)


def test_chunks_of_long_transcripts(spark):
    """Pointer doubling over many blocks equals packing step by step, also where a transcript holds most segments."""
    import random

    rng = random.Random(7)
    texts = {1: ["x" * rng.choice([0, 1, 2, 5, 9, 10, 11, 25]) for _ in range(700)], 2: ["one"], 3: ["y" * 10] * 40, 4: ["z"] * 300, 5: ["", ""]}
    rows = [(t, i * 3, s) for t, ss in texts.items() for i, s in enumerate(ss)] + [(5, 99, None)]
    df = spark.createDataFrame(rows, "transcript_id long, ordinal int, text string").repartition(3)
    for limit, overlap, blocks in ((10, 3, 1), (10, 0, 2), (10, 10, 3), (24, 7, 64)):
        got = {}
        for r in sorted(M.plan_chunks(df, limit, overlap, blocks).collect(), key=lambda r: (r.transcript_id, r.chunk_no)):
            assert r.chunk_no == len(got.setdefault(r.transcript_id, []))
            got[r.transcript_id].append(r.text)
        assert got == {t: packed_step_by_step(ss, limit, overlap) for t, ss in texts.items() if any(ss)}
        assert all(M.pack(ss, limit, overlap) == packed_step_by_step(ss, limit, overlap) for ss in texts.values())


def test_scans_equal_windows(spark):
    """Row numbers and running values, with null keys, ties and a key that holds most rows, against plain windows."""
    import random

    from pyspark.sql import Window

    from voxlake.operators.scans import numbered, running

    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 1, 1, 2, 3, 4]), rng.choice([None, 1, 2, 3]), rng.random()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k long, o long, x double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the hot key lies in several partitions
    try:
        got = numbered(df, "k", ["o", "x"])
        want = df.withColumn("number", F.row_number().over(Window.partitionBy("k").orderBy(F.col("o").asc_nulls_first(), "x")))
        assert sorted(map(repr, got.drop("pos").collect())) == sorted(map(repr, want.collect()))
        assert got.filter("k = 1").select(F.countDistinct(F.shiftright("pos", 33))).first()[0] > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbered(df.limit(0), "k", ["o"]).count() == 0
    d = spark.createDataFrame([(k, o, rng.choice([None, 1, 5, -3])) for k in (None, 1, 2) for o in range(300)], "k long, o long, v long")
    for before in (True, False):
        w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        want = d.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w), "n": F.min("v").over(w)})
        got = running(d, "k", "o", {"s": F.sum("v"), "m": F.max("v"), "n": F.min("v")}, before, block=64)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_replies(spark):
    """Unknown tags, a level that is skipped, a fence, and replies about parts."""
    from voxlake.operators.payloads import checked_parts, checked_replies

    good = '{"title": " T ", "overview": "o", "key_points": [{"text": "a", "level": 1}], "suggested_tags": ["X", "unknown", "no"], "language": "%s"}'
    rows = [(1, good % "fi", ""), (2, "```json\n" + good % "" + "\n```", "EN"), (3, good.replace('"level": 1', '"level": 2') % "", ""), (4, good % "?", ""), (5, good % "?", "sv"), (6, None, ""), (7, "[]", ""), (8, good.replace('"o"', "null") % "", "")]
    tags = spark.createDataFrame([("x", "X"), ("unknown", "Unknown")], "name_key string, name string")
    got = {r.id: (r.fault, r.title, r.language, r.suggested, r.rejected) for r in checked_replies(spark.createDataFrame(rows, "id long, raw string, source_language string"), tags).collect()}
    fine = ("T", "fi", ["X"], ["no"])
    assert got == {1: (None, *fine), 2: (None, "T", "en", *fine[2:]), 3: ("key_points", None, None, None, None), 4: ("language", None, None, None, None), 5: (None, "T", "sv", *fine[2:])} | {i: (f, None, None, None, None) for i, f in ((6, "malformed_json"), (7, "malformed_json"), (8, "overview"))}
    parts = [(1, '{"overview": "o", "key_points": [" a ", "b"]}'), (2, '{"overview": "o", "key_points": [1]}'), (3, '{"overview": "%s"}' % ("x" * 4001)), (4, '{"overview": "o"}')]
    assert {r.id: (r.fault, r.key_points) for r in checked_parts(spark.createDataFrame(parts, "id long, raw string")).collect()} == {1: (None, ["a", "b"]), 2: ("key_points", None), 3: ("overview", None), 4: (None, [])}
