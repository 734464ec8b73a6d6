"""Streams replayed from files give what the batch form gives."""

import datetime as dt

from pyspark.sql import functions as F

from voxlake.operators import documents as D
from voxlake.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def drain(spark, stream, name, mode="append"):
    with J.timers_on(spark):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return spark.table(name).collect()


def test_stability_gate(spark, tmp_path):
    rows = [[("a", 1, 1.0, at(0)), ("b", 1, 1.0, at(0))], [("a", 1, 1.0, at(20)), ("b", 2, 1.0, at(20))], [("a", 1, 1.0, at(31)), ("b", 2, 1.0, at(45))], [("b", 2, 1.0, at(51)), ("a", 1, 1.0, at(90))]]
    schema = "path string, length long, mtime double, seen_at timestamp"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = drain(spark, J.stability_gate(J.replay(spark, f"{tmp_path}/in", schema)), "gate")
    assert sorted((r.path, r.length) for r in got) == [("a", 1), ("b", 2)]


def test_stability_gate_restarts(spark, tmp_path):
    """State comes back from the checkpoint: a file that stood still before a restart passes after it, and only once."""
    schema = "path string, length long, mtime double, seen_at timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in ([("a", 1, 1.0, at(0)), ("b", 1, 1.0, at(0))], [("a", 1, 1.0, at(31)), ("b", 2, 1.0, at(31))], [("a", 1, 1.0, at(70)), ("b", 2, 1.0, at(62))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with J.timers_on(spark):
            J.stability_gate(J.replay(spark, f"{tmp_path}/in", schema)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.path, r.length) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1), ("b", 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_interrupted(spark, tmp_path):
    rows = [[(1, "start", at(0)), (2, "start", at(10))], [(1, "finish", at(600))], [(3, "start", at(90000))], [(4, "start", at(180000))]]
    for part in rows:
        spark.createDataFrame(part, "attempt_id long, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = drain(spark, J.interrupted(J.replay(spark, f"{tmp_path}/in", "attempt_id long, kind string, ts timestamp")), "lost")
    assert sorted(r.attempt_id for r in got) == [2, 3]  # 4 may still finish


def test_running_counts_and_first_contents(spark, tmp_path):
    rows = [("x", at(0)), ("x", at(5)), ("y", at(9))]
    spark.createDataFrame(rows, "sha256 string, seen_at timestamp").write.parquet(f"{tmp_path}/in")
    stream = J.replay(spark, f"{tmp_path}/in", "sha256 string, seen_at timestamp")
    assert sorted(r.sha256 for r in drain(spark, J.first_contents(stream), "firsts")) == ["x", "y"]
    counts = drain(spark, J.running_counts(J.replay(spark, f"{tmp_path}/in", "sha256 string, seen_at timestamp"), "sha256"), "counts", "complete")
    assert {r.sha256: r.n for r in counts} == {"x": 2, "y": 1}


def test_sync_stream_equals_batch(spark, tmp_path):
    seg = spark.createDataFrame([("r1", 1, 0, "s", "one"), ("r2", 2, 0, "s", "two"), ("r3", 3, 0, "s", " ")], "recording_id string, transcript_id long, ordinal int, speaker string, text string")
    expected = D.documents_from_segments(seg)
    held = {"now": spark.createDataFrame([], expected.schema)}

    def touched(ids, batch_id):
        for _ in range(2):  # a batch that is delivered twice changes nothing
            new = D.apply_sync(expected, held["now"], ids)
            held["now"] = spark.createDataFrame(new.collect(), expected.schema)

    spark.createDataFrame([("r1",), ("r2",), ("r2",)], "recording_id string").write.parquet(f"{tmp_path}/in")
    J.sync_stream(J.replay(spark, f"{tmp_path}/in", "recording_id string"), touched, f"{tmp_path}/cp").awaitTermination(120)
    assert {r.document_key for r in held["now"].collect()} == {r.document_key for r in expected.select(F.col("document_key")).collect()}
