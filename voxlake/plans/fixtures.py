"""The driver's tables in the shape of the library's model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recording_id(number: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a transcript, a turn as a segment of one second."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        recording_id(F.col("conv_id")).alias("recording_id"), F.col("conv_id").alias("transcript_id"), F.col("turn").cast("int").alias("ordinal"),
        (F.col("turn") * 1000).alias("start_ms"), ((F.col("turn") + 1) * 1000).alias("end_ms"), F.col("role").alias("speaker"), "text",
    )


def layouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(layouts, sections): a third of the transcripts is split every three turns, some of those with a gap."""
    stats = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("transcript_id")).agg(F.count("*").cast("int").alias("n"))
    lay = stats.select("transcript_id", F.lit(True).alias("is_active"), F.lit(0).alias("start_ordinal"), F.col("n").alias("end_ordinal"))
    split = stats.filter((F.col("transcript_id") % 3 == 0) & (F.col("n") >= 4) | (F.col("transcript_id") % 15 == 2))
    parts = split.select("transcript_id", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 3).cast("int") - 1)).alias("part"))
    gap = F.when((F.col("transcript_id") % 15 == 2) & (F.col("part") == 1), 1).otherwise(0)
    sec = parts.select(
        (F.col("transcript_id") * 1000 + F.col("part") + 1).alias("section_id"), "transcript_id", (F.col("part") + 1).alias("ordinal"),
        F.concat(F.lit("Part "), (F.col("part") + 1).cast("string")).alias("title"),
        (F.col("part") * 3 + gap).cast("int").alias("start_ordinal"), F.least(F.col("part") * 3 + 3, F.col("n")).cast("int").alias("end_ordinal"),
        F.lit(None).cast("timestamp").alias("archived_at"),
    )
    return lay, sec


#: The same, as DuckDB common table expressions.
SECTIONS_SQL = """
stats AS (SELECT conv_id AS transcript_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY 1),
split AS (SELECT * FROM stats WHERE (transcript_id % 3 = 0 AND n >= 4) OR transcript_id % 15 = 2),
sections AS (
  SELECT transcript_id * 1000 + part + 1 AS section_id, transcript_id, CAST(part + 1 AS INT) AS ordinal, 'Part ' || CAST(part + 1 AS VARCHAR) AS title,
    CAST(part * 3 + CASE WHEN transcript_id % 15 = 2 AND part = 1 THEN 1 ELSE 0 END AS INT) AS start_ordinal,
    CAST(least(part * 3 + 3, n) AS INT) AS end_ordinal, n
  FROM (SELECT *, unnest(generate_series(0, CAST(ceil(n / 3.0) AS INT) - 1)) AS part FROM split)),
checked AS (
  SELECT *, lag(end_ordinal) OVER (PARTITION BY transcript_id ORDER BY ordinal) AS before FROM sections),
valid AS (
  SELECT transcript_id FROM checked GROUP BY 1
  HAVING count(*) BETWEEN 2 AND 200 AND bool_and(start_ordinal = coalesce(before, 0)) AND bool_and(start_ordinal < end_ordinal)
    AND max(end_ordinal) = max(n) AND min(ordinal) = 1 AND max(ordinal) = count(*))"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processing attempts: errors fail, signups stay unfinished, the rest succeeds."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") != "signup", "success")
    return e.select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("recording_id"), F.col("event_type").alias("stage"), order.alias("ordinal"), outcome.alias("outcome"), F.col("ts").alias("started_at"))


ATTEMPTS_SQL = """attempts AS (
  SELECT event_id AS attempt_id, user_id AS recording_id, event_type AS stage, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ordinal,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type <> 'signup' THEN 'success' END AS outcome, ts AS started_at
  FROM events)"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings with their customer's name as title and priority as tag."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "O", "ready_to_transcribe").when(F.col("o_orderstatus") == "F", "transcribed").otherwise("needs_review")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.col("o_orderkey").alias("recording_id"), F.col("o_orderdate").cast("timestamp").alias("recorded_at"), status.alias("processing_status"),
        F.col("o_orderpriority").alias("tag"), F.col("c_name").alias("title"), F.col("o_totalprice").alias("size"),
    )


RECORDINGS_SQL = """recordings AS (
  SELECT o_orderkey AS recording_id, CAST(o_orderdate AS TIMESTAMP) AS recorded_at,
    CASE o_orderstatus WHEN 'O' THEN 'ready_to_transcribe' WHEN 'F' THEN 'transcribed' ELSE 'needs_review' END AS processing_status,
    o_orderpriority AS tag, c_name AS title, o_totalprice AS size
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
