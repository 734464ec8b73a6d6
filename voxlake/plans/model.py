"""The library's model tables on the driver's tables: one SQL text each, which Spark and DuckDB both read.

Orders are recordings, an order's line numbers (slots) are its sources, sections, summaries and tags.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voxlake.plans.fixtures import read

_AT = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)"

MODEL = {
    "slots": "SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey, max(l_suppkey) AS suppkey, CAST(min(l_shipdate) AS TIMESTAMP) AS shipped, max(l_returnflag) AS flag FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "m_recordings": """SELECT o_orderkey AS recording_id, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS recorded_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY AS discovered_at,
        CASE WHEN o_orderkey % 23 = 1 THEN 'failed' WHEN o_orderstatus = 'O' THEN 'ready_to_transcribe' WHEN o_orderstatus = 'F' THEN 'transcribed' ELSE 'needs_review' END AS processing_status,
        CASE WHEN o_orderstatus <> 'F' THEN 'not_ready' WHEN o_custkey % 4 = 0 THEN 'missing' WHEN o_custkey % 4 = 1 THEN 'failed' ELSE 'current' END AS summary_status,
        CASE WHEN o_custkey % 5 = 0 THEN 'missing' ELSE 'present' END AS audio_status, o_orderkey % 13 = 0 AS retranscription_failed, o_orderkey % 17 = 0 AS resummarization_failed,
        CASE WHEN o_orderkey % 23 = 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 'routing' ELSE 'transcription' END END AS failure_stage,
        CASE WHEN o_orderkey % 19 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '9' DAY END AS archived_at, CASE WHEN o_custkey % 3 = 0 THEN 'zh-Hant' ELSE 'en' END AS default_language,
        CASE WHEN o_orderkey % 10 <> 0 THEN concat('h', CAST(o_orderkey AS STRING)) END AS sha256 FROM {orders}""",
    "m_sources": """SELECT l_orderkey * 10 + l_linenumber AS source_id, l_orderkey AS recording_id,
        CASE WHEN l_linenumber = 2 THEN '  ' WHEN l_linenumber = 5 THEN '' WHEN partkey % 5 = 0 THEN 'same.wav' ELSE concat(' file ', CAST(partkey % 40 AS STRING), '.wav') END AS original_filename,
        concat(CASE WHEN suppkey % 9 = 0 THEN '/out/' ELSE '/in/' END, CASE WHEN partkey % 3 = 0 THEN 'folder/' ELSE '' END, CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '.wav') AS path,
        shipped AS first_seen_at, l_linenumber = 1 + l_orderkey % 3 AS is_canonical, CASE WHEN flag = 'R' THEN 'missing' ELSE 'present' END AS presence, partkey AS file_size, CAST(suppkey AS DOUBLE) AS file_mtime FROM {slots}""",
    "m_listing": """SELECT CASE WHEN source_id % 10 = 7 THEN concat('/in/new-', CAST(source_id AS STRING)) ELSE path END AS path, file_size + CASE WHEN source_id % 6 = 0 THEN 1 ELSE 0 END AS file_size, file_mtime,
        CASE WHEN source_id % 11 = 0 THEN 'other' ELSE concat('h', CAST(recording_id AS STRING)) END AS sha256 FROM {m_sources} WHERE source_id % 8 <> 0""",
    "m_transcripts": "SELECT o_orderkey AS transcript_id, o_orderkey AS recording_id, o_orderkey % 9 <> 0 AS is_active FROM {orders}",
    "m_sections": f"""SELECT l_orderkey * 10 + l_linenumber AS section_id, l_orderkey AS transcript_id, l_orderkey AS recording_id, CAST({_AT} AS INT) AS ordinal, concat('Part ', CAST(l_linenumber AS STRING)) AS title,
        CAST(({_AT} - 1) * 3 + CASE WHEN l_orderkey % 15 = 6 AND {_AT} = 2 THEN 1 ELSE 0 END AS INT) AS start_ordinal, CAST({_AT} * 3 AS INT) AS end_ordinal,
        CASE WHEN partkey % 10 = 0 THEN shipped END AS archived_at, false AS title_is_temporary FROM {{slots}} WHERE l_orderkey % 3 = 0""",
    "m_layouts": """SELECT transcript_id, 1 AS revision, transcript_id % 27 <> 3 AS is_active, transcript_id % 9 <> 0 AS transcript_active, 0 AS start_ordinal, max(end_ordinal) AS end_ordinal, CAST(max(end_ordinal) AS BIGINT) AS n
        FROM {m_sections} GROUP BY transcript_id""",
    "m_valid": "SELECT transcript_id FROM {m_sections} GROUP BY transcript_id HAVING count(*) >= 2 AND transcript_id % 15 <> 6 AND transcript_id % 27 <> 3 AND transcript_id % 9 <> 0",
    "m_summaries": """SELECT l_orderkey * 10 + l_linenumber AS summary_id, l_orderkey AS recording_id, l_orderkey AS transcript_id, CASE WHEN l_linenumber > 2 THEN l_orderkey * 10 + l_linenumber END AS section_id, l_linenumber AS ordinal,
        CASE WHEN suppkey % 2 = 0 THEN 'en' ELSE 'zh-Hant' END AS output_language, CASE WHEN partkey % 7 = 0 THEN '' ELSE concat('Sum ', CAST(partkey AS STRING)) END AS title, suppkey % 4 <> 0 AS is_active,
        l_orderkey % 9 <> 0 AS transcript_active, CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END AS section_ordinal, shipped AS activated_at FROM {slots} WHERE l_linenumber <= 4""",
    "m_tags": """SELECT l_orderkey AS recording_id, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey * 10 + l_linenumber END AS section_id, concat('Tag ', CAST(partkey % 6 AS STRING)) AS name, concat('tag ', CAST(partkey % 6 AS STRING)) AS name_key,
        flag <> 'R' AS is_active FROM {slots}""",
    "m_states": "SELECT section_id, 'en' AS output_language, CASE section_id % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'current' ELSE 'failed' END AS state FROM {m_sections} WHERE section_id % 5 <> 0",
    "m_routes": "SELECT o_orderkey AS recording_id, o_custkey % 2 = 0 AS is_active, o_custkey % 3 = 0 AS routing_verified FROM {orders} WHERE o_orderkey % 2 = 0",
    "m_durations": "SELECT section_id, CAST((end_ordinal - start_ordinal) * 1.5 AS DOUBLE) AS duration FROM {m_sections}",
    "m_attempts": """SELECT event_id AS attempt_id, user_id AS recording_id, event_type AS stage, ts AS started_at, CASE WHEN event_type = 'error' THEN concat('e', CAST(event_id % 7 AS STRING)) ELSE '' END AS error_code,
        CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type <> 'signup' THEN 'success' END AS outcome FROM {events}""",
}


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table, or a driver table of that name."""
    if name not in MODEL:
        return read(spark, sf_dir, name)
    needs = set(re.findall(r"\{(\w+)\}", MODEL[name]))
    return spark.sql(MODEL[name], **{n: model(spark, sf_dir, n) for n in needs})


def ctes(*names: str) -> str:
    """The model tables, and those that they need, as DuckDB common table expressions."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in MODEL and name not in done:
            for n in re.findall(r"\{(\w+)\}", MODEL[name]):
                add(n)
            done[name] = re.sub(r"\{(\w+)\}", r"\1", MODEL[name])

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({sql})" for n, sql in done.items())
