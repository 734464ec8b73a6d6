"""Further registered queries, on the model tables: sources, titles, filters, listing, versions, routing, summaries, search inside a listing, streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import text as T
from voxlake.operators import documents as D
from voxlake.operators import items as N
from voxlake.operators import library as L
from voxlake.operators import routing as R
from voxlake.operators import search as S
from voxlake.operators import summaries as M
from voxlake.operators import vectors as V
from voxlake.operators.scans import kept
from voxlake.plans import fixtures as X
from voxlake.plans.model import ctes, model
from voxlake.plans.registry import COSINE_SQL, DOCS_SQL, QUERIES, QUERY, SCORED_SQL, _queries, _vectors, query, rid, search_documents
from voxlake.sources import ingest as I  # noqa: E741
from voxlake.sources import versions as G
from voxlake.streaming import jobs as J
from voxlake.streaming.changelog import IndexLog, no_faults

# ---- sources -------------------------------------------------------------------------------------


@query(f"""WITH {ctes('m_sources', 'm_listing')}
SELECT coalesce(k.path, n.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'missing' WHEN k.file_size <> n.file_size OR k.file_mtime <> n.file_mtime THEN 'changed'
  WHEN k.presence = 'missing' THEN 'reappeared' ELSE 'unchanged' END AS change, CASE WHEN n.path IS NULL THEN 'missing' ELSE 'present' END AS presence,
  k.path IS NOT NULL AND n.path IS NOT NULL AND (k.file_size <> n.file_size OR k.file_mtime <> n.file_mtime) AS detached FROM m_sources k FULL JOIN m_listing n ON k.path = n.path""")
def source_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reconcile_listing(model(spark, sf_dir, "m_sources"), model(spark, sf_dir, "m_listing"))


@query(f"""WITH {ctes('m_sources')}
SELECT recording_id, arg_min(source_id, (length(path), first_seen_at, source_id)) FILTER (presence = 'present') AS canonical_id, count(*) FILTER (presence = 'present') AS n_present,
  CASE WHEN bool_or(presence = 'present') THEN 'present' ELSE 'missing' END AS audio_status FROM m_sources GROUP BY 1""")
def source_choice(spark, sf_dir):
    return G.canonical_sources(model(spark, sf_dir, "m_sources"))


@query(f"""WITH {ctes('m_sources', 'm_listing', 'm_recordings')}, tried AS (
  SELECT s.recording_id, s.source_id, (CASE WHEN is_canonical THEN 0 ELSE 1 END, first_seen_at, s.source_id) AS pos,
    CASE WHEN s.path NOT LIKE '/in/%' THEN 'outside_inbox' WHEN f.path IS NULL THEN 'missing'
      WHEN f.file_size = s.file_size AND f.file_mtime = s.file_mtime AND (r.sha256 IS NULL OR r.sha256 = f.sha256) THEN 'valid' ELSE 'changed' END AS outcome
  FROM m_sources s JOIN m_recordings r USING (recording_id) LEFT JOIN m_listing f ON f.path = s.path WHERE s.presence = 'present'),
g AS (SELECT recording_id, arg_min(source_id, pos) FILTER (outcome = 'valid') AS source_id, arg_max(outcome, pos) AS last FROM tried GROUP BY 1)
SELECT r.recording_id, g.source_id, CASE WHEN g.source_id IS NOT NULL THEN 'valid' ELSE coalesce(g.last, 'no_source') END AS outcome FROM m_recordings r LEFT JOIN g USING (recording_id)""")
def source_validation(spark, sf_dir):
    return G.validate_sources(model(spark, sf_dir, "m_recordings"), model(spark, sf_dir, "m_sources"), model(spark, sf_dir, "m_listing"), "/in/")


@query(f"""WITH {ctes('m_sources')}, n AS (SELECT recording_id, trim(original_filename) AS name, (CASE WHEN is_canonical THEN 0 ELSE 1 END, first_seen_at, source_id) AS pos FROM m_sources),
f AS (SELECT recording_id, name, min(pos) AS pos FROM n WHERE name <> '' GROUP BY 1, 2)
SELECT recording_id, list(name ORDER BY pos) AS filenames FROM f GROUP BY 1""")
def source_filenames(spark, sf_dir):
    return N.filename_list(model(spark, sf_dir, "m_sources"))


TAG_ENTRIES = "SELECT CASE WHEN c_custkey % 50 = 0 THEN '  ' WHEN c_custkey % 3 = 0 THEN concat(' Tag ', CAST(c_custkey % 1000 AS STRING)) ELSE c_name END AS name, c_mktsegment AS description FROM {customer}"


@query(f"""WITH e AS (SELECT trim(name) AS name, lower(trim(name)) AS name_key FROM ({TAG_ENTRIES.replace('{customer}', 'customer')})), n AS (SELECT *, count(*) OVER (PARTITION BY name_key) AS n FROM e)
SELECT name_key, name, CASE WHEN name = '' THEN 'blank_name' WHEN n > 1 THEN 'duplicate_key' ELSE 'ok' END AS fault FROM n""")
def tag_entries(spark, sf_dir):
    good, bad = G.tag_table(spark.sql(TAG_ENTRIES, customer=X.read(spark, sf_dir, "customer")))
    return good.select("name_key", "name", F.lit("ok").alias("fault")).unionByName(bad)


@query(f"""WITH {ctes('m_summaries')}, w AS (SELECT summary_id, lead(activated_at) OVER s AS superseded_at, lead(summary_id) OVER s IS NULL AS is_active FROM m_summaries
  WINDOW s AS (PARTITION BY transcript_id, section_id, output_language ORDER BY activated_at, summary_id)) SELECT * FROM w""")
def summary_versions(spark, sf_dir):
    """Half of the summaries are there, the others are written: one stays active for each transcript, section and language."""
    s = model(spark, sf_dir, "m_summaries").select(F.col("summary_id").alias("version_id"), "transcript_id", "section_id", "output_language", "activated_at")
    out = G.append_versions(s.filter("version_id % 2 = 0"), s.filter("version_id % 2 = 1"), ["transcript_id", "section_id", "output_language"])
    return out.select(F.col("version_id").alias("summary_id"), "superseded_at", "is_active")


@query("""WITH v AS (SELECT conv_id AS version_id, conv_id // 2 AS recording_id FROM conversations GROUP BY 1), w AS (SELECT *, lead(version_id) OVER (PARTITION BY recording_id ORDER BY version_id) IS NULL AS is_active FROM v)
SELECT w.version_id, w.recording_id, w.is_active, min(c.turn * 1000) AS start_ms, max((c.turn + 1) * 1000) AS end_ms, count(*) AS segments FROM w JOIN conversations c ON c.conv_id = w.version_id GROUP BY 1, 2, 3""")
def transcript_versions(spark, sf_dir):
    """Two conversations are versions of one recording's transcript."""
    v = X.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("version_id"), F.floor(F.col("conv_id") / 2).alias("recording_id"), F.timestamp_seconds("conv_id").alias("activated_at")).distinct()
    none = v.filter("false")
    rows, sections, _ = G.transcript_versions(none, v, X.segments(spark, sf_dir))
    return rows.join(sections, "version_id").select("version_id", "recording_id", "is_active", "start_ms", "end_ms", "segments")


@query("""SELECT conv_id AS file_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ordinal, 0 AS word_no, CAST(turn * 1000 AS BIGINT) AS start_ms, CAST(turn * 1000 + 10 AS BIGINT) AS end_ms, role AS text FROM conversations
UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT), 1, CAST(turn * 1000 + 10 AS BIGINT), CAST(turn * 1000 + 999 AS BIGINT), text FROM conversations""")
def transcript_words(spark, sf_dir):
    """Conversations as transcript files whose segments have two words: the role and the whole text."""
    t = F.col("turn") * 1000
    words = F.array(F.struct(t.cast("double").alias("start"), (t + 10).cast("double").alias("end"), F.col("role").alias("text")), F.struct((t + 10).cast("double").alias("start"), (t + 999).cast("double").alias("end"), F.col("text")))
    c = X.read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", words.alias("words")))), lambda x: F.struct(x.words.alias("words"))).alias("segments"))
    return I.parse_words(c.select("file_id", F.to_json(F.struct("segments")).alias("raw")))


# ---- titles, filters, listing --------------------------------------------------------------------

TITLES_SQL = f"""{ctes('m_recordings', 'm_summaries', 'm_sources', 'm_tags', 'm_sections', 'm_valid', 'm_states', 'm_routes', 'm_durations')},
best AS (SELECT s.recording_id, arg_min(s.title, (CASE WHEN s.output_language = r.default_language THEN 0 ELSE 1 END, ordinal, s.title)) AS t FROM m_summaries s JOIN m_recordings r USING (recording_id)
  WHERE s.title <> '' AND s.is_active AND s.transcript_active AND s.section_id IS NULL GROUP BY 1),
named AS (SELECT recording_id, arg_min(original_filename, (CASE WHEN is_canonical THEN 0 ELSE 1 END, first_seen_at, source_id)) AS f FROM m_sources WHERE original_filename <> '' GROUP BY 1),
titles AS (SELECT recording_id, coalesce(t, f, 'Untitled recording') AS title FROM m_recordings LEFT JOIN best USING (recording_id) LEFT JOIN named USING (recording_id)),
rec AS (SELECT r.*, titles.title, coalesce(recorded_at, discovered_at) AS effective_at, EXISTS (SELECT 1 FROM m_routes x WHERE x.recording_id = r.recording_id AND x.is_active AND NOT x.routing_verified) AS route_unverified,
  EXISTS (SELECT 1 FROM m_summaries x WHERE x.recording_id = r.recording_id AND x.is_active AND x.transcript_active AND x.section_id IS NULL) AS has_summary FROM m_recordings r JOIN titles USING (recording_id)),
sectitle AS (SELECT s.section_id, arg_min(s.title, ordinal) AS t FROM m_summaries s JOIN m_recordings r USING (recording_id) WHERE s.is_active AND s.section_id IS NOT NULL AND s.output_language = r.default_language GROUP BY 1),
sec AS (SELECT s.section_id, s.recording_id, s.archived_at, r.archived_at AS recording_archived_at, coalesce(q.t, s.title) AS title, q.t IS NOT NULL AS has_summary, st.state AS summary_status, d.duration, s.start_ordinal, s.end_ordinal, r.effective_at,
    r.default_language, r.processing_status, r.audio_status, r.retranscription_failed, r.resummarization_failed, r.route_unverified, r.recorded_at
  FROM m_sections s JOIN m_valid v ON v.transcript_id = s.transcript_id JOIN rec r ON r.recording_id = s.recording_id LEFT JOIN sectitle q ON q.section_id = s.section_id
  LEFT JOIN m_states st ON st.section_id = s.section_id AND st.output_language = r.default_language LEFT JOIN m_durations d ON d.section_id = s.section_id),
live_rec AS (SELECT * FROM rec WHERE archived_at IS NULL AND recording_id NOT IN (SELECT transcript_id FROM m_valid)), live_sec AS (SELECT * FROM sec WHERE archived_at IS NULL AND recording_archived_at IS NULL)"""


def _titles(spark, sf_dir):
    s = model(spark, sf_dir, "m_summaries").filter("is_active and transcript_active and section_id is null")
    return N.display_titles(model(spark, sf_dir, "m_recordings"), s, model(spark, sf_dir, "m_sources"))


def _recording_rows(spark, sf_dir):
    s = model(spark, sf_dir, "m_summaries").filter(N.summary_is_current()).select("recording_id").distinct().withColumn("has_summary", F.lit(True))
    r = model(spark, sf_dir, "m_recordings").join(s, "recording_id", "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))
    return N.recording_rows(r, _titles(spark, sf_dir), model(spark, sf_dir, "m_routes"))


def _valid(spark, sf_dir):
    lay, sec = model(spark, sf_dir, "m_layouts"), model(spark, sf_dir, "m_sections")
    return L.valid_layouts(lay, sec).filter("valid").select("transcript_id"), sec


def _section_rows(spark, sf_dir, rows):
    valid, sec = _valid(spark, sf_dir)
    s = model(spark, sf_dir, "m_summaries").filter("is_active and section_id is not null")
    return N.section_rows(sec.join(valid, "transcript_id", "left_semi"), rows, s, model(spark, sf_dir, "m_states"), model(spark, sf_dir, "m_durations"))


def _branches(spark, sf_dir, f: N.Filters, zone: str = "UTC"):
    """The recording branch without split recordings, and the section branch, both filtered."""
    rows, tags = _recording_rows(spark, sf_dir), model(spark, sf_dir, "m_tags")
    hidden = _valid(spark, sf_dir)[0].withColumnRenamed("transcript_id", "recording_id")
    whole = N.filter_recordings(rows.join(hidden, "recording_id", "left_anti"), f, tags, zone)
    return whole, N.filter_sections(_section_rows(spark, sf_dir, rows), f, tags, zone)


@query(f"WITH {TITLES_SQL} SELECT recording_id, title FROM titles")
def item_titles(spark, sf_dir):
    return _titles(spark, sf_dir)


@query(f"WITH {TITLES_SQL} SELECT o_orderkey * 2 AS recording_id, coalesce(title, '') AS title FROM orders LEFT JOIN titles ON titles.recording_id = o_orderkey * 2")
def title_lookup(spark, sf_dir):
    keys = X.read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("recording_id"))
    return N.lookup_titles(keys, _titles(spark, sf_dir))


@query(f"""WITH {TITLES_SQL}, t AS (SELECT recording_id FROM m_tags WHERE is_active AND section_id IS NULL AND name_key IN ('tag 1', 'tag 2') GROUP BY 1)
SELECT recording_id, effective_at, title FROM rec WHERE archived_at IS NULL AND effective_at >= TIMESTAMP '1995-06-14 21:00:00' AND effective_at < TIMESTAMP '1998-01-15 22:00:00' AND audio_status = 'present' AND has_summary
  AND (processing_status IN ('needs_review', 'failed') OR retranscription_failed OR resummarization_failed OR summary_status = 'failed') AND recording_id IN (SELECT recording_id FROM t)""")
def recording_filter(spark, sf_dir):
    f = N.Filters(date_from="1995-06-15", date_to="1998-01-15", tags=("tag 1", "tag 2"), tag_match="any", review=True, audio="present", has_summary=True)
    return N.filter_recordings(_recording_rows(spark, sf_dir), f, model(spark, sf_dir, "m_tags"), "Europe/Helsinki").select("recording_id", "effective_at", "title")


@query(f"""WITH {TITLES_SQL} SELECT section_id, title, duration FROM sec WHERE archived_at IS NULL AND recording_archived_at IS NULL AND coalesce(summary_status, 'missing') = 'missing' AND NOT has_summary
  AND section_id IN (SELECT section_id FROM m_tags WHERE is_active AND section_id IS NOT NULL AND name_key = 'tag 3')""")
def section_filter(spark, sf_dir):
    f = N.Filters(summary="missing", has_summary=False, tags=("tag 3",))
    rows = _section_rows(spark, sf_dir, _recording_rows(spark, sf_dir))
    return N.filter_sections(rows, f, model(spark, sf_dir, "m_tags")).select("section_id", "title", "duration")


ITEMS_SQL = f"""{TITLES_SQL}, items AS (
  SELECT 'r:' || recording_id AS item_key, 'recording' AS item_kind, recording_id, CAST(NULL AS BIGINT) AS section_id, title, lower(title) AS title_fold, effective_at, default_language, processing_status, summary_status, audio_status,
    retranscription_failed, resummarization_failed, route_unverified, recorded_at, CAST(NULL AS INT) AS range_start, CAST(NULL AS INT) AS range_end, CAST(NULL AS DOUBLE) AS duration FROM live_rec
  UNION ALL SELECT 's:' || section_id, 'section', recording_id, section_id, title, lower(title), effective_at, default_language, processing_status, summary_status, audio_status, retranscription_failed, resummarization_failed, route_unverified,
    recorded_at, start_ordinal, end_ordinal, duration FROM live_sec)"""


def _items(spark, sf_dir, f: N.Filters = N.Filters()):
    whole, parts = _branches(spark, sf_dir, f)
    return N.item_listing(whole.withColumn("duration", F.lit(None).cast("double")), parts)


@query(f"WITH {ITEMS_SQL} SELECT * FROM items")
def item_listing(spark, sf_dir):
    return _items(spark, sf_dir)


@query(f"WITH {ITEMS_SQL} SELECT substr(item_key, 1, 1) AS kind, count(*) AS n FROM items WHERE audio_status = 'present' GROUP BY 1")
def item_count(spark, sf_dir):
    return N.item_keys(*_branches(spark, sf_dir, N.Filters(audio="present"))).groupBy(F.substring("item_key", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


PAGE_SQL = f"""{ITEMS_SQL}, n AS (SELECT count(*) AS n FROM items), placed AS (SELECT *, row_number() OVER (ORDER BY title_fold, item_key) AS place FROM items),
paged AS (SELECT placed.*, CAST(CAST(ceil(n / 25.0) AS BIGINT) AS INT) AS pages FROM placed, n WHERE (place - 1) // 25 = (n - 1) // 25)"""


@query(f"WITH {PAGE_SQL} SELECT item_key, title, effective_at, pages AS page, pages FROM paged")
def item_page(spark, sf_dir):
    """The last page by title: the number asked for lies beyond it."""
    whole, parts = _branches(spark, sf_dir, N.Filters())
    items = N.item_listing(whole.withColumn("duration", F.lit(None).cast("double")), parts)
    return N.item_page(items, N.item_keys(whole, parts), "title_az", 10**6).select("item_key", "title", "effective_at", "page", "pages")


@query(f"""WITH {PAGE_SQL}, langs AS (SELECT p.item_key, list_sort(list(DISTINCT s.output_language)) AS languages FROM paged p JOIN m_summaries s ON s.recording_id = p.recording_id AND s.section_id IS NOT DISTINCT FROM p.section_id WHERE s.is_active GROUP BY 1),
tagged AS (SELECT item_key, list(name ORDER BY name_key, name) AS tags FROM (SELECT DISTINCT p.item_key, t.name, t.name_key FROM paged p JOIN m_tags t ON t.recording_id = p.recording_id AND t.section_id IS NOT DISTINCT FROM p.section_id WHERE t.is_active) GROUP BY 1),
firsts AS (SELECT recording_id, trim(original_filename) AS name, min((CASE WHEN is_canonical THEN 0 ELSE 1 END, first_seen_at, source_id)) AS pos FROM m_sources WHERE trim(original_filename) <> '' GROUP BY 1, 2),
files AS (SELECT recording_id, list(name ORDER BY pos) AS filenames FROM firsts GROUP BY 1)
SELECT p.item_key, CAST(p.place - (SELECT min(place) FROM paged) + 1 AS INT) AS place, coalesce(languages, []) AS languages, coalesce(tags, []) AS tags, coalesce(filenames, []) AS filenames
FROM paged p LEFT JOIN langs USING (item_key) LEFT JOIN tagged USING (item_key) LEFT JOIN files ON files.recording_id = p.recording_id""")
def item_cards(spark, sf_dir):
    whole, parts = _branches(spark, sf_dir, N.Filters())
    items = N.item_listing(whole.withColumn("duration", F.lit(None).cast("double")), parts)
    page = N.item_page(items, N.item_keys(whole, parts), "title_az", 10**6)
    placed = page.withColumn("place", F.row_number().over(N.Window.orderBy("title_fold", "item_key")))  # over one page
    with J.clearing(spark):
        placed = kept(placed.select("item_key", "recording_id", "section_id", "place"), "page")
    return N.cards(placed, model(spark, sf_dir, "m_summaries"), model(spark, sf_dir, "m_tags"), model(spark, sf_dir, "m_sources"))


@query(f"""WITH {ctes('m_recordings', 'm_valid')}, r AS (SELECT * FROM m_recordings WHERE archived_at IS NULL)
SELECT recording_id, 'needs_review_before_transcription' AS kind FROM r WHERE processing_status = 'needs_review' UNION ALL SELECT recording_id, 'failed_retranscription' FROM r WHERE processing_status = 'transcribed' AND retranscription_failed
UNION ALL SELECT recording_id, 'failed_' || failure_stage FROM r WHERE processing_status = 'failed' UNION ALL SELECT recording_id, 'awaiting_summary' FROM r WHERE processing_status = 'transcribed' AND summary_status = 'missing' AND recording_id NOT IN (SELECT transcript_id FROM m_valid)
UNION ALL SELECT recording_id, 'failed_summary' FROM r WHERE summary_status = 'failed' UNION ALL SELECT recording_id, 'failed_resummarization' FROM r WHERE resummarization_failed UNION ALL SELECT recording_id, 'missing_audio' FROM r WHERE audio_status = 'missing'""")
def review_kinds(spark, sf_dir):
    return L.review_kinds(model(spark, sf_dir, "m_recordings"), _split_recordings(spark, sf_dir))


@query(f"""WITH {ctes('m_recordings', 'm_valid')}
SELECT count(*) AS badge FROM m_recordings WHERE archived_at IS NULL AND (processing_status IN ('needs_review', 'failed') OR retranscription_failed OR resummarization_failed OR summary_status = 'failed' OR audio_status = 'missing'
  OR (processing_status = 'transcribed' AND summary_status = 'missing' AND recording_id NOT IN (SELECT transcript_id FROM m_valid)))""")
def review_badge(spark, sf_dir):
    return L.review_badge(model(spark, sf_dir, "m_recordings"), _split_recordings(spark, sf_dir))


def _split_recordings(spark, sf_dir) -> DataFrame:
    """Recordings whose sections stand in their place."""
    return model(spark, sf_dir, "m_valid").select(F.col("transcript_id").alias("recording_id"))


STATUSES = ("discovered", "routing", "ready_to_transcribe", "transcribed", "needs_review", "failed")


@query(f"""WITH {ctes('m_recordings', 'm_attempts')}, known AS (SELECT unnest({list(STATUSES)}) AS s),
e AS (SELECT stage || '/' || error_code AS name FROM m_attempts WHERE error_code <> '' ORDER BY started_at DESC, attempt_id DESC LIMIT 20)
SELECT 'status' AS section, s AS name, count(recording_id) AS n FROM known LEFT JOIN m_recordings ON processing_status = s GROUP BY s
UNION ALL SELECT 'summary', 'awaiting_summary', count(*) FROM m_recordings WHERE processing_status = 'transcribed' AND summary_status = 'missing' UNION ALL SELECT 'summary', 'summary_failed', count(*) FROM m_recordings WHERE summary_status = 'failed'
UNION ALL SELECT 'summary', 'summarized', count(*) FROM m_recordings WHERE processing_status = 'transcribed' AND summary_status = 'current' AND NOT resummarization_failed
UNION ALL SELECT 'summary', 'failed_resummarization', count(*) FROM m_recordings WHERE resummarization_failed
UNION ALL SELECT 'summary', 'failed_retranscriptions', count(*) FROM m_recordings WHERE processing_status = 'transcribed' AND retranscription_failed
UNION ALL SELECT 'failure', failure_stage, count(*) FROM m_recordings WHERE processing_status = 'failed' GROUP BY 2 UNION ALL SELECT 'recent_error', name, count(*) FROM e GROUP BY 2""")
def status_report(spark, sf_dir):
    return L.status_report(model(spark, sf_dir, "m_recordings"), model(spark, sf_dir, "m_attempts"), STATUSES)


@query(f"""WITH {ctes('m_recordings', 'm_attempts')} SELECT r.recording_id, CASE WHEN r.archived_at IS NOT NULL THEN 'unchanged' WHEN r.recording_id IN (SELECT recording_id FROM m_attempts WHERE outcome IS NULL) THEN 'refused' ELSE 'archived' END AS result
FROM m_recordings r WHERE r.recording_id IN (SELECT user_id FROM events)""")
def archive_requests(spark, sf_dir):
    asked = model(spark, sf_dir, "m_attempts").select("recording_id").distinct()
    return N.archive_requests(asked, model(spark, sf_dir, "m_recordings"), model(spark, sf_dir, "m_attempts"))


@query(f"""WITH {ctes('m_recordings')}, r AS (SELECT * FROM m_recordings WHERE archived_at IS NULL)
SELECT 'transcribe' AS stage, recording_id FROM r WHERE processing_status = 'ready_to_transcribe' UNION ALL SELECT 'summarise', recording_id FROM r WHERE processing_status = 'transcribed' AND summary_status = 'missing'""")
def eligible_for_stage(spark, sf_dir):
    r = model(spark, sf_dir, "m_recordings")
    one = lambda stage: L.eligible(r, stage).select(F.lit(stage).alias("stage"), "recording_id")
    return one("route").unionByName(one("transcribe")).unionByName(one("summarise"))


@query(f"""WITH {X.SECTIONS_SQL} SELECT s.transcript_id, CAST(s.n AS BIGINT) AS segment_count, (SELECT count(*) FROM sections k WHERE k.transcript_id = s.transcript_id) AS topic_count FROM stats s""")
def version_counts(spark, sf_dir):
    lay, sec = X.layouts(spark, sf_dir)
    return L.version_counts(lay, sec, X.segments(spark, sf_dir))


VARIANT_SQL = f"""{X.ATTEMPTS_SQL}, a AS (SELECT recording_id, recording_id % 7 AS transcript_id, ordinal % 3 AS section_id, CASE WHEN ordinal % 2 = 0 THEN 'en' ELSE 'fi' END AS language, CASE WHEN stage = 'view' THEN 'detection' ELSE 'summarization' END AS stage, ordinal,
  CASE WHEN outcome = 'failed' OR ordinal % 7 = 0 THEN 'failed' ELSE outcome END AS outcome, outcome IS NOT NULL AS finished FROM attempts),
k AS (SELECT recording_id, transcript_id, section_id, language, max(ordinal) FILTER (outcome = 'success' AND ordinal % 11 = 0) AS s_at, max(ordinal) FILTER (outcome = 'failed' AND finished AND stage = 'summarization') AS f_at FROM a GROUP BY 1, 2, 3, 4),
v AS (SELECT recording_id, transcript_id, section_id, language, CASE WHEN s_at IS NOT NULL THEN 'current' WHEN f_at IS NOT NULL THEN 'failed' ELSE 'missing' END AS state, coalesce(s_at IS NOT NULL AND f_at > s_at, false) AS regeneration_failed, CASE WHEN s_at IS NULL OR f_at > s_at THEN f_at END AS failed_at FROM k)"""


def _variants(spark, sf_dir):
    o = F.col("ordinal")
    a = X.attempts(spark, sf_dir).select(
        "recording_id", (F.col("recording_id") % 7).alias("transcript_id"), (o % 3).alias("section_id"), F.when(o % 2 == 0, "en").otherwise("fi").alias("language"), F.when(F.col("stage") == "view", "detection").otherwise("summarization").alias("stage"),
        "ordinal", F.when((F.col("outcome") == "failed") | (o % 7 == 0), "failed").otherwise(F.col("outcome")).alias("outcome"), F.col("outcome").isNotNull().alias("finished"))
    return L.section_variant_states(a.select(*L.VARIANT).distinct(), a.filter("outcome = 'success' and ordinal % 11 = 0"), a)


@query(f"WITH {VARIANT_SQL} SELECT * FROM v")
def section_variants(spark, sf_dir):
    return _variants(spark, sf_dir)


@query(f"""WITH {VARIANT_SQL}, r AS (SELECT DISTINCT recording_id, CASE WHEN recording_id % 5 <> 0 THEN recording_id % 7 END AS transcript_id FROM a)
SELECT r.recording_id, CASE WHEN r.transcript_id IS NULL THEN 'not_ready' ELSE coalesce(v.state, 'missing') END AS summary_status, coalesce(v.regeneration_failed, false) AS resummarization_failed
FROM r LEFT JOIN v ON v.recording_id = r.recording_id AND v.transcript_id = r.transcript_id AND v.language = 'en' AND v.section_id = 0""")
def variant_rollup(spark, sf_dir):
    r = X.attempts(spark, sf_dir).select("recording_id", F.when(F.col("recording_id") % 5 != 0, F.col("recording_id") % 7).alias("transcript_id"), F.lit("en").alias("default_language")).distinct()
    return L.rolled_up(_variants(spark, sf_dir), r)


@query("""WITH c AS (SELECT lower(c_name) AS name_key, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), k AS (SELECT lower(c_name) AS name_key, upper(c_name) AS name, CASE WHEN c_custkey % 4 = 0 THEN 'custom' ELSE 'config' END AS origin FROM customer WHERE c_custkey % 7 <> 0)
SELECT name_key, CASE WHEN k.name IS NULL OR (k.origin = 'custom' AND c.name IS NOT NULL) THEN c.name ELSE k.name END AS name FROM c FULL JOIN k USING (name_key)""")
def tag_names(spark, sf_dir):
    c = X.read(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    conf = c.filter(i % 3 != 0).select(F.lower("c_name").alias("name_key"), F.col("c_name").alias("name"))
    return L.kept_names(conf, c.filter(i % 7 != 0).select(F.lower("c_name").alias("name_key"), F.upper("c_name").alias("name"), F.when(i % 4 == 0, "custom").otherwise("config").alias("origin")))


@query("""WITH i AS (SELECT c_custkey AS i, c_custkey % 3 <> 0 AS c, c_custkey % 7 <> 0 AS k, c_nationkey <> c_nationkey % 20 AS other FROM customer)
SELECT count(*) FILTER (c AND NOT k) AS created, count(*) FILTER (c AND k AND other) AS updated, count(*) FILTER (k AND NOT c AND i % 5 <> 0 AND i % 4 <> 0) AS retired, count(*) FILTER (c AND k AND i % 5 = 0) AS reactivated, count(*) FILTER (c AND k AND i % 4 = 0) AS promoted FROM i""")
def tag_sync_counts(spark, sf_dir):
    return L.tag_sync_counts(QUERIES["tag_sync"](spark, sf_dir))


@query(f"WITH {ctes('m_summaries')} SELECT summary_id, is_active AND transcript_active AND section_ordinal = 0 AS current FROM m_summaries")
def summary_currency(spark, sf_dir):
    return model(spark, sf_dir, "m_summaries").select("summary_id", N.summary_is_current().alias("current"))


@query("""SELECT doc_id, CASE WHEN lang IN ('zh', 'yue', 'cmn') THEN 'zh-Hant' ELSE 'en' END AS by_default, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN 'zh-Hant' ELSE lang END AS original, 'zh-Hant' AS fixed,
  doc_id % 7 > 1 AS is_identity FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'no tag' WHEN 1 THEN 'yue' ELSE lang END AS lang FROM documents)""")
def output_languages(spark, sf_dir):
    i = F.col("doc_id") % 7
    d = X.read(spark, sf_dir, "documents").select("doc_id", F.when(i == 0, "no tag").when(i == 1, "yue").otherwise(F.col("lang")).alias("observed")).withColumns({"verified_by": F.lit(None).cast("string"), "route": F.lit(None).cast("string")})
    return d.select("doc_id", L.resolve_output("default").alias("by_default"), L.resolve_output("original").alias("original"), L.resolve_output("zh-Hant").alias("fixed"), T.is_output_identity(F.col("observed")).alias("is_identity"))


# ---- splitting -----------------------------------------------------------------------------------


@query("""WITH s AS (SELECT conv_id AS transcript_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY 1)
SELECT transcript_id, CASE WHEN transcript_id % 5 = 1 THEN 'title_count_mismatch' WHEN transcript_id % 5 = 2 AND n > 2 THEN 'duplicate_split' WHEN transcript_id % 11 = 3 THEN 'transcript_not_active' WHEN n < 3 THEN 'split_at_endpoint'
  WHEN transcript_id % 5 = 3 THEN 'title_flag_forgery' WHEN transcript_id % 5 = 4 THEN 'invalid_title' END AS fault,
  CASE WHEN transcript_id % 5 = 0 AND transcript_id % 11 <> 3 AND n >= 3 THEN CASE WHEN transcript_id % 2 = 0 THEN 'unchanged' ELSE 'create' END END AS action,
  CASE WHEN transcript_id % 5 = 0 AND transcript_id % 11 <> 3 AND n >= 3 AND transcript_id % 2 = 1 THEN 4 END AS revision FROM s""")
def split_results(spark, sf_dir):
    """A request for each conversation to split it after its second turn; some ask for nothing new, some break a rule."""
    return _split(spark, sf_dir)[0]


@query("""WITH s AS (SELECT conv_id AS transcript_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY 1 HAVING conv_id % 10 = 5 AND conv_id % 11 <> 3 AND count(*) >= 3)
SELECT transcript_id, 4 AS revision, 1 AS ordinal, 0 AS start_ordinal, 2 AS end_ordinal, 'First' AS title, false AS title_is_temporary FROM s
UNION ALL SELECT transcript_id, 4, 2, 2, n, 'Segment 2 of 202401010000', true FROM s""")
def split_sections(spark, sf_dir):
    return _split(spark, sf_dir)[1]


def _split(spark, sf_dir):
    t = X.segments(spark, sf_dir).groupBy("transcript_id").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    i = F.col("transcript_id") % 5
    t = t.withColumns({"is_active": F.col("transcript_id") % 11 != 3, "archived_at": F.lit(None).cast("timestamp"), "started_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    splits = F.when((i == 2) & (F.col("n") > 2), F.array(F.lit(2), F.lit(2))).otherwise(F.array(F.least(F.lit(2), F.col("n").cast("int"))))
    titles = F.when((i == 2) & (F.col("n") > 2), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(i == 1, F.array(F.lit("First"))).when(i == 3, F.array(F.lit("First"), F.lit("Segment 2 of 2000"))).when(i == 4, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit("First"), F.lit("")))
    flags = F.transform(titles, lambda x, k: k == 1)
    asked = t.select("transcript_id", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), splits.alias("splits"), titles.alias("titles"), flags.alias("temporary"))
    even = t.filter("transcript_id % 2 = 0")
    now = even.select("transcript_id", F.lit(3).alias("revision"), F.lit(True).alias("is_active"), F.lit(0).alias("start_ordinal"), F.col("n").cast("int").alias("end_ordinal"))
    old = t.select("transcript_id", F.lit(3).alias("revision"), F.lit(False).alias("is_active"), F.lit(0).alias("start_ordinal"), F.lit(1).alias("end_ordinal"))
    one = even.select("transcript_id", F.lit(1).alias("ordinal"), F.lit(0).alias("start_ordinal"), F.lit(2).alias("end_ordinal"), F.lit("First").alias("title"), F.lit(False).alias("title_is_temporary"))
    two = even.select("transcript_id", F.lit(2).alias("ordinal"), F.lit(2).alias("start_ordinal"), F.col("n").cast("int").alias("end_ordinal"), F.lit("Segment 2 of 202401010000").alias("title"), F.lit(True).alias("title_is_temporary"))
    return N.plan_splits(asked, t, now.unionByName(old.join(even, "transcript_id", "left_anti")), one.unionByName(two))


# ---- routing, languages --------------------------------------------------------------------------


@query(f"""WITH {ctes('m_recordings', 'm_routes')}, d AS (SELECT r.recording_id, processing_status, failure_stage, archived_at, CASE WHEN x.is_active THEN CASE WHEN x.routing_verified THEN 'cantonese' ELSE 'european' END END AS route
  FROM m_recordings r LEFT JOIN m_routes x USING (recording_id)), q AS (SELECT *, CASE WHEN recording_id % 3 = 0 THEN 'cantonese' ELSE 'european' END AS wanted FROM d),
k AS (SELECT *, CASE WHEN archived_at IS NOT NULL THEN 'refused_archived' WHEN NOT (processing_status IN ('needs_review', 'ready_to_transcribe', 'transcribed') OR (processing_status = 'failed' AND failure_stage = 'routing')) THEN 'refused_status'
  WHEN route = wanted THEN 'confirmed' ELSE 'appended' END AS result FROM q)
SELECT recording_id, result, CASE WHEN result IN ('confirmed', 'appended') THEN wanted ELSE route END AS route, CASE WHEN result = 'appended' OR (result = 'confirmed' AND processing_status <> 'transcribed') THEN 'ready_to_transcribe' ELSE processing_status END AS status FROM k""")
def manual_routes(spark, sf_dir):
    r = model(spark, sf_dir, "m_recordings").join(model(spark, sf_dir, "m_routes"), "recording_id", "left")
    now = r.select("recording_id", "processing_status", "failure_stage", "archived_at", F.when(F.col("is_active"), F.when(F.col("routing_verified"), "cantonese").otherwise("european")).alias("route"))
    asked = now.select("recording_id", F.when(F.col("recording_id") % 3 == 0, "cantonese").otherwise("european").alias("route"))
    return R.manual_routes(now, asked)


@query("""WITH e AS (SELECT event_id, user_id AS recording_id, CASE WHEN event_type = 'purchase' THEN 'manual' ELSE 'automatic' END AS method, event_type AS route FROM events)
SELECT recording_id, arg_max(event_id, (CASE WHEN method = 'manual' THEN 1 ELSE 0 END, event_id)) AS ordinal, max(method) AS method FROM e GROUP BY 1""")
def effective_routes(spark, sf_dir):
    e = X.read(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "purchase", "manual").otherwise("automatic").alias("method"), F.col("event_type").alias("route"))
    return R.effective_routes(log).select("recording_id", "ordinal", "method")


@query("""SELECT doc_id AS transcript_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN n > 0 AND doc_id % 3 = 1 THEN lang END AS language, CASE WHEN doc_id % 3 = 0 THEN 'observed' WHEN n > 0 AND doc_id % 3 = 1 THEN 'detected' END AS provenance,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN n = 0 THEN 'no_text' WHEN doc_id % 3 = 2 THEN 'invalid_reply' END AS failure FROM (SELECT doc_id, lang, length(trim(text)) AS n FROM documents)""")
def language_detection(spark, sf_dir):
    """Two thirds of the documents have no observed language; a stub detector reads the first word of what it is given."""
    d = X.read(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 3 == 1, F.col("lang")).otherwise("no tag")
    rows = d.select(F.col("doc_id").alias("transcript_id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("observed"), F.when(F.length(F.trim("text")) > 0, F.concat_ws("|", said, "text")).otherwise("").alias("sample"))
    return M.detect_languages(rows, lambda texts: [t.split("|")[0] for t in texts])


# ---- summaries -----------------------------------------------------------------------------------


def _summary_rows(spark, sf_dir):
    """A summary row for each conversation: points are its turns, actions its user turns, people its roles."""
    s = X.segments(spark, sf_dir)
    points = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "speaker"))), lambda x: F.struct(x.speaker.alias("text"), (x.ordinal % 2 + 1).alias("level")))
    actions = F.transform(F.array_sort(F.collect_list(F.when(F.col("ordinal") % 3 == 1, F.struct("ordinal", "speaker")))), lambda x: F.struct(x.speaker.alias("text"), F.when(x.ordinal % 2 == 1, x.speaker).alias("owner"), F.when(x.ordinal > 3, "2024-05-01").alias("due_date")))
    g = s.groupBy("transcript_id").agg(points.alias("key_points"), actions.alias("action_items"), F.count("*").cast("string").alias("overview"), F.array_sort(F.collect_set("speaker")).alias("people"))
    none = F.array().cast("array<string>")
    return g.select("transcript_id", F.lit("T").alias("title"), "overview", "key_points", "action_items", "people", none.alias("organizations"), F.array(F.lit(" a "), F.lit("")).alias("topics"), F.array(F.lit("x"), F.lit("y")).alias("tags"))


ACTIONS_SQL = """a AS (SELECT conv_id AS transcript_id, string_agg('- ' || role || CASE WHEN turn % 2 = 1 OR turn > 3 THEN ' (' || concat_ws('; ', CASE WHEN turn % 2 = 1 THEN 'owner: ' || role END, CASE WHEN turn > 3 THEN 'due: 2024-05-01' END) || ')' ELSE '' END, chr(10) ORDER BY turn) AS actions,
  string_agg(role, chr(10) ORDER BY turn) AS action_texts FROM conversations WHERE turn % 3 = 1 GROUP BY 1),
p AS (SELECT conv_id AS transcript_id, CAST(count(*) AS VARCHAR) AS overview, string_agg(CASE WHEN turn % 2 = 0 THEN (turn // 2 + 1) || '. ' ELSE (turn // 2 + 1) || '.1 ' END || role, chr(10) ORDER BY turn) AS points, string_agg(role, chr(10) ORDER BY turn) AS texts,
  list_sort(list(DISTINCT role)) AS people FROM conversations GROUP BY 1)"""


@query(f"""WITH {ACTIONS_SQL} SELECT transcript_id, concat_ws(chr(10), overview, texts, action_texts) AS body, array_to_string(people, chr(10)) || chr(10) || 'a' || chr(10) || 'tag' AS aux FROM p LEFT JOIN a USING (transcript_id)""")
def summary_search_texts(spark, sf_dir):
    return _summary_rows(spark, sf_dir).select("transcript_id", M.summary_body().alias("body"), M.summary_aux(F.array(F.lit(" tag "))).alias("aux"))


@query(f"""WITH {ACTIONS_SQL}
SELECT transcript_id, '# T' || chr(10) || chr(10) || '## Overview' || chr(10) || chr(10) || overview || chr(10) || chr(10) || '## Key points' || chr(10) || points || chr(10) || chr(10) || '## Action items' || chr(10) || coalesce(actions, '- No action items identified.') || chr(10) || chr(10) || '## People' || chr(10) || '- ' || array_to_string(people, chr(10) || '- ')
    || chr(10) || chr(10) || '## Topics' || chr(10) || '-  a ' || chr(10) || '- ' || chr(10) || chr(10) || '## Tags' || chr(10) || chr(10) || 'x, y' || chr(10) AS markdown,
  'Title: T' || chr(10) || chr(10) || 'Overview: ' || overview || chr(10) || chr(10) || 'Key points:' || chr(10) || points || chr(10) || chr(10) || 'Action items:' || chr(10) || coalesce(actions, '- No action items identified.') || chr(10) || chr(10) || 'People:' || chr(10) || '- ' || array_to_string(people, chr(10) || '- ')
    || chr(10) || chr(10) || 'Topics:' || chr(10) || '-  a ' || chr(10) || '- ' || chr(10) || chr(10) || 'Tags: x, y' || chr(10) AS plain FROM p LEFT JOIN a USING (transcript_id)""")
def summary_exports(spark, sf_dir):
    return _summary_rows(spark, sf_dir).select("transcript_id", M.summary_markdown().alias("markdown"), M.summary_text().alias("plain"))


@query("SELECT conv_id AS transcript_id, 'T' AS title, CAST(count(*) AS INT) AS points FROM conversations GROUP BY 1")
def summary_json(spark, sf_dir):
    """Summaries as JSON, read back."""
    j = _summary_rows(spark, sf_dir).select("transcript_id", M.summary_json().alias("j"))
    return j.select("transcript_id", F.get_json_object("j", "$.title").alias("title"), F.json_array_length(F.get_json_object("j", "$.key_points")).alias("points"))


@query("SELECT conv_id AS transcript_id, CAST(sum(length(text)) AS BIGINT) AS characters, CASE WHEN sum(length(text)) > 2000 THEN 'too_long' ELSE 'ok' END AS status FROM conversations GROUP BY 1")
def transcript_sizes(spark, sf_dir):
    return M.transcript_sizes(X.segments(spark, sf_dir), 2000)


# ---- documents and search inside the library -----------------------------------------------------


def _conversation_layouts(spark, sf_dir):
    lay, sec = X.layouts(spark, sf_dir)
    valid = L.valid_layouts(lay, sec).filter("valid").select("transcript_id")
    return valid.withColumn("recording_id", X.recording_id(F.col("transcript_id"))), sec


LIB_SQL = f"""{X.SECTIONS_SQL},
built AS (
  SELECT 'segment:' || conv_id || ':' || turn AS document_key, 'segment' AS doc_type, CAST(NULL AS BIGINT) AS section_id FROM conversations WHERE conv_id % 7 <> 2 AND trim(text) <> ''
  UNION ALL SELECT 'recording:' || {rid('transcript_id')}, 'recording', NULL FROM stats
  UNION ALL SELECT 'summary:' || transcript_id, 'summary', NULL FROM stats WHERE transcript_id % 7 <> 2 AND transcript_id % 4 <> 0
  UNION ALL SELECT 'summary:p' || section_id, 'summary', section_id FROM sections WHERE transcript_id IN (SELECT transcript_id FROM valid) AND transcript_id % 7 <> 2 AND section_id % 3 <> 0)"""


def _built(spark, sf_dir):
    seg = X.segments(spark, sf_dir)
    valid, sec = _conversation_layouts(spark, sf_dir)
    t = seg.select("recording_id", "transcript_id", (F.col("transcript_id") % 7 != 2).alias("is_active")).distinct()
    title = lambda c: F.concat(F.lit("Talk "), c.cast("string"))
    common = ["summary_id", "recording_id", "transcript_id", "section_id", "is_active", "language", "title", "body", "aux"]
    whole = t.select(F.col("transcript_id").cast("string").alias("summary_id"), "recording_id", "transcript_id", F.lit(None).cast("long").alias("section_id"), (F.col("transcript_id") % 4 != 0).alias("is_active"), F.lit("en").alias("language"), title(F.col("transcript_id")).alias("title"), F.lit("the summary").alias("body"), F.lit("").alias("aux"))
    parts = sec.select(F.concat(F.lit("p"), F.col("section_id").cast("string")).alias("summary_id"), X.recording_id(F.col("transcript_id")).alias("recording_id"), "transcript_id", "section_id", (F.col("section_id") % 3 != 0).alias("is_active"), F.lit("en").alias("language"), F.col("title"), F.lit("the part").alias("body"), F.lit("").alias("aux"))
    sections = sec.join(valid.select("transcript_id"), "transcript_id", "left_semi").select("section_id")
    names = t.select("recording_id", F.array(title(F.col("transcript_id"))).alias("filenames"))
    titles = t.select("recording_id", title(F.col("transcript_id")).alias("title"))
    return D.build_documents(t, titles, names, t, seg, whole.select(*common).unionByName(parts.select(*common)), sections), valid, sec


@query(f"WITH {LIB_SQL} SELECT document_key, doc_type, section_id FROM built")
def build_documents(spark, sf_dir):
    return _built(spark, sf_dir)[0].select("document_key", "doc_type", "section_id")


@query(f"""WITH {LIB_SQL}, pos AS (SELECT b.*, CASE WHEN doc_type = 'segment' THEN CAST(split_part(document_key, ':', 2) AS BIGINT) WHEN doc_type = 'recording' THEN CAST(right(document_key, 12) AS BIGINT) WHEN section_id IS NULL THEN CAST(split_part(document_key, ':', 2) AS BIGINT) ELSE section_id // 1000 END AS conv,
  CASE WHEN doc_type = 'segment' THEN CAST(split_part(document_key, ':', 3) AS INT) END AS ord FROM built b)
SELECT document_key, CASE WHEN conv NOT IN (SELECT transcript_id FROM valid) THEN 'r:' || {rid('conv')} ELSE 's:' || coalesce(s.section_id, a.section_id) END AS item_key
FROM pos a LEFT JOIN sections s ON s.transcript_id = a.conv AND a.ord >= s.start_ordinal AND a.ord < s.end_ordinal AND a.conv IN (SELECT transcript_id FROM valid)""")
def document_items(spark, sf_dir):
    d, valid, sec = _built(spark, sf_dir)
    return D.document_items(d, valid, sec).select("document_key", "item_key")


@query(f"""WITH {LIB_SQL} SELECT document_key, CASE WHEN length(document_key) % 5 = 0 THEN 'orphan' WHEN doc_type = 'segment' AND length(document_key) % 5 = 1 THEN 'other_transcript_id' WHEN doc_type = 'summary' AND length(document_key) % 5 = 2 THEN 'other_output_language' END AS fault
FROM built WHERE length(document_key) % 5 = 0 OR (doc_type = 'segment' AND length(document_key) % 5 = 1) OR (doc_type = 'summary' AND length(document_key) % 5 = 2)""")
def provenance_faults(spark, sf_dir):
    """Stored documents against live data that lack some, and moved others to another transcript or language."""
    d = _built(spark, sf_dir)[0]
    k = F.length("document_key") % 5
    live = d.filter(k != 0).withColumn("transcript_id", F.when((k == 1) & (F.col("doc_type") == "segment"), F.col("transcript_id") + 1).otherwise(F.col("transcript_id")))
    return D.provenance_faults(d, live.withColumn("output_language", F.when((k == 2) & (F.col("doc_type") == "summary"), "fi").otherwise(F.col("output_language"))))


ITEM_SQL = f"""{X.SECTIONS_SQL}, {SCORED_SQL.format(docs=DOCS_SQL)}, owned AS (
  SELECT f.*, CASE WHEN v.transcript_id IS NULL THEN 'r:' || f.recording_id WHEN s.section_id IS NOT NULL THEN 's:' || s.section_id END AS item_key FROM scored f
  LEFT JOIN valid v ON f.recording_id = {rid('v.transcript_id')}
  LEFT JOIN sections s ON v.transcript_id = s.transcript_id AND f.doc_type = 'segment' AND f.segment_ordinal >= s.start_ordinal AND f.segment_ordinal < s.end_ordinal
  WHERE f.worst < 9),
item_best AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY worst, type, occurrences DESC, first, document_key) AS b FROM owned WHERE item_key IS NOT NULL),
item_ranked AS (SELECT item_key, document_key, CAST(worst AS INT) AS worst, occurrences, CAST(first AS INT) AS first, CAST(row_number() OVER (ORDER BY worst, type, occurrences DESC, first, document_key, item_key) AS INT) AS rank FROM item_best WHERE b = 1)"""


def _item_documents(spark, sf_dir):
    valid, sec = _conversation_layouts(spark, sf_dir)
    return D.document_items(S.folded(search_documents(spark, sf_dir)), valid, sec)


@query(f"WITH {ITEM_SQL} SELECT *, greatest((SELECT count(*) FROM item_ranked) - 50, 0) AS more, false AS truncated FROM item_ranked WHERE rank <= 50")
def item_search(spark, sf_dir):
    """Keyword search with one winner for each library item."""
    return S.search(_item_documents(spark, sf_dir), QUERY, unit="item_key")


@query(f"""WITH {ITEM_SQL}, scoped AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY worst, type, occurrences DESC, first, document_key) AS b2 FROM owned WHERE item_key IN (SELECT item_key FROM owned WHERE length(item_key) % 2 = 1)),
w AS (SELECT item_key, document_key, row_number() OVER (ORDER BY worst, type, occurrences DESC, first, document_key, item_key) AS rank FROM scoped WHERE b2 = 1), top AS (SELECT * FROM w WHERE rank <= 200)
SELECT item_key, document_key, CAST(rank AS INT) AS rank, CAST(row_number() OVER (ORDER BY item_key DESC) AS INT) AS place FROM top""")
def listing_search(spark, sf_dir):
    """A search inside a filtered listing, its winners in a library order. Texts are read where they lie: matches and items go on without them."""
    valid, sec = _conversation_layouts(spark, sf_dir)
    place = ("recording_id", "transcript_id", "segment_ordinal", "section_id")
    d = search_documents(spark, sf_dir)
    matches = kept(S.keyword_matches(S.folded(d), QUERY, carry=place[1:]), "matches")
    items = D.document_items(d.select(*place).distinct(), valid, sec).select("item_key").filter(F.length("item_key") % 2 == 1).distinct()
    items = kept(items, "items")
    won = S.ranked(D.document_items(matches, valid, sec).join(items, "item_key", "left_semi"), unit="item_key", limit=200)
    listed = items.select("item_key", F.lit("").alias("title_fold"), F.reverse("item_key").alias("r"))
    order = N.winners_in_order(won, listed.withColumn("effective_at", F.lit(None).cast("timestamp")), "relevance")
    place = F.row_number().over(N.Window.orderBy(F.desc("item_key")))  # over the winners
    return order.withColumn("place", place).select("item_key", "document_key", "rank", "place")


@query(f"""WITH {SCORED_SQL.format(docs=DOCS_SQL)}, h AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY type, document_key) AS pos, count(*) OVER (PARTITION BY recording_id) AS n FROM scored WHERE worst < 9),
k AS (SELECT *, row_number() OVER (ORDER BY document_key) AS place FROM h WHERE pos <= 3), c AS (SELECT bool_or(n > 3) AS cut_unit, count(*) > 60 AS cut_total FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY worst, type, occurrences DESC, first, document_key) AS b FROM k WHERE place <= 60), u AS (SELECT * FROM b WHERE b = 1)
SELECT recording_id, document_key, CAST(worst AS INT) AS worst, occurrences, CAST(first AS INT) AS first, CAST(row_number() OVER (ORDER BY worst, type, occurrences DESC, first, document_key, recording_id) AS INT) AS rank,
  CASE WHEN NOT cut_total THEN greatest((SELECT count(*) FROM u) - 10, 0) END AS more, cut_unit OR cut_total AS truncated FROM u, c QUALIFY rank <= 10""")
def bounded_search(spark, sf_dir):
    """Search with bounded candidates (three a recording, 60 in all), which tells that it cut something."""
    return S.search(S.folded(search_documents(spark, sf_dir)), QUERY, limit=10, per_unit=3, total=60)


@query(f"WITH {DOCS_SQL} SELECT document_key, CASE WHEN length(body_text) > 320 THEN substr(body_text, 1, 320) || '…' WHEN body_text = '' THEN coalesce(nullif(title_text, ''), nullif(aux_text, '')) ELSE body_text END AS excerpt FROM docs")
def document_excerpts(spark, sf_dir):
    return search_documents(spark, sf_dir).select("document_key", S.excerpt_of().alias("excerpt"))


@query(f"""SELECT 'segment:' || conv_id || ':' || turn AS document_key, CASE WHEN conv_id % 7 <> 2 THEN turn // 5 + 1 END AS page FROM conversations WHERE trim(text) <> ''""")
def segment_links(spark, sf_dir):
    d = D.documents_from_segments(X.segments(spark, sf_dir))
    t = d.select("recording_id", "transcript_id", (F.col("transcript_id") % 7 != 2).alias("is_active")).distinct()
    return S.segment_links(d, t, 5).select("document_key", "page")


@query(f"""WITH {LIB_SQL}, pos AS (SELECT document_key, CASE WHEN doc_type = 'recording' THEN CAST(right(document_key, 12) AS BIGINT) WHEN section_id IS NOT NULL THEN section_id // 1000 ELSE CAST(split_part(document_key, ':', 2) AS BIGINT) END AS conv,
  CASE WHEN doc_type = 'segment' THEN CAST(split_part(document_key, ':', 3) AS INT) END AS ord, section_id FROM built)
SELECT document_key FROM pos a WHERE conv % 5 <> 3 AND (section_id IS NULL OR section_id % 4 <> 1)
  AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.transcript_id = a.conv AND s.transcript_id IN (SELECT transcript_id FROM valid) AND s.section_id % 4 = 1 AND a.ord >= s.start_ordinal AND a.ord < s.end_ordinal)""")
def live_documents(spark, sf_dir):
    """Documents after those of archived recordings and of archived sections are taken out."""
    d, valid, sec = _built(spark, sf_dir)
    t = F.lit("2024-01-01").cast("timestamp")
    held = sec.join(valid.select("transcript_id"), "transcript_id", "left_semi").withColumn("archived_at", F.when(F.col("section_id") % 4 == 1, t))
    rec = d.select("recording_id").distinct().withColumn("archived_at", F.when(F.right("recording_id", F.lit(12)).cast("long") % 5 == 3, t))
    return V.without_archived(d, rec, held).select("document_key")


# ---- vectors, answers ----------------------------------------------------------------------------


@query("""WITH g AS (SELECT vec_id AS generation_id, CASE vec_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'superseded' ELSE 'failed' END AS state FROM embeddings WHERE vec_id < 30), v AS (SELECT vec_id % 30 AS generation_id FROM embeddings), s AS (SELECT unnest(['building', 'active', 'superseded', 'failed']) AS state)
SELECT state, (SELECT count(*) FROM g WHERE g.state = s.state) AS generations, (SELECT count(*) FROM g JOIN v USING (generation_id) WHERE g.state = s.state) AS vectors FROM s""")
def generation_counts(spark, sf_dir):
    e = X.read(spark, sf_dir, "embeddings")
    g = e.filter("vec_id < 30").select(F.col("vec_id").alias("generation_id"), F.when(F.col("vec_id") % 3 == 0, "active").when(F.col("vec_id") % 3 == 1, "superseded").otherwise("failed").alias("state"))
    return G.generation_counts(g, e.select((F.col("vec_id") % 30).alias("generation_id")))


@query("""SELECT vec_id AS generation_id, list_filter([CASE WHEN vec_id % 2 = 0 THEN 'model_mismatch' END, CASE WHEN vec_id % 3 = 0 THEN 'dimension_mismatch' END, CASE WHEN vec_id % 5 = 0 THEN 'version_mismatch' END, CASE WHEN vec_id % 7 = 0 THEN 'index_mismatch' END], lambda x: x IS NOT NULL) AS faults
FROM embeddings WHERE vec_id % 4 <> 1""")
def generation_faults(spark, sf_dir):
    i = F.col("vec_id")
    pick = lambda k, bad, good: F.when(i % k == 0, bad).otherwise(good)
    g = X.read(spark, sf_dir, "embeddings").select(i.alias("generation_id"), pick(2, "old", "m").alias("model"), pick(3, 8, 64).alias("dimensions"), pick(5, "0", "1").alias("embedding_version"), pick(7, "0", "2").alias("source_index_version"), F.when(i % 4 == 1, "failed").otherwise("active").alias("state"))
    return G.generation_faults(g, "m", 64, "1", "2")


@query("SELECT unnest([1, 2, 3]) AS generation_id, unnest(['superseded', 'active', 'failed']) AS state")
def generation_promotion(spark, sf_dir):
    """The vectors as a new generation that is checked and replaces the active one."""
    e = X.read(spark, sf_dir, "embeddings").withColumn("document_key", F.col("vec_id").cast("string"))
    g = spark.createDataFrame([(1, "active"), (2, "building"), (3, "failed")], "generation_id int, state string")
    return G.promoted(g, 2, e.select("document_key", F.col("document_key").alias("content_hash")), e.select(F.lit(2).alias("generation_id"), "document_key", F.col("document_key").alias("source_content_hash"), "embedding"), 64)


@query("""WITH d AS (SELECT vec_id, 'h' || vec_id AS d FROM embeddings WHERE vec_id % 13 <> 0), v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'old' ELSE 'h' || vec_id END AS v FROM embeddings WHERE vec_id % 11 <> 0)
SELECT CAST(coalesce(d.vec_id, v.vec_id) AS VARCHAR) AS document_key, CASE WHEN d.vec_id IS NULL THEN 'delete' WHEN v.vec_id IS NULL OR d <> v THEN 'embed' ELSE 'keep' END AS action FROM d FULL JOIN v USING (vec_id)""")
def vector_repair_plan(spark, sf_dir):
    e = X.read(spark, sf_dir, "embeddings").withColumn("document_key", F.col("vec_id").cast("string"))
    h, i = F.concat(F.lit("h"), F.col("vec_id").cast("string")), F.col("vec_id")
    found = V.classify_vectors(e.filter(i % 13 != 0).select("document_key", h.alias("content_hash")), e.filter(i % 11 != 0).select("document_key", F.when(i % 7 == 0, "old").otherwise(h).alias("source_content_hash"), "embedding"), 64)
    return found.select("document_key", F.when(F.col("category") == "ok", "keep").when(F.col("category") == "orphan", "delete").otherwise("embed").alias("action"))


@query(f"""WITH {COSINE_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY query_id, unit ORDER BY cosine DESC, document_key) AS u FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, document_key, unit) AS t FROM u WHERE u <= 3)
SELECT query_id, bool_and(CAST(split_part(document_key, ':', 2) AS BIGINT) % 97 <> 0) AS valid FROM t WHERE t <= 12 GROUP BY 1""")
def evidence_check(spark, sf_dir):
    """Evidence joined back to documents of which some have changed since."""
    v = _vectors(spark, sf_dir)
    texts = v.select("document_key", F.col("document_key").alias("content_hash"), F.lit("text").alias("text"))
    live = v.select("document_key", F.when(F.col("vec_id") % 97 == 0, "new").otherwise(F.col("document_key")).alias("content_hash"))
    return V.revalidated(V.evidence(_queries(spark, sf_dir), v, texts), live)


@query("""SELECT vec_id AS query_id, CASE (vec_id // 100) % 5 WHEN 1 THEN 'insufficient' WHEN 2 THEN 'failed' ELSE 'answered' END AS state, CASE WHEN (vec_id // 100) % 5 IN (1, 2) THEN NULL ELSE 'Yes [C1].' END AS answer,
  CASE WHEN (vec_id // 100) % 5 IN (1, 2) THEN [] ELSE [1] END AS citations, CASE (vec_id // 100) % 5 WHEN 2 THEN 2 ELSE 1 END AS calls FROM embeddings WHERE vec_id % 100 = 0""")
def question_answers(spark, sf_dir):
    """Questions over vector evidence with a stub model that answers, lacks evidence, or never gets its citations right."""
    v = _vectors(spark, sf_dir)
    texts = v.select("document_key", F.col("document_key").alias("content_hash"), F.concat(F.lit("text of "), "document_key").alias("text"))
    q = _queries(spark, sf_dir)
    asked = q.select("query_id", F.concat(F.lit("kind "), (F.floor(F.col("query_id") / 100) % 5).cast("string")).alias("question"))

    def chat(prompts: list[str]) -> list[str]:
        told = lambda answer, citations, insufficient=False: {"answer": answer, "citations": citations, "insufficient": insufficient}
        replies = {"1": told("", [], True), "2": told("Yes [C1] and [C2, C3] [Cx].", [1])}
        return [json.dumps(replies.get(p.split("\n")[0].split()[1], told("Yes [C1].", [1]))) for p in prompts]

    return V.ask(asked, V.evidence(q, v, texts), chat)


# ---- streams -------------------------------------------------------------------------------------


def _stream(spark, sf_dir, name: str, files: int | None = None) -> DataFrame:
    """A table as a stream; the pattern lets it be one file or a folder of them."""
    return J.replay(spark, f"{sf_dir}/{name}.parque[t]", X.read(spark, sf_dir, name).schema, files)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf_dir):
    """Running counts of an event stream, a file a batch: the last update of each."""
    return J.drained(J.running_counts(_stream(spark, sf_dir, "events", 1), "event_type"), "counts", counts="event_type")


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def stream_first_contents(spark, sf_dir):
    seen = _stream(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.lit("2024-01-01").cast("timestamp").alias("seen_at"))
    return J.drained(J.first_contents(seen), "contents").select("sha256")


@query("""WITH top AS (SELECT max(ts + CASE WHEN event_type = 'signup' THEN INTERVAL 0 MINUTE ELSE INTERVAL 1 MINUTE END) AS t FROM events)
SELECT event_id AS attempt_id, ts AS started_at FROM events, top WHERE event_type = 'signup' AND ts < t - INTERVAL 35 MINUTE""")
def stream_timeouts(spark, sf_dir):
    """Attempts whose finish did not come within 30 minutes, as far as the watermark (5 minutes behind) can tell."""
    both = F.array(F.struct(F.lit("start").alias("kind"), F.col("ts").alias("at")), F.struct(F.when(F.col("event_type") != "signup", "finish").alias("kind"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("at")))
    e = _stream(spark, sf_dir, "events").select(F.col("event_id").alias("attempt_id"), F.explode(both).alias("x")).select("attempt_id", "x.kind", F.col("x.at").cast("timestamp").alias("ts")).filter("kind is not null")
    return J.drained(J.interrupted(e), "timeouts")


@query("SELECT url || '#' || page_id AS path, length(html) AS length FROM pages WHERE page_id % 3 = 0")
def stream_stable_files(spark, sf_dir):
    """Listings in which a third of the files stands still for 40 seconds, a third for 10, and a third changes."""
    k = F.col("page_id") % 3
    size = F.length("html")
    seen = F.explode(F.array(F.struct(F.lit(0).alias("after"), size.alias("length")), F.struct(F.when(k == 1, 10).otherwise(40).alias("after"), F.when(k == 2, size + 1).otherwise(size).alias("length")))).alias("x")
    p = _stream(spark, sf_dir, "pages").select(F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("path"), seen)
    p = p.select("path", F.col("x.length").cast("long").alias("length"), F.lit(1.0).alias("mtime"), F.timestamp_seconds(F.lit(1704067200) + F.col("x.after")).alias("seen_at"))
    return J.drained(J.stability_gate(p), "stable").select("path", "length")


@query(f"""WITH {DOCS_SQL}, s AS (SELECT document_key, recording_id, content_hash FROM hashed WHERE doc_type = 'summary'), t AS (SELECT {rid('doc_id % 100')} AS recording_id FROM labels WHERE toxic = 1 GROUP BY 1)
SELECT document_key, CASE WHEN recording_id IN (SELECT recording_id FROM t) THEN content_hash ELSE 'old' END AS content_hash, recording_id IN (SELECT recording_id FROM t) AS touched FROM s
WHERE NOT (recording_id IN (SELECT recording_id FROM t) AND CAST(split_part(document_key, ':', 2) AS BIGINT) % 9 = 0)""")
def stream_index_sync(spark, sf_dir):
    """A stored index after a stream of touched recordings: theirs is as expected now, a ninth of it gone, the rest as it was."""
    docs = search_documents(spark, sf_dir).filter("doc_type = 'summary'")
    docs = docs.withColumn("index_hash", F.col("content_hash"))
    index = IndexLog(spark, J.shared_folder(spark, "index"), docs.schema)
    index.write(docs.withColumn("content_hash", F.lit("old")))
    expected = docs.filter(F.split_part("document_key", F.lit(":"), F.lit(2)).cast("long") % 9 != 0)
    changes = _stream(spark, sf_dir, "labels").filter("toxic = 1").select(X.recording_id(F.col("doc_id") % 100).alias("recording_id"))
    J.sync_stream(changes, index.sync(lambda ids: (expected, no_faults(ids))), J.shared_folder(spark, "sync")).awaitTermination()
    return index.read().select("document_key", "content_hash", (F.col("content_hash") != "old").alias("touched"))
