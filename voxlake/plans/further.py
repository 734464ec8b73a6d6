"""Queries of jobs with an algorithm of their own: typed reading, scans, stored indexes and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import text as T
from voxlake.operators import items as N
from voxlake.operators import search as S
from voxlake.operators import vectors as V
from voxlake.operators.hashtree import HashTree, tree_differences
from voxlake.operators.payloads import checked_replies
from voxlake.operators.postings import TrigramIndex
from voxlake.operators.scans import kept
from voxlake.plans import fixtures as X
from voxlake.plans.catalog import ITEMS_SQL, _items, _stream, search_documents
from voxlake.plans.registry import DOCS_SQL, QUERY, SCORED_SQL, query, rid
from voxlake.sources import generations as G
from voxlake.sources import ingest as I  # noqa: E741
from voxlake.streaming import jobs as J
from voxlake.streaming.changelog import IndexLog

# ---- transcript files ----------------------------------------------------------------------------

#: What is planted in the second segment of a file, and the fault that it is: JSON of the whole item, or of its end, by the number of the case.
ITEM_FAULTS = {
    1: ('"text"', "invalid_segment_item"), 2: ("null", "invalid_segment_item"), 3: ('{"text": 5}', "invalid_segment_text"), 4: ('{"start": 1}', "invalid_segment_text"), 5: ('{"text": "t", "speaker": 3}', "invalid_segment_speaker"),
    6: ('{"text": "t", "speaker": null, "start": null}', None), 7: ('{"text": "t", "start": "1"}', "invalid_timestamp"), 8: ('{"text": "t", "end": true}', "invalid_timestamp"), 9: ('{"text": "t", "start": -0.5}', "invalid_timestamp"),
    10: ('{"text": "t", "start": 1e999}', "invalid_timestamp"), 11: ('{"text": "t", "start": 11000.5, "end": 11000.25}', "end_before_start"), 12: ('{"text": "t", "start": 7999.5}', "non_monotonic_start"), 13: ('{"text": "t", "start": 4999}', "non_monotonic_start"),
    14: ('{"text": "t", "start": 8000}', None),
}
#: Files broken as a whole: what stands before and behind the segments.
FILE_FAULTS = {
    15: ('{"segments": [', "]}", "invalid_envelope"), 16: ('{"text": 1, "segments": [', "]}", "invalid_envelope"), 17: ('{"text": "t", "segments": {"a": [', "]}}", "invalid_envelope"), 18: ('{"text": "t", "segments": [', "", "malformed_json"),
    19: ('{"text": "t", "segments": [', "]} more", "malformed_json"), 20: ("[", "]", "invalid_envelope"),
}
_CASES = len(ITEM_FAULTS) + len(FILE_FAULTS) + 2


def transcript_files(spark, sf_dir) -> DataFrame:
    """Conversations as JSON files (file_id, raw) of at most 64 turns, whole texts included, with a fault each or none; the last case is a file without segments."""
    c = X.read(spark, sf_dir, "conversations").withColumns({"part": F.floor(F.col("turn") / 64), "at": F.col("turn") % 64})
    c = c.withColumns({"file_id": F.col("conv_id") * 1000 + F.col("part"), "case": (F.col("conv_id") + F.col("part")) % _CASES})
    case = F.col("case")
    own = F.to_json(F.struct("text", F.col("role").alias("speaker"), (10000 + F.col("at") * 1000).alias("start"), (10500 + F.col("at") * 1000).alias("end")))
    planted = F.create_map(*[F.lit(x) for k, (item, _) in ITEM_FAULTS.items() for x in (k, item)])
    item = F.when(F.col("at") == 1, F.coalesce(F.try_element_at(planted, case.cast("int")), own)).otherwise(own)
    body = F.when(case == _CASES - 1, "").otherwise(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", item.alias("item")))), lambda x: x["item"]), ", "))
    around = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, f in FILE_FAULTS.items() for x in (k, f[i])]), case.cast("int")), F.lit(('{"text": "t", "segments": [', "]}")[i]))
    return c.groupBy("file_id", "case").agg(body.alias("body")).select("file_id", F.concat(around(0), "body", around(1)).alias("raw"))


@query(f"""
WITH f AS (SELECT conv_id * 1000 + turn // 64 AS file_id, (conv_id + turn // 64) % {_CASES} AS k, count(*) AS n FROM conversations GROUP BY ALL),
g AS (SELECT *, CASE WHEN k IN ({', '.join(str(k) for k, f in FILE_FAULTS.items() if f[2] == 'malformed_json')}) THEN 'malformed_json' WHEN k BETWEEN 15 AND 20 THEN 'invalid_envelope' WHEN n = 1 THEN NULL
  {' '.join(f"WHEN k = {k} THEN '{fault}'" for k, (_, fault) in ITEM_FAULTS.items() if fault)} END AS category FROM f)
SELECT file_id, category, CASE WHEN category IS NOT NULL AND k < 15 THEN 1 END AS ordinal, CASE WHEN category = 'non_monotonic_start' THEN CASE k WHEN 12 THEN '2001_5000_ms' ELSE 'over_5000_ms' END END AS regression,
  CASE WHEN k BETWEEN 15 AND 20 THEN NULL WHEN k = {_CASES - 1} THEN 0 ELSE n END AS segments FROM g""")
def transcript_validation(spark, sf_dir):
    """Every transcript file with its first fault, if any, and its number of segments."""
    files = transcript_files(spark, sf_dir)
    found = I.quarantine(I.parse_transcripts(files)).select("file_id", F.col("category").alias("c"), "ordinal", "regression")
    whole = I.parse_envelopes(files).select("file_id", F.size("segments").cast("long").alias("segments"))
    return whole.join(found, "file_id", "left").select("file_id", F.col("c").alias("category"), "ordinal", "regression", "segments")


# ---- index upkeep --------------------------------------------------------------------------------


@query(f"""
WITH t AS (SELECT DISTINCT doc_id % 100 AS r FROM labels WHERE toxic = 1), d AS (SELECT doc_id % 100 AS r, doc_id % 9 <> 0 AS wanted, doc_id % 4 AS k FROM documents),
c AS (SELECT r, count(*) FILTER (WHERE wanted AND k = 3) AS inserted, count(*) FILTER (WHERE wanted AND k = 0) AS updated, count(*) FILTER (WHERE wanted AND k = 1) AS repaired, count(*) FILTER (WHERE NOT wanted AND k <> 3) AS deleted,
  count(*) FILTER (WHERE wanted AND k = 2) AS skipped FROM d GROUP BY r),
s AS (SELECT *, CASE WHEN t.r % 20 = 3 THEN 0 ELSE 1 END AS ok FROM t JOIN c USING (r))
SELECT {rid('r')} AS recording_id, CASE r % 20 WHEN 3 THEN 3 WHEN 13 THEN 2 ELSE 1 END AS attempt, CASE ok WHEN 1 THEN 'synced' ELSE 'given_up' END AS outcome, CASE ok WHEN 0 THEN 'no layout' END AS fault,
  inserted * ok AS inserted, updated * ok AS updated, repaired * ok AS repaired, deleted * ok AS deleted, skipped * ok AS skipped FROM s""")
def stream_sync_outcomes(spark, sf_dir):
    """What became of each touched recording: a stream's batch in which a tenth of them fails, and two further batches that try those again; half of them succeed then."""
    docs = search_documents(spark, sf_dir).filter("doc_type = 'summary'").withColumn("index_hash", F.sha2(F.concat_ws("|", "title_text", "body_text"), 256))
    number = F.split_part("document_key", F.lit(":"), F.lit(2)).cast("long")
    index = IndexLog(spark, J.shared_folder(spark, "index"), docs.schema)
    held = docs.filter(number % 4 != 3)
    index.write(held.withColumns({"content_hash": F.when(number % 4 == 0, "old").otherwise(F.col("content_hash")), "index_hash": F.when(number % 4 != 1, F.col("index_hash"))}))

    def expected(*cases: int):
        last = F.substring("recording_id", -12, 12).cast("long") % 20
        return lambda ids: (docs.filter(number % 9 != 0), ids.filter(last.isin(*cases)).select("recording_id", F.lit("no layout").alias("fault")))

    changes = _stream(spark, sf_dir, "labels").filter("toxic = 1").select(X.recording_id(F.col("doc_id") % 100).alias("recording_id"))
    J.sync_stream(changes, index.sync(expected(3, 13)), J.shared_folder(spark, "sync")).awaitTermination()
    last = max(index._committed("batch", "/outcomes"))
    none = index.outcomes().select("recording_id").limit(0)
    for batch in (last, last + 1):  # the stream's next batches
        index.sync(expected(3))(none, batch)
    index.compact()
    return index.outcomes().drop("batch")


# ---- stored trigram index ------------------------------------------------------------------------

PHRASES = ("tion the", "ment", "que des", "keit", "zzq")


@query(f"""WITH {DOCS_SQL}, f AS (SELECT document_key, [replace(lower(nfc_normalize(title_text)), 'ß', 'ss'), replace(lower(nfc_normalize(body_text)), 'ß', 'ss'), replace(lower(nfc_normalize(aux_text)), 'ß', 'ss')] AS fields FROM docs),
q AS (SELECT unnest([{', '.join(f"'{p}'" for p in PHRASES)}]) AS phrase)
SELECT phrase, document_key FROM q, f WHERE len(list_filter(string_split(phrase, ' '), lambda t: NOT list_bool_or(list_transform(fields, lambda x: coalesce(contains(x, t), false))))) = 0""")
def trigram_index_search(spark, sf_dir):
    """Documents with every term of each of some phrases, by an index that is built once; each query reads its own blocks and the rows that they leave."""
    index = TrigramIndex(spark, J.shared_folder(spark, "trigrams")).build(S.folded(search_documents(spark, sf_dir)))
    found = None
    for phrase in PHRASES:
        hit = S.keyword_matches(index.matching(phrase), phrase).select(F.lit(phrase).alias("phrase"), "document_key")
        found = hit if found is None else found.unionByName(hit)
    return found


# ---- vector generations --------------------------------------------------------------------------


@query("""
SELECT 'summary:' || doc_id AS document_key, CASE WHEN doc_id % 3 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS source_content_hash, 'third' AS generation, 16 AS dimensions, 2 AS refused,
  round((CAST('0x' || substr(CASE WHEN doc_id % 3 = 0 THEN sha256(text || '!') ELSE sha256(text) END, 3, 2) AS INT) - 127.5) / 127.5, 5) AS second
FROM documents""")
def generation_rebuild(spark, sf_dir):
    """Whole texts embedded and published as a generation; then one whose model fails at some texts and one with vectors of two sizes, both refused; then
    one of changed texts. What the active generation holds at the end."""
    d = X.read(spark, sf_dir, "documents").select(F.concat(F.lit("summary:"), F.col("doc_id").cast("string")).alias("document_key"), "doc_id", "text")
    versioned = lambda df: df.withColumn("content_hash", F.sha2("text", 256))
    path, embedder, refused = J.shared_folder(spark, "vectors"), V.hash_embedder(16), 0
    G.rebuilt(versioned(d), path, "first", embedder)

    def failing(texts: list[str]) -> list[list[float]]:
        return [v if len(t) % 50 else [0.0] * 16 for t, v in zip(texts, embedder(texts))]

    def of_two_sizes(texts: list[str]) -> list[list[float]]:
        return [v if len(t) % 50 else v[:8] for t, v in zip(texts, embedder(texts))]

    for bad in (failing, of_two_sizes):
        try:
            G.rebuilt(versioned(d), path, "second", bad)
        except G.GenerationError:
            refused += G.active(spark, path)[0]["generation"] == "first"
    G.rebuilt(versioned(d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))), path, "third", embedder)
    known, vectors = G.active(spark, path)
    second = F.round(F.element_at("embedding", 2).cast("double"), 5)
    return vectors.select("document_key", "source_content_hash", F.lit(known["generation"]).alias("generation"), F.size("embedding").alias("dimensions"), F.lit(refused).alias("refused"), second.alias("second"))


# ---- comparison by hash trees --------------------------------------------------------------------


@query(f"""
WITH {DOCS_SQL}, d AS (SELECT document_key, CAST('0x' || substr(md5(document_key), 1, 8) AS BIGINT) % 400 AS m FROM hashed),
f AS (SELECT document_key, unnest(list_filter([CASE WHEN m = 1 THEN 'missing_from_registry' END, CASE WHEN m = 3 THEN 'version_mismatch' END, CASE WHEN m = 2 THEN 'stale_content' END, CASE WHEN m = 4 THEN 'missing_from_index' END,
  CASE WHEN m IN (2, 5) THEN 'content_mismatch' END, CASE WHEN m = 0 THEN 'orphan_document' END], lambda x: x IS NOT NULL)) AS category FROM d)
SELECT document_key, category FROM f""")
def index_status_by_tree(spark, sf_dir):
    """The faults of an index of which a few rows in a hundred are odd, found by three hash trees."""
    d = search_documents(spark, sf_dir)
    mark = F.conv(F.substring(F.md5("document_key"), 1, 8), 16, 10).cast("long") % 400
    expected = d.filter(mark != 0)
    registry = d.filter(mark != 1).withColumns({"content_hash": F.when(mark == 2, "old").otherwise(F.col("content_hash")), "index_version": F.when(mark == 3, "0").otherwise(F.col("index_version"))})
    index = d.filter(~mark.isin(1, 4)).withColumn("content_hash", F.when(mark == 5, "old").otherwise(F.col("content_hash"))).drop("index_version")
    return tree_differences(*(HashTree(spark, J.shared_folder(spark, "tree")).build(x) for x in (expected, registry, index)))


# ---- search results as the listing shows them ----------------------------------------------------

PAGES = (("relevance", 1), ("title_az", 2), ("title_za", 99), ("newest", 1), ("oldest", -3), ("sideways", 2))
_PLACES = {"title_az": "title_fold", "title_za": "title_fold DESC", "newest": "effective_at DESC", "oldest": "effective_at", "relevance": "rank", "sideways": "rank"}


@query(f"""WITH {SCORED_SQL.format(docs=DOCS_SQL)}, {ITEMS_SQL},
own AS (SELECT i.*, s.document_key, s.worst, s.occurrences, s.first FROM scored s JOIN items i ON i.item_key = 'r:' || split_part(s.document_key, ':', 2) WHERE s.doc_type = 'summary' AND s.worst < 9 AND i.audio_status = 'present'),
ranked AS (SELECT *, row_number() OVER (ORDER BY worst, occurrences DESC, first, document_key, item_key) AS rank, count(*) OVER () AS n FROM own),
top AS (SELECT *, least(n, 60) AS matched, n > 60 AS truncated, greatest(CAST(ceil(least(n, 60) / 7.0) AS INT), 1) AS pages FROM ranked WHERE rank <= 60)
{' UNION ALL '.join(f"SELECT '{sort}' AS sort, item_key, title, document_key, CAST(rank AS INT) AS rank, CAST(place AS INT) AS place, matched, truncated, pages, least(greatest({number}, 1), pages) AS page FROM (SELECT *, row_number() OVER (ORDER BY {_PLACES[sort]}, item_key) AS place FROM top) WHERE (place - 1) // 7 + 1 = least(greatest({number}, 1), pages)" for sort, number in PAGES)}""")
def search_listing_page(spark, sf_dir):
    """Pages of a search among recordings whose audio is present, in every order; the last order does not exist, which leaves the filters as they are."""
    d = S.folded(search_documents(spark, sf_dir)).filter("doc_type = 'summary'").withColumn("item_key", F.concat(F.lit("r:"), F.split_part("document_key", F.lit(":"), F.lit(2))))
    d, found, listings = kept(d, "folded"), None, {}
    for sort, number in PAGES:
        wanted, order, _ = N.search_request(N.Filters(audio="present"), sort, set(), set())
        if wanted not in listings:
            listings[wanted] = kept(_items(spark, sf_dir, wanted), "items")
        page = N.search_page(d, QUERY, listings[wanted], order, number, 7, 60)
        page = page.select(F.lit(sort).alias("sort"), "item_key", "title", "document_key", "rank", "place", "matched", "truncated", "pages", "page")
        found = page if found is None else found.unionByName(page)
    return found


# ---- places of matches ---------------------------------------------------------------------------

MATCHED = ("tion", "ss", "ee", "é")


@query(f"""WITH {DOCS_SQL}, f AS (SELECT document_key, unnest(['title', 'body', 'aux']) AS field, unnest([title_text, body_text, aux_text]) AS t FROM docs),
x AS (SELECT document_key, field, replace(nfc_normalize(t), 'ß', chr(1) || chr(2)) AS wide FROM f WHERE t <> ''),
y AS (SELECT *, replace(replace(lower(wide), chr(1), 's'), chr(2), 's') AS folded FROM x),
q AS (SELECT unnest([{', '.join(f"'{m}'" for m in MATCHED)}]) AS term),
z AS (SELECT document_key, field, term, wide, length(term) AS n, list_transform(string_split(folded, term), lambda p: length(p)) AS parts FROM y, q WHERE contains(folded, term)),
p AS (SELECT *, unnest(range(1, len(parts))) AS k FROM z),
m AS (SELECT document_key, field, term, wide, n, CAST(list_sum(parts[1:k]) + (k - 1) * n AS BIGINT) AS spot FROM p),
w AS (SELECT *, length(replace(left(wide, spot), chr(2), '')) AS before, length(replace(left(wide, spot + n), chr(2), '')) AS upto, substr(wide, spot + 1, 1) = chr(2) AS inside FROM m)
SELECT document_key, field, term, CAST(before - CASE WHEN inside THEN 1 ELSE 0 END AS INT) AS start, CAST(upto AS INT) AS "end" FROM w""")
def match_positions(spark, sf_dir):
    """Every place of some terms in every field, in characters of the text itself."""
    return S.match_positions(search_documents(spark, sf_dir), " ".join(MATCHED))


# ---- replies of a summarising model --------------------------------------------------------------

#: By the number of the case: what replaces fields of a good reply, the source language, and the field that is at fault.
REPLIES = {
    0: ({}, "", None), 1: ({"title": '" \\t "'}, "", "title"), 2: ({"title": "5"}, "", "title"), 3: ({"key_points": '[{"text": "a", "level": 1}, {"text": "b", "level": 3}]'}, "", "key_points"),
    4: ({"key_points": '[{"text": "a", "level": 4}]'}, "", "key_points"), 5: ({"key_points": '[{"text": "a", "level": true}]'}, "", "key_points"), 6: ({"key_points": '[{"text": "a", "level": 1}, {"text": "b", "level": 2}, {"text": "n", "level": 0}, {"text": "c", "level": 3}]'}, "", None),
    7: ({"action_items": '["do"]'}, "", "action_items"), 8: ({"action_items": '[{"text": "do", "owner": 1}]'}, "", "action_items"), 9: ({"action_items": '[{"text": "do", "owner": null, "due_date": "soon"}]'}, "", None), 10: ({"people": '"Ann"'}, "", "people"),
    11: ({"people": "null"}, "", None), 12: ({"organizations": '["a", ""]'}, "", "organizations"), 13: ({"topics": "[" + ", ".join(['"t"'] * 51) + "]"}, "", "topics"), 14: ({"language": "7"}, "", "language"), 15: ({"language": '"no tag!"'}, "", "language"),
    16: ({"language": '"no tag!"'}, "zh_hant", None), 17: ({"suggested_tags": '"a"'}, "", "suggested_tags"), 18: ({"suggested_tags": '["Unknown"]'}, "fi", None), 19: ({"suggested_tags": '["unknown", "ZZ", "beta", "Beta"]'}, "", None), 20: ({"suggested_tags": "[5]"}, "", "suggested_tags"),
}
_GOOD = {"title": '" A title "', "overview": "", "key_points": '[{"text": "a", "level": 1}]', "action_items": "[]", "people": '["Ann", "Bo"]', "organizations": "[]", "topics": "[]", "language": '"EN-gb"', "suggested_tags": '["STRASSE", "new", "Unknown", "straße"]'}
_SHAPES = len(REPLIES) + 4  # further: in a fence, an array, text behind the object, a repeated key


@query(f"""
WITH d AS (SELECT doc_id AS id, doc_id % {_SHAPES} AS k, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents),
f AS (SELECT id, k, text, CASE WHEN k > {len(REPLIES)} THEN 'malformed_json' WHEN k = 1 OR k = 2 THEN 'title' WHEN length(text) NOT BETWEEN 1 AND 8000 THEN 'overview' {' '.join(f"WHEN k = {k} THEN '{f}'" for k, (_, _, f) in REPLIES.items() if f)} END AS fault FROM d)
SELECT id, fault, CASE WHEN fault IS NULL THEN 'A title' END AS title, CASE WHEN fault IS NULL THEN sha256(text) END AS overview, CASE WHEN fault IS NULL THEN CASE k WHEN 6 THEN [1, 2, 0, 3] ELSE [1] END END AS levels,
  CASE WHEN fault IS NULL THEN CASE k WHEN 9 THEN 'soon' ELSE '' END END AS due, CASE WHEN fault IS NULL THEN CASE k WHEN 11 THEN 0 ELSE 2 END END AS people,
  CASE WHEN fault IS NULL THEN CASE k WHEN 16 THEN 'zh-Hant' WHEN 18 THEN 'fi' ELSE 'en-GB' END END AS language, CASE WHEN fault IS NULL THEN CASE k WHEN 18 THEN ['Unknown'] WHEN 19 THEN ['Beta'] ELSE ['Straße'] END END AS suggested,
  CASE WHEN fault IS NULL THEN CASE k WHEN 18 THEN [] WHEN 19 THEN ['ZZ'] ELSE ['new'] END END AS rejected FROM f""")
def reply_validation(spark, sf_dir):
    """Replies whose overviews are whole texts, right ones and with a fault in each field; what is left of them."""
    d = X.read(spark, sf_dir, "documents")
    k = F.col("doc_id") % _SHAPES
    overview = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)

    def field(name: str):
        good = overview if name == "overview" else F.lit(_GOOD[name])
        for case, (changes, _, _) in REPLIES.items():
            if name in changes:
                good = F.when(k == case, F.lit(changes[name])).otherwise(good)
        return F.concat(F.lit(f'"{name}": '), good)

    reply = F.concat(F.lit("{"), F.concat_ws(", ", *map(field, _GOOD)), F.lit("}"))
    n = len(REPLIES)
    raw = F.when(k == n, F.concat(F.lit(" ```json\n"), reply, F.lit("\n```\n"))).when(k == n + 1, F.concat(F.lit("["), reply, F.lit("]"))).when(k == n + 2, F.concat(reply, F.lit(" so"))).when(k == n + 3, F.concat(F.lit('{"title": "b", '), F.substring(reply, 2, 2**31 - 1))).otherwise(reply)
    source = F.lit("")
    for case, (_, code, _) in REPLIES.items():
        source = F.when(k == case, code).otherwise(source) if code else source
    tags = spark.createDataFrame([("strasse", "Straße"), ("beta", "Beta"), ("unknown", "Unknown")], "name_key string, name string")
    replies = kept(d.select(F.col("doc_id").alias("id"), raw.alias("raw"), source.alias("source_language")), "replies")
    found = checked_replies(replies, tags)
    due = F.when(F.col("fault").isNull(), F.coalesce(F.try_element_at("action_items", F.lit(1))["due_date"], F.lit("")))
    return found.select("id", "fault", "title", F.sha2("overview", 256).alias("overview"), F.transform("key_points", lambda p: p["level"]).alias("levels"), due.alias("due"), F.when(F.col("fault").isNull(), F.size("people")).alias("people"), "language", "suggested", "rejected")


# ---- small functions over whole tables -----------------------------------------------------------

_MASK = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])/[\p{{L}}\p{{N}}\p{{M}}_./\\-]+', '\1<path>', 'g')"


@query(rf"""
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'head' || chr(10) || '  error: /var/x and/or ' || doc_id || chr(13) || chr(10) || chr(10) || text ELSE text || chr(10) || 'last http://a/b line ' || doc_id END AS text FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
p AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: starts_with(lower(x), 'error:')), true) AS at1 FROM l)
SELECT doc_id, left(trim({_MASK.format("array_to_string(CASE WHEN coalesce(at1, 0) > 0 THEN lines[at1:at1 + 2] ELSE lines[len(lines):] END, ' | ')")}), 200) AS detail FROM p""")
def error_details(spark, sf_dir):
    """What a report shows of whole texts as error output: an error line and two more, or the last line, with paths masked."""
    d, k = X.read(spark, sf_dir, "documents"), F.col("doc_id") % 3
    number = F.col("doc_id").cast("string")
    said = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("head\n  error: /var/x and/or "), number, F.lit("\r\n\n"), "text")).otherwise(F.concat("text", F.lit("\nlast http://a/b line "), number))
    return d.select("doc_id", T.error_detail(said).alias("detail"))


@query("SELECT lang, count(DISTINCT replace(lower(nfc_normalize(text)), 'ß', 'ss')) AS texts, count(*) FILTER (WHERE contains(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ss')) AS with_ss FROM documents GROUP BY lang")
def folded_in_sql(spark, sf_dir):
    """The fold function called from Spark SQL."""
    T.register(spark)
    return spark.sql("SELECT lang, count(DISTINCT fold(text)) AS texts, count_if(contains(fold(text), 'ss')) AS with_ss FROM {d} GROUP BY lang", d=X.read(spark, sf_dir, "documents"))
