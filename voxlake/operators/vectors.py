"""Vector index: classification against documents, repair, exact cosine search, evidence."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from voxlake.functions.vectors import usability
from voxlake.operators.scans import covering

EVIDENCE, PER_RECORDING, EVIDENCE_CHARS, BUDGET_CHARS = 12, 3, 1000, 8000


def classify_vectors(documents: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """document_key and category: orphan, missing_document, stale_content, invalid_vector or ok."""
    d = documents.select("document_key", F.col("content_hash").alias("d"))
    v = vectors.select("document_key", F.col("source_content_hash").alias("v"), "embedding", F.lit(True).alias("has"))
    category = (
        F.when(F.col("d").isNull(), "orphan").when(F.col("has").isNull(), "missing_document").when(F.col("d") != F.col("v"), "stale_content")
        .when(usability(F.col("embedding"), dimensions) != "ok", "invalid_vector").otherwise("ok")
    )
    return d.join(v, "document_key", "full_outer").select("document_key", category.alias("category"))


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 128) -> DataFrame:
    """document_key, source_content_hash and embedding of texts (document_key, content_hash, text), by a caller's function in batches."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), batch):
                part = df.iloc[at : at + batch]
                yield pd.DataFrame({"document_key": part["document_key"], "source_content_hash": part["content_hash"], "embedding": embedder(list(part["text"]))})

    return texts.select("document_key", "content_hash", "text").mapInPandas(run, "document_key string, source_content_hash string, embedding array<float>")


def repair(documents: DataFrame, vectors: DataFrame, dimensions: int, embedder: Callable) -> DataFrame:
    """vectors after repair: good rows stay, orphans go, missing, stale and invalid ones are embedded anew."""
    found = classify_vectors(documents, vectors, dimensions)
    kept = vectors.join(found.filter("category = 'ok'").select("document_key"), "document_key", "left_semi")
    work = documents.join(found.filter("category in ('missing_document', 'stale_content', 'invalid_vector')").select("document_key"), "document_key", "left_semi")
    return kept.select("document_key", "source_content_hash", "embedding").unionByName(embed(work, embedder))


class IntegrityError(ValueError):
    """A stored vector does not fit its document: searches refuse rather than leave it out."""


def assert_whole(documents: DataFrame, vectors: DataFrame, dimensions: int) -> None:
    """Raise IntegrityError if any vector is missing, stale, orphan, zero or invalid."""
    counts = {r["category"]: r["n"] for r in fault_counts(classify_vectors(documents, vectors, dimensions)).collect() if r["category"] != "ok"}
    if counts:
        raise IntegrityError(f"embedding index integrity: {counts}")


#: Vectors and queries of a pair of blocks, on average: what a task of a search holds.
BLOCK_ROWS, QUERY_ROWS = 32_768, 4096


def best_documents(queries: DataFrame, vectors: DataFrame, per_unit: int, total: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, unit, document_key, type and cosine: for each query the `total` best documents with at most per_unit of a unit.

    queries: (query_id long, query), vectors: (document_key, unit, type, embedding), both usable. Every block of
    vectors meets every block of queries; a task keeps only rows that can be in the answer, so what is ranked
    at the end is `total` rows a block and query. Order: cosine, type, document_key, unit.
    """
    n, q = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-q // query_rows))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    none = vectors.select("document_key", "unit", "type").schema
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in none]
    mine = vectors.select(F.lit(None).cast("long").alias("query_id"), "document_key", "unit", "type", F.col("embedding").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("document_key"), F.lit(blocks)).cast("int").alias("b"), every(query_blocks).alias("q"))
    asks = queries.select(F.col("query_id").cast("long").alias("query_id"), *blank, F.col("query").cast("array<double>").alias("vec"), every(blocks).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("q"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        asked = df["query_id"].notna()
        held = df[~asked].sort_values(["type", "document_key", "unit"], kind="stable").reset_index(drop=True)
        found = []
        if len(held):
            data = np.stack(held["vec"].to_list())
            size = np.sqrt(np.einsum("ij,ij->i", data, data))
            codes = held["unit"].factorize(use_na_sentinel=False)[0]
            for qid, v in zip(df.loc[asked, "query_id"], df.loc[asked, "vec"]):
                v = np.asarray(v)
                cos = np.einsum("ij,j->i", data, v) / (np.sqrt(np.einsum("i,i->", v, v)) * size)
                order = np.argsort(-cos, kind="stable")
                by_unit = np.argsort(codes[order], kind="stable")
                c = codes[order][by_unit]
                first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                nth = np.empty(len(c), np.int64)
                nth[by_unit] = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
                take = order[nth < per_unit][:total]
                found.append(held.loc[take, ["document_key", "unit", "type"]].assign(query_id=int(qid), cosine=cos[take]))
        columns = ["query_id", "document_key", "unit", "type", "cosine"]
        return pd.concat(found)[columns] if found else pd.DataFrame({c: [] for c in columns})

    schema = StructType([StructField("query_id", LongType()), *none.fields, StructField("cosine", DoubleType())])
    local = mine.unionByName(asks).groupBy("b", "q").applyInPandas(run, schema)
    order = [F.desc("cosine"), F.col("type"), F.col("document_key"), F.col("unit")]
    few = local.withColumn("_u", F.row_number().over(Window.partitionBy("query_id", "unit").orderBy(*order))).filter(F.col("_u") <= per_unit)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= total).drop("_u")


def semantic_search(queries: DataFrame, vectors: DataFrame, limit: int = 50, documents: DataFrame | None = None, dimensions: int | None = None, unchecked: bool = False) -> DataFrame:
    """query_id, unit, document_key, cosine and rank: each unit's best document, then the best units.

    The whole index is checked first against its documents (document_key, content_hash) and dimensions, and one faulty vector anywhere
    fails the search with an IntegrityError. unchecked: the caller has done so (assert_whole()).
    """
    if not unchecked:
        if documents is None or dimensions is None:
            raise ValueError("a search needs the documents and dimensions to check the vectors against")
        assert_whole(documents, vectors, dimensions)
    return best_documents(queries, vectors, 1, limit).select("query_id", "unit", "document_key", "cosine", "rank")


#: Document types that can be evidence: summaries and segments, as search.TYPE_RANK numbers them.
EVIDENCE_TYPES = (0, 2)


def evidence(queries: DataFrame, vectors: DataFrame, texts: DataFrame, total: int = EVIDENCE, per_unit: int = PER_RECORDING, chars: int = EVIDENCE_CHARS, budget: int = BUDGET_CHARS) -> DataFrame:
    """query_id, citation (C1...), document_key, unit, content_hash and excerpt: best segments and summaries, few a unit, within a budget of characters.

    texts: (document_key, content_hash, text). The budget keeps the longest prefix of the ranking; empty texts
    are skipped before. Archived units must be gone before (without_archived()).
    """
    top = best_documents(queries, vectors.filter(F.col("type").isin(*EVIDENCE_TYPES)), per_unit, total)
    held = top.join(texts, "document_key").withColumn("excerpt", F.substring("text", 1, chars)).filter("excerpt <> ''")
    w = Window.partitionBy("query_id").orderBy("rank")
    held = held.withColumn("_sum", F.sum(F.length("excerpt")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= budget)
    return held.withColumn("citation", F.concat(F.lit("C"), F.row_number().over(w).cast("string"))).select("query_id", "citation", "document_key", "unit", "content_hash", "excerpt")


def evidence_text() -> Column:
    """What a document says as evidence: a segment its body, a summary its body, else its title, and for whole recordings else its aux text."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(F.when(F.col("doc_type") == "segment", some("body_text")).when(F.col("section_id").isNotNull(), F.coalesce(some("body_text"), some("title_text"))).otherwise(F.coalesce(some("body_text"), some("title_text"), some("aux_text"))), F.lit(""))


def without_archived(documents: DataFrame, recordings: DataFrame, sections: DataFrame) -> DataFrame:
    """documents (recording_id, transcript_id, segment_ordinal, section_id) without those of archived recordings, of segments inside archived sections, and of summaries of such.

    recordings: recording_id, archived_at; sections: valid ones (section_id, transcript_id, start_ordinal, end_ordinal, archived_at). Summaries of whole recordings stay.
    """
    gone = sections.filter("archived_at is not null")
    live = documents.join(recordings.filter("archived_at is not null").select("recording_id"), "recording_id", "left_anti")
    live = live.join(gone.select("section_id"), "section_id", "left_anti")
    spans = gone.select("transcript_id", F.col("start_ordinal").alias("lo"), F.col("end_ordinal").alias("hi"), F.col("section_id").alias("id"))
    return covering(live, spans, "transcript_id", "segment_ordinal", "_gone").filter("_gone is null").select(*documents.columns)


def revalidated(chosen: DataFrame, live: DataFrame) -> DataFrame:
    """query_id and valid: whether all chosen evidence (query_id, document_key, content_hash) is still what the live documents (document_key, content_hash) hold."""
    now = live.select("document_key", "content_hash", F.lit(True).alias("_same"))
    return chosen.join(now, ["document_key", "content_hash"], "left").groupBy("query_id").agg(F.bool_and(F.coalesce("_same", F.lit(False))).alias("valid"))


def ask(questions: DataFrame, chosen: DataFrame, chat: Callable[[list[str]], list[str]], retries: int = 1) -> DataFrame:
    """query_id, state, answer, citations and calls for questions (query_id, question) with their evidence (from evidence()).

    chat takes prompts and returns JSON texts {"answer", "citations": [1, ...], "insufficient"}. A reply that is
    no such JSON, or whose citations break a rule of answer_faults(), is asked for once more. A question
    without evidence is `insufficient` without a call. At most EVIDENCE rows belong to a question.
    """
    held = F.array_sort(F.collect_list(F.struct(F.substring("citation", 2, 9).cast("int").alias("n"), "excerpt")))
    rows = questions.select("query_id", "question").join(chosen.groupBy("query_id").agg(held.alias("held")), "query_id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = {i: ("insufficient", None, [], 0) for i in df.index}
            todo = [i for i in df.index if df["held"][i] is not None and len(df["held"][i])]
            for call in range(1, retries + 2):
                prompts = ["\n".join([str(df["question"][i]), *[f"[C{e['n']}] {e['excerpt']}" for e in df["held"][i]]]) for i in todo]
                again = []
                for i, reply in zip(todo, chat(prompts) if todo else []):
                    said = _parsed_answer(reply, len(df["held"][i]))
                    if said is None:
                        out[i] = ("failed", None, [], call)
                        again.append(i)
                    else:
                        out[i] = (*said, call)
                todo = again
            yield pd.DataFrame([(q, *out[i]) for i, q in df["query_id"].items()], columns=["query_id", "state", "answer", "citations", "calls"])

    return rows.mapInPandas(run, "query_id long, state string, answer string, citations array<int>, calls int")


def _parsed_answer(reply: str, n_evidence: int) -> tuple[str, str | None, list[int]] | None:
    """State, answer and citations of a reply, or None if it breaks a rule: exactly the three keys with their types, each bracket that begins with C a
    given evidence number, the declared numbers those in the text, each once, and none of either in an insufficient reply."""
    try:
        said = json.loads(reply)
    except (ValueError, TypeError):
        return None
    if type(said) is not dict or set(said) != {"answer", "citations", "insufficient"}:
        return None
    answer, declared = said["answer"], said["citations"]
    if type(answer) is not str or type(declared) is not list or type(said["insufficient"]) is not bool:
        return None
    inside = [c for c in (b.strip() for b in re.findall(r"\[([^\]]*)\]", answer)) if c.startswith("C")]
    inline = {int(c[1:]) for c in inside if re.fullmatch(r"C[0-9]+", c)}
    if not all(re.fullmatch(r"C[0-9]+", c) for c in inside) or not inline <= set(range(1, n_evidence + 1)):
        return None
    if said["insufficient"]:
        return None if declared or inline else ("insufficient", None, [])
    if not declared or any(type(c) is not int for c in declared) or len(set(declared)) != len(declared) or set(declared) != inline:
        return None
    return "answered", answer, declared


def fault_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count("*").alias("n"))


def hash_embedder(dimensions: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding model."""
    import hashlib

    def run(texts: list[str]) -> list[list[float]]:
        digests = [hashlib.sha256(t.encode()).digest() for t in texts]
        return [[(d[i % 32] - 127.5) / 127.5 for i in range(dimensions)] for d in digests]

    return run


def answer_faults(answers: DataFrame) -> DataFrame:
    """question_id and fault of answers (question_id, answer, declared, n_evidence): what a citation check finds, `ok` if nothing.

    Every bracket that begins with C must be a citation; citations must name evidence that was given, be the declared ones, and not repeat
    inside the declared list.
    """
    from voxlake.functions.text import citations, odd_citations

    inline: Column = F.array_sort(F.array_distinct(citations(F.col("answer"))))
    declared = F.array_sort("declared")
    fault = (
        F.when(F.size(odd_citations(F.col("answer"))) > 0, "odd_citation").when(F.size(inline) == 0, "no_citation").when(F.exists(inline, lambda c: (c < 1) | (c > F.col("n_evidence"))), "unknown_citation")
        .when(F.size("declared") != F.size(F.array_distinct("declared")), "repeated_citation").when(declared != inline, "undeclared_citation").otherwise("ok")
    )
    return answers.select("question_id", fault.alias("fault"))
