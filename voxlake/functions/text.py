"""Text functions: Unicode folding, language evidence, framing, search offsets. Column expressions unless marked as Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CJK = "[\\u4e00-\\u9fff]"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """NFC form; null stays null. Arrow UDF, as Spark has no normalisation function."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """NFC form, then full case folding (ß becomes ss); null stays null. Computed once a document, never a query."""
    return texts.map(lambda t: t if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFC", t).casefold())


def register(spark: SparkSession) -> None:
    """The fold and nfc functions for SQL."""
    spark.udf.register("fold", fold)
    spark.udf.register("nfc", nfc)


def tag_name_key(name: Column) -> Column:
    return fold(F.trim(name))


def strip(text: Column | str) -> Column:
    """Text without white space of any kind, and without separators, at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def visible(text: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(text, r"\s", ""))


def cjk_ratio(text: Column) -> Column:
    """Share of U+4E00-9FFF among the visible characters; 0 without any."""
    n = visible(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(CJK)) / n).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """A double to some digits, halves away from zero, by its binary value as C and DuckDB do it; F.round goes by its decimal digits (41 / 640 is a little less than 0.0640625)."""
    scale = float(10**digits)
    return F.round(x * scale, 0) / scale


def script_ratio(text: Column, traditional: str, simplified: str) -> Column:
    """Traditional-only hits among traditional-only and simplified-only ones; 0.5 without either."""
    trad, simp = (F.regexp_count(text, F.lit(f"[{s}]")) for s in (traditional, simplified))
    return F.when(trad + simp > 0, trad / (trad + simp)).otherwise(F.lit(0.5))


def occurrences(field: Column, term: Column | str) -> Column:
    """Non-overlapping places of a term in a field; 0 for an empty term or null field."""
    term = F.lit(term) if isinstance(term, str) else term
    hits = (F.length(field) - F.length(F.replace(field, term, F.lit("")))) / F.length(term)
    return F.coalesce(F.when(F.length(term) > 0, hits.cast("long")), F.lit(0).cast("long"))


def marker_score(text: Column, markers: Sequence[str]) -> Column:
    """Hits of all markers for each hundred visible characters; 0 without any."""
    n, hits = visible(text), F.lit(0)
    for m in markers:
        hits = hits + occurrences(text, m)
    return F.when(n > 0, hits * 100.0 / n).otherwise(F.lit(0.0))


def nonsense_ratio(text: Column) -> Column:
    """Share of white-space tokens of one or two characters without CJK; 1 without tokens."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    short = F.filter(tokens, lambda t: (F.length(t) <= 2) & ~t.rlike(CJK))
    return F.when(F.size(tokens) > 0, F.size(short) / F.size(tokens)).otherwise(F.lit(1.0))


def canonical_language(code: Column) -> Column:
    """BCP-47 case of primary-Script-REGION; empty for anything else."""
    shape = r"^\s*([A-Za-z]{2,3})(?:[-_]([A-Za-z]{4}))?(?:[-_]([A-Za-z]{2}|[0-9]{3}))?\s*$"
    part = lambda k: F.regexp_extract(code, shape, k)
    named = F.concat_ws("-", F.lower(part(1)), F.when(part(2) != "", F.initcap(part(2))), F.when(part(3) != "", F.upper(part(3))))
    return F.coalesce(F.when(code.rlike(shape), named), F.lit(""))


def is_chinese(code: Column) -> Column:
    return F.coalesce(F.split_part(F.lower(code), F.lit("-"), F.lit(1)).isin("zh", "yue", "cmn"), F.lit(False))


def output_language(code: Column) -> Column:
    """What a default summary of a text in this language is written in."""
    return F.when(is_chinese(code), "zh-Hant").otherwise("en")


def original_language(code: Column) -> Column:
    """The language of a summary in the source's own language; empty if that is unknown."""
    own = canonical_language(code)
    return F.when(own == "", "").when(is_chinese(own), "zh-Hant").otherwise(own)


def is_output_identity(code: Column) -> Column:
    """Whether a code may name a summary's language: canonical, not `und`, Chinese only as zh-Hant."""
    own = canonical_language(code)
    return F.coalesce((own != "") & (own == F.trim(code)) & (own != "und") & (~is_chinese(own) | (own == "zh-Hant")), F.lit(False))


def excerpt(text: Column, limit: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def frame(parts: Sequence[Column]) -> Column:
    """Each part as N (null) or S<bytes>:<text>, one after the other: equal only for equal parts."""
    return F.concat(*[F.when(p.isNull(), F.lit("N")).otherwise(F.concat(F.lit("S"), F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts])


def content_hash(parts: Sequence[Column]) -> Column:
    return F.sha2(frame(parts), 256)


def join_nonblank(parts: Column, separator: str = "\n") -> Column:
    """Array of strings as one text, blank ones left out."""
    return F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), separator)


def sanitize_error(text: Column, limit: int = 200) -> Column:
    """Paths masked (a slash behind a word character begins none), trimmed, then cut to limit characters."""
    masked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)(?<!\w)/[\w./\\-]+", "<path>")
    return F.substring(F.regexp_replace(masked, r"(?U)^\s+|\s+\z", ""), 1, limit)


def error_detail(text: Column, limit: int = 200) -> Column:
    """The first line that starts with `Error:` and the two after it, else the last line; blank lines do not count. Sanitised."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).startswith("error:")), True)
    picked = F.when(at > 0, F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), 3)).otherwise(F.slice(lines, F.greatest(F.size(lines), F.lit(1)), 1))
    return sanitize_error(F.array_join(picked, " | "), limit)


def error_category(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("timeout") | low.contains("timed out"), "timeout").when(low.contains("not found") | low.contains("no such"), "missing")
        .when(low.contains("memory"), "resources").otherwise("other")
    )


def citations(answer: Column) -> Column:
    """Cited evidence numbers in order of appearance, repeats kept; see odd_citations() for what else looks like one."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[C(\d+)\]"), 1), lambda x: x.cast("int"))


def odd_citations(answer: Column) -> Column:
    """Brackets whose trimmed content begins with C and is no evidence number: `[C]`, `[Cx]`, `[C 1]`, `[C1, C2]`."""
    inside = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([^\]]*)\]"), 1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))
    return F.filter(inside, lambda x: x.startswith("C") & ~x.rlike(r"^C[0-9]+\z"))
