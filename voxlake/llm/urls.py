"""URL rules and listed-URL filtering with a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"
WORDS = 4  # 64-bit words of a block
#: The filter never has more blocks than this, whatever the list's length, so its broadcast is at most 2**17 rows of 40 bytes; beyond some 4 million keys more and more rows pass it and the join decides.
BLOCKS = 1 << 17


def url_host(url: Column) -> Column:
    """Text between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without a leading `www.`, then the path without closing slashes; null where there is no host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def _masks() -> list[Column]:
    """Two bits in each word of the key's block, from the bits of the second hash, _h2."""

    def bit(at: int) -> Column:
        return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h2, {at}) & 63L as int))")

    return [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(WORDS)]


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    return (
        df.withColumn("_h2", F.xxhash64("_key", F.lit(1)))
        .withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)))
        .withColumns({f"_m{i}": m for i, m in enumerate(_masks())})
    )


def bloom_blocks(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Blocked Bloom filter over the column _key: one row per used block with WORDS 64-bit words; at most `blocks` rows."""
    return _hashed(listed, blocks).groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(WORDS)])


def listed_keys(pages: DataFrame, listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """pages (with _key) plus a boolean _listed: whether _key is among listed._key.

    The filter passes possible hits; only those are shuffled to the exact join, which removes
    false positives. Null keys are never listed. listed must hold distinct keys.
    """
    listed = listed.filter(F.col("_key").isNotNull()).select("_key")
    probe = _hashed(pages, blocks).join(F.broadcast(bloom_blocks(listed, blocks)), "_block", "left")
    maybe = F.lit(True)
    for i in range(WORDS):
        maybe = maybe & (F.col(f"_w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}"))
    probe = probe.withColumn("_maybe", F.col("_key").isNotNull() & F.coalesce(maybe, F.lit(False))).select(*pages.columns, "_maybe")
    exact = probe.filter("_maybe").join(listed.withColumn("_hit", F.lit(True)), "_key", "left")
    cols = pages.columns
    return (
        probe.filter(~F.col("_maybe")).select(*cols, F.lit(False).alias("_listed"))
        .unionByName(exact.select(*cols, F.coalesce("_hit", F.lit(False)).alias("_listed")))
    )


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, or nulls.

    rules: (verdict, host, path), a short list given by the caller. A rule fits its host and all
    subdomains where the url's path starts with the rule's. Of two equally long, the longer host,
    then the smaller text wins.
    """
    text = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], blocks: int = BLOCKS) -> DataFrame:
    """Judge every row of pages (page_id, url) by rules first and by the list of blocked canonical URLs else.

    listed: one column `canonical`. Returns page_id, host, path, canonical, listed, rule, verdict; one row
    for each row of pages. A null or odd url has empty host and path, no canonical form, and is allowed.
    Empty tables give empty results; other columns of pages are ignored, whatever their names.
    """
    base = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    base = base.withColumn("_key", canonical_url(F.col("host"), F.col("path")))
    out = listed_keys(base, listed.select(F.col("canonical").alias("_key")).distinct(), blocks)
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    return out.select(
        "page_id", "host", "path", F.col("_key").alias("canonical"), F.col("_listed").alias("listed"), rule.alias("rule"),
        F.coalesce(said, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"),
    )


def repeated_urls(pages: DataFrame) -> DataFrame:
    """The canonical URLs that more than one page carries: the list that the registered query blocks."""
    key = canonical_url(url_host(F.col("url")), url_path(F.col("url")))
    return pages.select(key.alias("canonical")).filter("canonical is not null").groupBy("canonical").count().filter("count > 1").select("canonical")


#: The query's rules: (verdict, host, path).
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def op8_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, repeated_urls(pages), RULES)


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical FROM parts),
counted AS (SELECT *, canonical IS NOT NULL AND count(*) OVER (PARTITION BY canonical) > 1 AS listed FROM keyed),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM counted)
SELECT page_id, host, path, canonical, listed, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
       WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
