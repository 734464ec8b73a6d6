"""Soft-membership mixing: fitted document rates whose expected domain token totals match targets. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import forget, stored, table

#: Most labelled rows that the classifier is fitted on (least hash first).
LABELLED = 50_000
STEPS = 25
#: A word of the lexicon stands in so many of its labelled texts and has such log-odds for some domain, at least; the strongest are kept.
SUPPORT, STRONG, LEXICON = 5, 2.0, 50_000
#: Domains and their target shares of all tokens, for the registered query.
TARGETS = {"low": 0.10, "high": 0.88, "toxic": 0.02}


TRAITS = ("size", "blanks", "lines", "symbols", "stops", "per_line", "repeats")


def traits(text: Column) -> list[Column]:
    """TRAITS of a whole text: its log size, shares of blanks, symbols and sentence ends, lines, their size, bytes above ASCII."""
    size = F.length(text)
    gone = lambda part: (size - F.length(F.replace(text, F.lit(part))))
    share = lambda n: n / (size + 1)
    symbols = F.length(F.regexp_replace(text, r"[^%$&*#|@~^]+", ""))
    lines = gone("\n")
    return [
        F.log1p(size), share(gone(" ")), F.log1p(lines), F.least(share(symbols) * 10, F.lit(2.0)),
        share(gone(". ")) * 10, F.log1p(size / (lines + 1)), F.log1p(F.greatest(F.lit(0), F.octet_length(text) - size)),
    ]


def token_count(text: Column) -> Column:
    """Words of a text, which blanks of any kind and number part; 0 for a blank or null text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def words_of(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text. No lambda: one would keep the explosion of words out of generated code."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def fit_words(docs: DataFrame, few: DataFrame, domains: list[str]) -> DataFrame:
    """(word, odds): the log-odds of a text that holds the word for each domain against all others, from the rows of few (doc_id, domain)."""
    seen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    got = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(got.values())
    held = seen.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    held = held.groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]).filter(F.col("n") >= SUPPORT)
    odds = []
    for i, d in enumerate(domains):
        own, rest = got.get(d, 0), total - got.get(d, 0)
        gap = F.log((F.col(f"n{i}") + 0.5) / (own + 1.0)) - F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (rest + 1.0))
        odds.append(gap if own and rest else F.lit(0.0))
    return held.select("word", F.array(*odds).alias("odds")).filter(F.array_max("odds") >= STRONG).orderBy(F.desc(F.array_max("odds")), "word").limit(LEXICON)


def with_words(rows: DataFrame, docs: DataFrame, lexicon: DataFrame, domains: list[str]) -> DataFrame:
    """rows of measured() whose x goes on with the text's strongest word for each domain: its log-odds, 0 without one.

    Equal texts hold equal words, so words are summed up by text and joined back by the text's hash.
    """
    found = docs.select(F.xxhash64("text").alias("text_hash"), F.explode(words_of(F.col("text"))).alias("word")).join(F.broadcast(lexicon), "word")
    found = found.groupBy("text_hash").agg(F.array(*[F.greatest(F.lit(0.0), F.max(F.col("odds")[i])) for i in range(len(domains))]).alias("_w"))
    none = F.array(*[F.lit(0.0) for _ in domains])
    return rows.join(found, "text_hash", "left").withColumn("x", F.concat("x", F.coalesce("_w", none))).drop("_w", "text_hash")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, text_hash and x (the traits, as an array) of each row; a null text is an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", token_count(text).alias("tokens"), F.xxhash64("text").alias("text_hash"), F.array(*[c.cast("double") for c in traits(text)]).alias("x"))


def few_labelled(labelled: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, domain, fits_words) of at most `limit` labelled ids; words are fitted on one half, by hash, and their weight is judged on the other."""
    few = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return few.withColumn("fits_words", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)) == 0)


def fit_posteriors(rows: DataFrame, few: DataFrame, domains: list[str]) -> tuple[list, list, list]:
    """(prior logs, means, deviations a domain) of a naive Gaussian classifier over the traits and the strongest words.

    rows: as from with_words; few: as from few_labelled. Aggregation alone fits it; the driver gets one row a domain. What the
    lexicon was fitted on does not count for the words, unless a domain has nothing else. A domain
    without rows gets a prior of almost nothing.
    """
    width = len(TRAITS) + len(domains)
    seen = rows.select("doc_id", "x").join(F.broadcast(few), "doc_id")
    fresh = lambda i: F.col("x")[i] if i < len(TRAITS) else F.when(~F.col("fits_words"), F.col("x")[i])
    both = lambda f, i: F.coalesce(f(fresh(i)), f(F.col("x")[i]))
    got = {r["domain"]: r for r in seen.groupBy("domain").agg(F.count("*").alias("n"), *[both(F.avg, i).alias(f"m{i}") for i in range(width)], *[both(F.stddev_pop, i).alias(f"s{i}") for i in range(width)]).collect()}
    total = sum(r["n"] for r in got.values()) or 1
    prior = [float(np.log((got[d]["n"] if d in got else 1e-3) / total)) for d in domains]
    mean = [[float(got[d][f"m{i}"]) if d in got else 0.0 for i in range(width)] for d in domains]
    dev = [[max(0.05, float(got[d][f"s{i}"])) if d in got else 1.0 for i in range(width)] for d in domains]
    return prior, mean, dev


def with_posteriors(rows: DataFrame, fit: tuple[list, list, list]) -> DataFrame:
    """(doc_id, tokens, p): p is the array of domain posteriors, summing to 1, for x. Each step is a projection of its own, so that nothing is computed twice."""
    logs = []
    for prior, mean, dev in zip(*fit):
        z = F.lit(prior)
        for i, (m, s) in enumerate(zip(mean, dev)):
            z = z - ((F.col("x")[i] - m) / s) * ((F.col("x")[i] - m) / s) / 2 - float(np.log(s))
        logs.append(z)
    names = [f"z{i}" for i in range(len(logs))]
    z = [F.col(n) for n in names]
    scored = rows.select("doc_id", "tokens", *[log.alias(n) for log, n in zip(logs, names)])
    top = scored.withColumn("top", F.greatest(*z) if len(z) > 1 else z[0])
    raw = top.select("doc_id", "tokens", *[F.exp(c - F.col("top")).alias(n) for c, n in zip(z, names)])
    return raw.withColumn("total", reduce(lambda a, b: a + b, z)).select("doc_id", "tokens", F.array(*[c / F.col("total") for c in z]).alias("p"))


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS) -> list[list[float]]:
    """Pulls a step: projected-gradient least squares for rates >= 0 of rows (tokens, p).

    Minimises the squared gap between sum(rate * tokens * p) and targets * all tokens, measured in the
    metric of the inverse token-weighted Gram matrix of posteriors, so that small domains count
    as much as large ones and the step length 1 is right. Each step is one distributed sum; the
    driver keeps a few numbers a domain. Rates start at 1 and move by a row's posterior-weighted
    pulls; after each step they are projected on rates >= 0.
    """
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    gram = rows.agg(*[F.sum(F.col("tokens") * p[i] * p[j]) for i in range(k) for j in range(k)], F.sum("tokens")).first()
    total = float(gram[-1] or 0)
    if total <= 0:
        return []
    matrix = np.array([float(v or 0) for v in gram[:-1]]).reshape(k, k) / total
    metric = np.linalg.inv(matrix + 1e-9 * np.eye(k))
    pulls: list[list[float]] = []
    for _ in range(steps):
        got = rows.agg(*[F.sum(rate_of(pulls) * F.col("tokens") * q) for q in p]).first()
        gap = np.array([float(v or 0) for v in got]) / total - np.array(targets)
        if np.abs(gap).max() < 1e-5:
            break
        pulls.append((metric @ -gap).tolist())
    return pulls


def rate_of(pulls: list[list[float]]) -> Column:
    """A row's rate after the pulls, each followed by the projection on rates >= 0."""
    if not pulls:
        return F.lit(1.0)
    steps = F.array(*[F.array(*map(F.lit, v)) for v in pulls])
    dot = lambda v: reduce(lambda a, b: a + b, [v[i] * F.col("p")[i] for i in range(len(pulls[0]))])
    return F.aggregate(steps, F.lit(1.0), lambda w, v: F.greatest(F.lit(0.0), w + dot(v)))  # a fold: nested expressions fail at some hundred steps


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else high or low by quality; rows without both labels are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS, budget: float = 1.0) -> DataFrame:
    """doc_id, tokens, posteriors (one column p_<domain> each) and rate for every row of docs (doc_id, text).

    labelled: (doc_id, domain). A rate is how often a row should be taken; expected token totals
    of the domains, sum(rate * tokens * p), then match targets times budget times all tokens as nearly
    as rates >= 0 allow. Null and empty texts have no tokens, and a rate like any other row; null or
    repeated ids are rows of their own; without labelled rows posteriors follow the tiny equal
    priors; an empty table gives an empty result; other columns are ignored.
    """
    domains = sorted(targets)
    share = sum(targets.values())
    few = stored(few_labelled(labelled), "labelled")
    lexicon = stored(fit_words(docs, few.filter("fits_words"), domains), "lexicon")
    base = stored(with_words(measured(docs), docs, lexicon, domains), "measures")
    rows = stored(with_posteriors(base, fit_posteriors(base, few, domains)), "posteriors")
    forget(base)
    pulls = fit_rates(rows.select("tokens", "p"), [budget * targets[d] / share for d in domains], steps)
    return rows.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], rate_of(pulls).alias("rate"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float) -> DataFrame:
    """docs with each row taken floor(rate + u) times, u a hash of its doc_id in [0, 1); the columns stay.

    Repeated ids use the mean of their rates, a null id is taken once.
    """
    rates = mixing_rates(docs, labelled, targets, budget=budget).groupBy("doc_id").agg(F.avg("rate").alias("_rate"))
    u = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    take = F.floor(F.coalesce("_rate", F.lit(1.0)) + F.when(F.col("_rate").isNull(), 0.0).otherwise(u)).cast("int")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id")  # whole rows, whatever their columns are called
    times = packed.join(rates, "doc_id", "left").withColumn("_n", take).filter("_n > 0")
    return times.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*")


def op7_mixing(spark, sf_dir):
    return mixing_rates(table(spark, sf_dir, "documents"), domains_of_labels(table(spark, sf_dir, "labels")))
