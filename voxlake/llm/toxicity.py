"""Toxicity scores from non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import small_batches, table

#: Bounds of the training sample (documents with a positive label; documents of any kind), least hash first.
POSITIVES, UNLABELLED = 4000, 8000
#: Most features of a model.
FEATURES = 4096
#: Features must be this much more frequent among positives than in unlabelled text; it keeps out the words of a language.
LIFT = 3.0
#: And stand in so many texts of the sample.
SUPPORT = 3
STEMS = (4, 5)
EDGES = ".,;:!?\"'()[]{}|*%$&#-_…«»“”"


def features_of(text: str | None) -> set[str]:
    """Distinct lower-cased words of a whole text; as `n:` their first n letters; as `n+` those that two or more distinct words begin with."""
    words = {w.strip(EDGES) for w in set((text or "").lower().split())}
    found = set(words)
    for k in STEMS:
        stems = Counter(w[:k] for w in words if len(w) > k)
        found.update([f"{k}:{s}" for s in stems])
        found.update([f"{k}+{s}" for s, n in stems.items() if n > 1])
    return found


@dataclass
class NnPuModel:
    """Averaged linear classifiers over the presence of features."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1))
    constant: float | None = 0.0

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        found = sorted(self.index[f] for f in features_of(text) & self.index.keys())
        z = self.bias + self.weights[:, found].sum(axis=1)
        return float(np.mean(1 / (1 + np.exp(-np.clip(z, -40, 40)))))


def _sums(w: np.ndarray, cols: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=w[cols], minlength=n)


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, seed: int = 0, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)).

    Each argument row lists the features that a text has. Logistic loss, Adam on the full batch;
    where the corrected negative risk is below zero, its gradient is ascended, as non-negative
    PU learning does. The seed draws nine tenths of the rows, so that members of an ensemble differ.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: [x for x in xs if rng.random() < 0.9] or xs
    positive, unlabelled = pick(positive), pick(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    both = positive + unlabelled
    cols = np.concatenate(both).astype(np.int64) if both else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(both)), [len(x) for x in both])
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    is_p = np.arange(len(both)) < n_p
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        z = _sums(theta, cols, rows, len(both)) + theta[-1]
        p = sigmoid(z)
        neg_loss = np.logaddexp(0, z)
        corrected = neg_loss[~is_p].mean() - prior * neg_loss[is_p].mean()
        up, un = np.where(is_p, prior * (p - 1) / n_p, 0), np.where(is_p, -prior * p / n_p, p / n_u)
        g_row = up + un if corrected >= 0 else -un
        g = np.append(np.bincount(cols, weights=g_row[rows], minlength=width), g_row.sum())
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def matched_bias(weights: np.ndarray, bias: float, unlabelled: list[np.ndarray], prior: float) -> float:
    """The bias with which the mean score of unlabelled texts is the class prior."""
    z = np.array([weights[x].sum() for x in unlabelled])
    low, high = bias - 40, bias + 40
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(-np.clip(z + mid, -40, 40)))).mean() < prior else (low, mid)
    return (low + high) / 2


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """(text, is_p) of the bounded training sample, and the share of label 1 among the labels that may be learnt."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda ids, n: ids.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(n)
    prior = known.agg(F.avg("toxic").alias("share")).first()["share"]
    pos = first(known.filter("toxic = 1").select("doc_id").join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), positives)
    unl = first(docs.select("doc_id").filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).distinct(), unlabelled)
    ids = pos.select("doc_id", F.lit(1).alias("is_p")).unionByName(unl.select("doc_id", F.lit(0).alias("is_p")))
    ids = ids.groupBy("doc_id").agg(F.max("is_p").alias("p"), (F.min("is_p") == 0).cast("int").alias("u"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "p", "u"), float(prior or 0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, members: int = 3) -> NnPuModel:
    """Fit on at most `positives` confirmed toxic texts and `unlabelled` texts whose labels are not looked at.

    Both come from rows outside the held-out fold. Feature choice (rates among positives against
    unlabelled) is a distributed count; the driver gets at most FEATURES names and the sample's
    feature numbers. Without positives or texts the model scores a constant: the prior, or 0.
    """
    sample, prior = _sampled(small_batches(docs), labels, positives, unlabelled)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, u, n = Counter(), Counter(), [0, 0]
        for df in frames:
            for text, is_p, is_u in zip(df["text"], df["p"], df["u"]):
                found = features_of(text)
                if is_p:
                    p.update(found)
                if is_u:
                    u.update(found)
                n[0] += is_p
                n[1] += is_u
        rows = [(f, p[f], u[f]) for f in p.keys() | u.keys()] + [(None, n[0], n[1])]
        yield pd.DataFrame(rows, columns=["f", "p", "u"])

    counts = sample.mapInPandas(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    sizes = sample.agg(F.sum("p").alias("p"), F.sum("u").alias("u")).first()
    n_p, n_u = int(sizes["p"] or 0), int(sizes["u"] or 0)
    if not n_p or not n_u or prior <= 0:
        return NnPuModel(constant=prior)
    prior = min(prior, 0.9)
    rate_p, rate_u = F.col("p") / n_p, F.col("u") / n_u
    spread = F.sqrt(rate_u * (1 - rate_u) / n_u + rate_p * (1 - rate_p) / n_p + 1 / (n_p * n_u))
    chosen = (
        counts.filter(f"f is not null and p + u >= {SUPPORT}").select("f", "p", "u", ((rate_p - rate_u) / spread).alias("z"))
        .filter((F.col("z") >= 1 + 1.4 * np.log10(n_p)) & (rate_p >= LIFT * rate_u)).orderBy(F.desc("z"), "f").limit(FEATURES).collect()
    )
    index = {r["f"]: i for i, r in enumerate(sorted(chosen, key=lambda r: (-r["z"], r["f"])))}
    if not index:
        return NnPuModel(constant=prior)

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            cols = [sorted(index[f] for f in features_of(t) & index.keys()) for t in df["text"]]
            yield pd.DataFrame({"p": df["p"], "u": df["u"], "cols": cols})

    rows = sample.mapInPandas(numbered, "p int, u int, cols array<int>").collect()
    rows.sort(key=lambda r: (r["p"], r["u"], list(r["cols"])))
    as_array = lambda r: np.array(r["cols"], np.int64)
    pos, unl = [as_array(r) for r in rows if r["p"]], [as_array(r) for r in rows if r["u"]]
    fits = [train_nnpu(pos, unl, len(index), prior, seed) for seed in range(members)]
    return NnPuModel(index, np.array([w for w, _ in fits]), np.array([matched_bias(w, b, unl, prior) for w, b in fits]), None)


def score_toxicity(docs: DataFrame, model: NnPuModel, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted added (columns of these names are replaced); only `text` is looked at.

    Null and empty texts get the score of a text without features; long texts are read whole; repeated
    rows get equal scores; an empty table gives an empty result.
    """
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that the model scores at or above the threshold; the columns stay."""
    cols = docs.columns
    scored = score_toxicity(docs.select(F.struct(*cols).alias("_row"), "text"), fit_toxicity(docs, labels), threshold)
    return scored.filter("predicted = 0").select("_row.*")


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
