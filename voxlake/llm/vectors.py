"""Exact top-k by the threshold algorithm, and approximate neighbours by a hash-prefix forest, block against block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import stored, table

#: Rows of a block of candidates and of a block of queries, at most on average; both bound what a task holds.
BLOCK_ROWS, QUERY_ROWS = 16_384, 8192
#: A table is cut into more blocks than it needs as long as the cluster has free cores and blocks keep so many rows.
LEAST_ROWS = 2048
#: Trees and bits of a hash string.
TREES, BITS = 24, 48
#: The forest is calibrated on at most so many rows (least hashes first) and queries among them, to this recall.
SAMPLE_ROWS, SAMPLE_QUERIES, RECALL = 4096, 100, 0.96


def usable(vec: Column, nonzero: bool = False) -> Column:
    """Not null, no null and no non-finite component; with nonzero also some component that is not 0."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(~bad, F.lit(False))
    return ok & F.exists(vec, lambda x: x != 0) if nonzero else ok


def _blocked(vectors: DataFrame, is_query: Column, block_rows: int, query_rows: int, floors: DataFrame | None) -> DataFrame:
    """vectors (vec_id, vec) once for each block pair that it belongs to; see blockwise()."""
    n, q = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks, query_blocks = max(1, -(-n // block_rows), min(cores, n // min(LEAST_ROWS, block_rows))), max(1, -(-q // query_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    query_block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(query_blocks))
    every = lambda k: F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>")
    none = F.lit(None).cast("double")
    cand = vectors.select("vec_id", "vec", F.lit(False).alias("query"), none.alias("floor"), block.alias("b"), F.explode(every(query_blocks)).alias("q"))
    asks = vectors.filter(is_query)
    asks = asks.withColumn("floor", none) if floors is None else asks.join(floors, "vec_id", "left")
    quer = asks.select("vec_id", "vec", F.lit(True).alias("query"), "floor", F.explode(every(blocks)).alias("b"), query_block.alias("q"))
    return cand.unionByName(quer)


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], list[tuple[np.ndarray, np.ndarray]]]


def blockwise(vectors: DataFrame, is_query: Column, k: int, search: Search, best_first: str, score_type: str, block_rows: int, query_rows: int, floors: DataFrame | None = None) -> DataFrame:
    """Each query's k best rows among all others: every block of candidates meets every block of queries.

    Blocks hash vec_id, so equal or close vectors spread over all of them and no task holds more
    than a block of each kind. A task returns at most k rows for a query, and the last ranking
    sees k rows a block. A repeated vec_id counts once, with its smallest vector. floors (vec_id, floor):
    scores that a query's k best rows are known to reach.
    """
    pairs = _blocked(vectors, is_query, block_rows, query_rows, floors)
    kind = np.float64 if score_type == "double" else np.int64

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["query", "vec_id"], kind="stable")
        if df.duplicated(["query", "vec_id"]).any():
            df = df.assign(_t=[tuple(v) for v in df["vec"]]).sort_values(["query", "vec_id", "_t"], kind="stable").drop_duplicates(["query", "vec_id"])
        cand, quer = df[~df["query"]], df[df["query"]]
        if not len(cand) or not len(quer):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        width = max(map(len, df["vec"]))

        def matrix(vs: pd.Series) -> np.ndarray:
            out = np.zeros((len(vs), width), kind)
            for i, v in enumerate(vs):
                out[i, : len(v)] = v
            return out

        ids, qids = cand["vec_id"].to_numpy(), quer["vec_id"].to_numpy()
        found = search(matrix(cand["vec"]), ids, matrix(quer["vec"]), qids, quer["floor"].to_numpy(np.float64), k)
        return pd.DataFrame({
            "query_id": np.repeat(qids, [len(i) for i, _ in found]),
            "vec_id": np.concatenate([ids[i] for i, _ in found]),
            "score": np.concatenate([s for _, s in found]),
        })

    # pairs of blocks, not key values, are the groups: as many as the product, each of bounded size
    local = pairs.groupBy("b", "q").applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
    order = F.desc("score") if best_first == "high" else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def threshold_search(cand: np.ndarray, ids: np.ndarray, quer: np.ndarray, qids: np.ndarray, floors: np.ndarray, k: int, first_depth: int = 32) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fagin's threshold algorithm: one sorted list a dimension, read downwards in growing steps.

    A query reads each list from the end that its component favours. Every row met is scored at
    once; reading stops when the sum of what the lists still offer is below the kth score, or below a
    score that the query's k best rows are known to reach, so no unseen row can even tie.
    """
    n, width = cand.shape
    lists = np.argsort(cand, axis=0, kind="stable")
    values = np.take_along_axis(cand, lists, axis=0)
    out = []
    for q, qid, floor in zip(quer, qids, floors):
        dims = np.flatnonzero(q)
        rising = q[dims] < 0
        seen = np.zeros(n, bool)
        scores = np.zeros(n, cand.dtype)
        depth, read = min(first_depth, n), 0
        while True:
            rows = np.arange(read, depth)[:, None]
            at = np.where(rising, rows, n - 1 - rows)
            new = np.zeros(n, bool)
            if len(dims):
                new[lists[at, dims].ravel()] = True
            else:
                new[:] = True
            new &= ~seen
            if (fresh := np.flatnonzero(new)).size:
                scores[fresh] = cand[fresh] @ q
                seen[fresh] = True
            held = np.flatnonzero(seen & (ids != qid))
            if depth >= n or not len(dims):
                break
            last = np.where(rising, depth - 1, n - depth)
            bound = int(values[last, dims] @ q[dims])
            if bound < floor:  # false for a query without one
                break
            if len(held) >= k and bound < np.partition(scores[held], len(held) - k)[len(held) - k]:
                break
            read, depth = depth, min(int(1.3 * depth) + 1, n)
        out.append(_top(held, -scores[held], ids, k, scores))
    return out


def _top(held: np.ndarray, key: np.ndarray, ids: np.ndarray, k: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(held) > k:
        cut = np.partition(key, k - 1)[k - 1]
        held, key = held[key <= cut], key[key <= cut]
    best = held[np.lexsort((ids[held], key))[:k]]
    return best, scores[best]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Highest integer inner products of vectors (vec_id, embedding) after floor(scale * x) of each component.

    is_query: condition on vec_id. Returns query_id, rank, vec_id, score; ties go to the smaller vec_id.
    Null vectors, null or non-finite components and null ids take no part; missing trailing
    components count as 0; an empty vector scores 0. Scores must fit a long.
    """
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", ints.alias("vec"))
    # the kth score among a block's worth of ids, all rows of an id together, is a floor for every block's search
    parts = max(1, rows.count() // block_rows)
    part = rows.filter((F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)) == 0) | is_query)
    first = blockwise(part, is_query, k, threshold_search, "high", "long", block_rows, query_rows)
    floor = F.col("score").cast("double") - F.abs("score") * 2.0**-50  # never above the score
    floors = stored(first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), floor.alias("floor")), "floors")
    return blockwise(rows, is_query, k, threshold_search, "high", "long", block_rows, query_rows, floors)


def _forest(cand: np.ndarray, ids: np.ndarray, quer: np.ndarray, trees: int, bits: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each tree the sorted strings, the rows in their order, and the queries' strings."""
    rng = np.random.default_rng(seed)
    weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    built = []
    for _ in range(trees):
        lines = rng.standard_normal((cand.shape[1], bits))
        sides = cand @ lines
        middle = np.median(sides, axis=0)
        strings = (sides > middle) @ weights
        order = np.lexsort((ids, strings))
        built.append((strings[order], order, (quer @ lines > middle) @ weights))
    return built


def _ascent(built: list, row: int, bits: int):
    """The rows that the trees hold for a query, step by step from its longest matching prefix to none."""
    starts, ends = [], []
    for strings, _, asked in built:
        drop = np.arange(bits + 1, dtype=np.uint64)
        prefix = (asked[row] >> drop) << drop
        starts.append(np.searchsorted(strings, prefix, "left"))
        ends.append(np.searchsorted(strings, prefix + ((np.uint64(1) << drop) - np.uint64(1)), "right"))
    sizes = np.array(ends) - np.array(starts)  # tree, bits dropped
    for level in range(int(np.argmax(sizes.max(axis=0) > 0)), bits + 1):
        yield np.unique(np.concatenate([t[1][s[level] : e[level]] for t, s, e in zip(built, starts, ends)]))


def calibrated(sample: np.ndarray, k: int, trees: int = TREES, bits: int = BITS, recall: float = RECALL, queries: int = SAMPLE_QUERIES, seed: int = 11) -> float:
    """The share of a block's rows that the trees must offer, as measured on a sample against brute force.

    Sample rows that are queries go up their trees; for each share the step is taken at which a search would
    stop. The smallest share whose mean recall reaches the wanted one is the answer; 1 if none does.
    """
    n = len(sample)
    if n <= k + 1:
        return 1.0
    asked = np.unique(np.linspace(0, n - 1, min(queries, n)).astype(int))
    built = _forest(sample, np.arange(n), sample[asked], trees, bits, seed)
    shares = [min(1.0, 4 * k / n * 1.2**i) for i in range(200) if 4 * k / n * 1.2 ** (i - 1) < 1]
    total = np.zeros(len(shares))
    for row, a in enumerate(asked):
        far = ((sample - sample[a]) ** 2).sum(axis=1)
        far[a] = np.inf
        kth = np.partition(far, k - 1)[k - 1]
        steps = [(len(held), min(k, int((far[held] <= kth).sum())) / k) for held in _ascent(built, row, bits)]
        for i, share in enumerate(shares):
            total[i] += next((got for size, got in steps if size >= share * n), steps[-1][1])
    good = np.flatnonzero(total / len(asked) >= recall)
    return shares[good[0]] if len(good) else 1.0


def forest_search(share: float, trees: int = TREES, bits: int = BITS, seed: int = 11) -> Search:
    """A search by a hash-prefix forest that is built over a block's rows.

    Each tree draws directions; bit j of a row's string says on which side of the block's median
    its projection on direction j lies. The strings are sorted. A query goes down to its longest
    matching prefix in each tree, then all trees go up together, one bit a step, until they hold
    the wanted share of the block as distinct candidates. A step takes the whole range of a prefix, so
    rows that share a string stay together however many they are.
    """
    def search(cand: np.ndarray, ids: np.ndarray, quer: np.ndarray, qids: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(cand)
        built = _forest(cand, ids, quer, trees, bits, seed)
        want = min(n, max(int(np.ceil(share * n)), 4 * k))
        out = []
        for row, (q, qid) in enumerate(zip(quer, qids)):
            held = next(h for h in _ascent(built, row, bits) if len(h) >= want)  # the last step holds all rows
            held = held[ids[held] != qid]
            gap = cand[held] - q
            far = np.sqrt((gap * gap).sum(axis=1))
            scores = np.zeros(n)
            scores[held] = far
            out.append(_top(held, far, ids, k, scores))
        return out

    return search


def near_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, bits: int = BITS, recall: float = RECALL, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Approximately the k nearest rows (Euclidean, double precision) of vectors (vec_id, embedding) for each query.

    Every row is indexed, in the forest of its block; a query asks every block's forest, and exact
    distances decide. How much of a block the trees must offer is calibrated on SAMPLE_ROWS rows. Returns
    query_id, rank, vec_id, score; ties go to the smaller vec_id. Null or zero vectors, null or
    non-finite components and null ids take no part.
    """
    rows = vectors.filter(usable(F.col("embedding"), True) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    few = [r["vec"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(SAMPLE_ROWS).collect()]
    width = max(map(len, few), default=0)
    share = calibrated(np.array([[*v, *[0.0] * (width - len(v))] for v in few]).reshape(len(few), width), k, trees, bits, recall)
    return blockwise(rows, is_query, k, forest_search(share, trees, bits), "low", "double", block_rows, query_rows)


def op4_topk(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_ann(spark, sf_dir):
    return near_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
