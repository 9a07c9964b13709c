"""Exact nearest vectors by inner product, with Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates whose per-dimension lists one task sorts, and queries that walk them.
SHARD_ROWS = 8192
QUERY_ROWS = 4096
FIRST_DEPTH = 16
HITS = "query_id long, vec_id long, score long"


def sorted_lists(vectors: np.ndarray) -> np.ndarray:
    """Row numbers by falling component, one list per dimension (a row of the result)."""
    return np.argsort(-vectors, axis=0, kind="stable").T.copy()


def threshold_search(
    query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the ``k`` best rows but ``own``; ties to the smaller id.

    Walks the lists of all dimensions in parallel, from the end that suits the sign of the
    query's component, and scores every row it meets. What no list has shown yet scores at
    most the sum over the components at the current depth; once the kth score is above that
    bound, the search is over. Depths double.
    """
    n = len(ids)
    used = np.flatnonzero(query)
    weights = query[used]
    up = weights > 0
    seen = np.zeros(n, bool)
    rows, scores = np.zeros(0, "i8"), np.zeros(0, "i8")
    depth, past = min(FIRST_DEPTH, n), 0
    while True:
        met = np.zeros(n, bool)
        if len(used):
            met[lists[used[up], past:depth].ravel()] = True
            met[lists[used[~up], n - depth : n - past].ravel()] = True
        else:
            met[:] = True
        fresh = np.flatnonzero(met & ~seen & (ids != own))
        seen |= met
        rows = np.concatenate((rows, fresh))
        scores = np.concatenate((scores, vectors[fresh] @ query))
        if len(rows) > k:
            best = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
        if depth >= n or not len(used):
            break
        edge = np.concatenate((lists[used[up], depth - 1], lists[used[~up], n - depth]))
        dims = np.concatenate((used[up], used[~up]))
        if len(rows) >= k and scores.min() > (vectors[edge, dims] * query[dims]).sum():
            break
        past, depth = depth, min(n, depth * 2)
    best = np.lexsort((ids[rows], -scores))
    return rows[best], scores[best]


def _search(k: int):
    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = ([], [], [])
        if len(queries) and len(shard):
            ids, vectors = shard["vec_id"].to_numpy(), np.stack(shard["vector"].to_list())
            lists = sorted_lists(vectors)
            for own, query in zip(queries["vec_id"].tolist(), queries["vector"]):
                rows, scores = threshold_search(np.asarray(query), own, ids, vectors, lists, k)
                out[0].append(np.full(len(rows), own))
                out[1].append(ids[rows])
                out[2].append(scores)
        columns = [np.concatenate(c) if c else np.zeros(0, "i8") for c in out]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def whole_numbers(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding",
                  scale: int = 256) -> DataFrame:
    """``vec_id, vector``: components as ``floor(scale * x)``; unusable vectors are left out.

    Unusable are NULL vectors and those with a NULL, NaN or infinite component, and rows
    without ``vec_id``. Rows repeated whole are taken once.
    """
    usable = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & usable)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("vector")).distinct()


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 5, *, shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best by inner product.

    Both tables are ``vec_id, vector`` of whole numbers. Candidates are every row with another
    id and the same number of components; ties go to the smaller id, and a query with fewer
    candidates gets them all. The queries are a stated set held against all rows in blocks: one
    block of each meet in a task, whose size the two parameters bound, and a task returns
    ``k`` rows per query. Blocks are dealt by a hash of id and vector. Empty tables give
    empty results.
    """
    spread = F.xxhash64("vec_id", "vector")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    n_shards = max(1, -(-vectors.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // query_rows))
    dims = F.size("vector").alias("dims")
    shards = vectors.select(
        "vec_id", "vector", dims, F.pmod(spread, F.lit(n_shards)).alias("shard"),
        numbers(n_blocks).alias("block"),
    )
    asked = queries.select(
        "vec_id", "vector", dims, F.pmod(spread, F.lit(n_blocks)).alias("block"),
        numbers(n_shards).alias("shard"),
    )
    cell = ("dims", "shard", "block")
    hits = asked.groupBy(*cell).cogroup(shards.groupBy(*cell)).applyInPandas(_search(k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` best of every ``every``-th vector against all others."""
    vectors = whole_numbers(embeddings)
    return top_k(vectors.filter(F.col("vec_id") % every == 0), vectors, k)
