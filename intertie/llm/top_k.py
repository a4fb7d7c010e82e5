"""Exact top-k search by inner product, reading sorted lists without random access.

Each dimension of a block of vectors is a sorted list; for a query it is read
from the end that contributes most. After each round of reading, a vector's
score lies between two bounds: what has been read of it, plus the least and
the most that its unread entries can give. A block's search for a query stops
when no vector outside its best k can still qualify; their final scores are
then resolved. All queries of a block of queries read in the same rounds, so a
round is a few matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sums of products below this are exact in double precision.
EXACT = 2.0**53


def best_of_block(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vector_ids: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of the k best vectors of a block for each query, ties to the smaller id.

    A query's own vector is left out; vectors and queries are integers.
    """
    n, width = vectors.shape
    order = np.argsort(vector_ids, kind="stable")
    vectors, vector_ids = vectors[order], vector_ids[order]
    lists = np.sort(vectors, axis=0)
    rank = np.argsort(np.argsort(vectors, axis=0, kind="stable"), axis=0, kind="stable")
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    least = positive @ lists[0] + negative @ lists[-1]
    out: list[tuple[int, int, int]] = []
    open_queries = np.arange(len(queries))
    depth = max(1, n // 8)
    while len(open_queries):
        depth = min(depth, n)
        # Read so far: the ``depth`` largest entries of a list, or the smallest where the query is negative.
        top, bottom = rank >= n - depth, rank < depth
        p, m = positive[open_queries], negative[open_queries]
        known = p @ np.where(top, vectors, 0).T + m @ np.where(bottom, vectors, 0).T
        frontier = p @ np.where(top, 0, lists[n - depth]).T + m @ np.where(bottom, 0, lists[depth - 1]).T
        floor = p @ np.where(top, 0, lists[0]).T + m @ np.where(bottom, 0, lists[-1]).T
        own = query_ids[open_queries][:, None] == vector_ids[None, :]
        lower = np.where(own, -np.inf, known + floor)
        upper = np.where(own, -np.inf, known + frontier)
        del known, frontier, floor
        still = []
        for row, query in enumerate(open_queries.tolist()):
            kept = min(k, n)
            bound = np.partition(lower[row], n - kept)[n - kept]
            can = np.flatnonzero((upper[row] >= bound) & (upper[row] > -np.inf))
            # Stop when hardly more than k can qualify, or all is read; then resolve what is left.
            if depth < n and len(can) > 4 * k:
                still.append(query)
                continue
            scores = vectors[can] @ queries[query]
            best = np.lexsort((vector_ids[can], -scores))[:k]
            out += [(int(query_ids[query]), int(vector_ids[can[b]]), int(scores[b])) for b in best]
        open_queries = np.array(still, np.int64)
        depth *= 2
    return out


def search(
    vectors: DataFrame,
    is_query: str,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    vector_block: int = 8192,
    query_block: int = 512,
) -> DataFrame:
    """The ``k`` best rows for every row that satisfies ``is_query``: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components become ``floor(scale * x)``. Vectors that are null or hold
    nulls or non-finite components, and rows without an id, take no part;
    vectors of another length than the query's are no candidates; an empty
    vector scores 0 with other empty ones. Repeated rows of an id are separate
    candidates, but none of them for that id's own queries. Every block of
    queries meets every block of vectors once; of each pair only k rows a query
    go on. Scores are exact: a block whose products could exceed 2**53 fails
    the job rather than round.
    """
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    usable = (
        F.col(vector_col).isNotNull()
        & F.col(id_col).isNotNull()
        & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    rows = vectors.where(usable).select(
        F.col(id_col).alias("id"), F.size(vector_col).alias("width"), whole.alias("v"), F.expr(is_query).alias("q")
    )
    n = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks, query_blocks = max(1, -(-n[0] // vector_block)), max(1, -(-n[1] // query_block))
    held = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit("v")), F.lit(blocks)).cast("int"))
    asked = rows.where("q").withColumn("query_block", F.pmod(F.xxhash64("id", F.lit("q")), F.lit(query_blocks)).cast("int"))
    numbers = lambda count: F.sequence(F.lit(0), F.lit(count - 1))
    left = asked.withColumn("block", F.explode(numbers(blocks))).select("block", "query_block", "width", "id", "v")
    right = held.withColumn("query_block", F.explode(numbers(query_blocks))).select(
        "block", "query_block", "width", "id", "v"
    )
    keys = ["block", "query_block", "width"]

    def work(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(candidates):
            a, b = np.stack(queries["v"].to_numpy()), np.stack(candidates["v"].to_numpy())
            if a.shape[1] and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
                raise ValueError("components are too large for exact scores")
            # Repeated query rows ask the same.
            ids, first = np.unique(queries["id"].to_numpy(), return_index=True)
            found = best_of_block(a[first], ids, b, candidates["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        work, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: dict[int, list[float]], queries: list[int], k: int, scale: int = 256) -> Iterator[tuple]:
    """The same for few vectors held in memory; for tests."""
    whole = {i: np.floor(scale * np.asarray(v, np.float64)) for i, v in vectors.items()}
    for q in sorted(queries):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        for rank, (score, i) in enumerate(scores[:k], 1):
            yield q, rank, i, -score
