"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into segments; from each segment's mean and deviation follows a lower bound of the distance between two
vectors, ``|q-c|^2 >= sum len * ((mq-mc)^2 + (sq-sc)^2)``.  Both lengths are known, so that is the same as an upper bound of the
inner product, ``q.c <= sum len * (mq*mc + sq*sc)``.  Bounds are taken from coarse to fine, each only for candidates that the
one before has left, and exact products only for the survivors of the finest.

Queries are a stated subset.  Blocks of queries meet blocks of candidates, one pair of blocks to a group, so a group never
grows with the table; blocks are dealt by a hash of the id, so equal vectors spread evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

LEVELS = (1, 4, 16)  # segments at each resolution
QUERY_GROUP = 32  # queries that share one set of surviving candidates inside a block


def whole_components(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, in double arithmetic; null unless all components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def segment_features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that the product of two rows is the bound of their inner product."""
    edges = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(vectors, edges[:-1], axis=1) / size
    square = np.add.reduceat(vectors * vectors, edges[:-1], axis=1) / size
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean * np.sqrt(size), deviation * np.sqrt(size)], axis=1)


def block_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> list[tuple]:
    """The k best candidates of every query inside a block, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, candidates = ids[order], candidates[order]
    top = max(1, int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1]))
    kind = np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object  # exact in each case
    q_exact, c_exact = queries.astype(kind), candidates.astype(kind)
    q_real, c_real = queries.astype(np.float64), candidates.astype(np.float64)
    q_parts, c_parts = [[segment_features(x, s) for s in LEVELS] for x in (q_real, c_real)]
    # rounding: mean * mean cancels, so a bound may be off by a part in 2**26 of the largest product
    slack = 1e-6 * (1 + np.sqrt((q_real**2).sum(1)) * np.sqrt((c_real**2).sum(1).max(initial=0)))
    found = []
    for start in range(0, len(queries), QUERY_GROUP):
        rows = slice(start, start + QUERY_GROUP)
        own = query_ids[rows][:, None] == ids[None, :]
        bound = np.where(own, -np.inf, q_parts[0][rows] @ c_parts[0].T)
        seeds = np.argpartition(-bound, min(2 * k, len(ids) - 1), axis=1)[:, :2 * k]
        seeds = np.unique(seeds)
        score = (q_exact[rows] @ c_exact[seeds].T).astype(np.float64)
        score[own[:, seeds]] = -np.inf
        least = np.sort(score, axis=1)[:, -k] if len(seeds) >= k else np.full(len(score), -np.inf)
        floor = (least - slack[rows])[:, None]
        left = np.flatnonzero((bound >= floor).any(0))
        for finer in range(1, len(LEVELS)):
            bound = q_parts[finer][rows] @ c_parts[finer][left].T
            left = left[(bound >= floor).any(0)]
        exact = q_exact[rows] @ c_exact[left].T
        for i, q in enumerate(query_ids[rows]):
            use = np.flatnonzero(~own[i, left])
            values = exact[i, use]
            if len(use) > k:
                use = use[values >= np.partition(values, len(values) - k)[len(values) - k]]
                values = exact[i, use]
            best = sorted(zip((-values).tolist(), ids[left[use]].tolist()))[:k]
            found += [(int(q), int(c), int(-v)) for v, c in best]
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256,
          least_blocks: int = 64, most_rows: int = 16_384, least_rows: int = 1_024) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest integer inner products of every query with all other rows.

    Blocks have ``least_rows`` to ``most_rows`` candidates, so that there are ``least_blocks`` of them if possible; the rule only
    shapes the work.  Rows whose vector is null, empty or holds a null or non-finite component, or whose id is null, take no
    part; an id that occurs more than once counts once, with its smallest vector; only vectors of equal length meet; other
    columns are not read; an empty table gives no rows.  Components are 64-bit integers.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_components(F.col(vector), scale).alias("vector"),
                          is_query.alias("asks")).where("vec_id is not null and size(vector) > 0")
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    n, asked = vectors.select(F.count(F.lit(1)), F.count_if(is_query)).first()
    size = min(most_rows, max(least_rows, n // least_blocks))
    blocks, query_blocks = max(1, -(-n // size)), max(1, -(-asked // size))
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = F.xxhash64("vec_id")
    dim = F.size("vector").alias("dim")
    sides = rows.select(dim, F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), numbers(query_blocks).alias("query_block"),
                        F.lit(False).alias("asks"), "vec_id", "vector").unionByName(
        rows.where("asks").select(dim, numbers(blocks).alias("block"), F.pmod(dealt, F.lit(query_blocks)).cast("int").alias("query_block"),
                                  F.lit(True).alias("asks"), "vec_id", "vector"))

    def pair(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        ids = group.column("vec_id").to_numpy()
        data = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        best = block_top(ids[asks], data[asks], ids[~asks], data[~asks], k) if asks.any() and not asks.all() else []
        columns = list(zip(*best)) or [[], [], []]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns)})

    best = sides.groupBy("dim", "query_block", "block").applyInArrow(pair, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
