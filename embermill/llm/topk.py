"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt by hash into shards.  A shard keeps one list per dimension,
sorted by component.  For a query, the lists are read from their better ends (by
the sign of the query's component) in rounds of growing depth; each vector met
for the first time is scored in full, and reading stops once the bound - the
inner product of the query with the components at the current depth - is below
the k-th score, so ties are settled by vec_id.  The shards' answers are merged.

A vector that is null, or holds null or non-finite components, takes no part;
nor does a null vec_id.  Repeated rows count once; a query's own vec_id is never
a candidate.  Vectors of another length than a query's are no candidates of it.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .shared import ship

HITS = "query_id long, vec_id long, score long"


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """(2, dimensions, rows): each dimension's rows from its largest component down, and from its smallest up."""
    up = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    return np.stack([np.ascontiguousarray(up[:, ::-1]), up])


def threshold_topk(
    x: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, scores) of the k best rows of ``x``, best first. ``lists``: of sorted_lists(x)."""
    n = len(x)
    used = np.flatnonzero(query)
    if not len(used):
        best_ids = np.sort(ids[ids != own])[:k]
        return best_ids, np.zeros(len(best_ids), np.int64)
    weights = query[used]
    end_of = (weights < 0).astype(int)
    seen = np.zeros(n, bool)
    best_ids, best = np.empty(0, np.int64), np.empty(0, x.dtype)
    depth, step = 0, max(8, k, n // 128)
    while depth < n:
        end = min(n, depth + step)
        part = lists[end_of, used, depth:end]
        fresh = np.zeros(n, bool)
        fresh[part.ravel()] = True
        fresh = np.flatnonzero(fresh & ~seen)
        seen[fresh] = True
        if len(fresh):
            ids_, scores = ids[fresh], x[fresh] @ query
            keep = ids_ != own
            best_ids = np.concatenate([best_ids, ids_[keep]])
            best = np.concatenate([best, scores[keep]])
            if len(best) > k:
                kth = np.partition(best, len(best) - k)[len(best) - k]
                top = best >= kth
                best_ids, best = best_ids[top], best[top]
                order = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[order], best[order]
        bound = x[part[:, -1], used] @ weights
        if len(best) == k and bound < best.min():
            break
        depth, step = end, step * 2
    order = np.lexsort((best_ids, -best))[:k]
    return best_ids[order], best[order].astype(np.int64)


def top_k(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, shard_rows: int = 16_384, query_rows: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs are (vec_id, v array<long>)."""
    spark = vectors.sparkSession
    ship(spark)
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / query_rows))
    left = vectors.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "vec_id",
        "v",
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block"),
        "vec_id",
        "v",
    )

    def search(_, own: pa.Table, asked: pa.Table) -> pa.Table:
        from embermill.llm.topk import sorted_lists, threshold_topk

        out: list[tuple] = []
        ids = own.column("vec_id").to_numpy()
        wide = np.array([len(v) for v in own.column("v")], np.int64)
        asks = list(zip(asked.column("vec_id").to_pylist(), asked.column("v").to_pylist()))
        for d in sorted({len(v) for _, v in asks}):
            here = np.flatnonzero(wide == d)
            if not len(here) or not d:
                continue
            x = own.column("v").combine_chunks().take(pa.array(here)).flatten().to_numpy().reshape(-1, d)
            largest = max(abs(int(x.min())), abs(int(x.max())))
            if d * largest * max(max(map(abs, v)) for _, v in asks if len(v) == d) < 1 << 53:
                x = x.astype(np.float64)  # whole numbers below 2**53: sums stay exact
            lists = sorted_lists(x)
            for name, v in asks:
                if len(v) == d:
                    found, scores = threshold_topk(x, ids[here], lists, np.array(v, x.dtype), name, k)
                    out += zip([name] * len(found), found.tolist(), scores.tolist())
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), without vectors that take no part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(sound)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform(v, lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"),
        )
        .distinct()
    )


def topk_digest(embeddings: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    vectors = whole_vectors(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k=k)
