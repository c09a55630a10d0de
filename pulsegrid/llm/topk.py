"""Exact top-k by inner product of integer vectors: a KD-tree in each shard.

Nodes are split at the median of their widest dimension and keep the tight box
of their points.  A query takes nodes best first by the greatest inner product
that any point of the box could have, and ends when no box can reach its kth
score.  Each query is searched in one shard of its own first; the kth score
found there goes with it to all the others, so most of their boxes are never
opened.  Scores are exact integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors as V
from .common import table

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 2048, 64
EXACT = 1 << 53  # doubles hold all integers up to here


def quantised(matrix: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole doubles."""
    return np.floor(matrix.astype(np.float64) * scale)


class Tree:
    """Boxes and children of all nodes; leaves are ranges of ``order``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.low, self.high, self.children, self.range = [], [], [], []
        self._grow(0, len(points))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points = np.ascontiguousarray(points[self.order])

    def _grow(self, begin: int, end: int) -> int:
        own = self.points[self.order[begin:end]]
        low, high = own.min(0), own.max(0)
        node = len(self.range)
        self.low.append(low)
        self.high.append(high)
        self.range.append((begin, end))
        self.children.append(())
        if end - begin > LEAF_ROWS and (high > low).any():
            middle = (end - begin) // 2
            self.order[begin:end] = self.order[begin:end][np.argpartition(own[:, np.argmax(high - low)], middle)]
            self.children[node] = (self._grow(begin, begin + middle), self._grow(begin + middle, end))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product in each box, for each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def _dot(points: np.ndarray, query: np.ndarray, whole: bool) -> list[int]:
    if whole:
        return (points @ query).astype(np.int64).tolist()
    return [sum(int(a) * int(b) for a, b in zip(p, query, strict=True)) for p in points]  # beyond 2^53


def search(tree: Tree, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: list) -> list[list[tuple[int, int]]]:
    """For each query its best (score, vec_id), at most ``k``, not below its floor (None: no floor)."""
    if not len(ids):
        return [[] for _ in query_ids]
    size = queries.shape[1] * max(1.0, np.abs(tree.points).max()) * max(1.0, np.abs(queries).max())
    whole = size < EXACT
    bounds = tree.bounds(queries) + (0 if whole else size * 1e-9)  # rounding must not lower a bound
    owner = ids[tree.order]
    out = []
    for at, (own, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        bound, best, floor = bounds[at].tolist(), [], floors[at]
        heap = [(-bound[0], 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -reach < least:
                break
            if children := tree.children[node]:
                for child in children:
                    if least is None or bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            begin, end = tree.range[node]
            scores = _dot(tree.points[begin:end], query, whole)
            for score, vec_id in zip(scores, owner[begin:end].tolist(), strict=True):
                if vec_id != own and (floor is None or score >= floor):
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec_id))
                    elif (score, -vec_id) > best[0]:
                        heapq.heapreplace(best, (score, -vec_id))
        out.append([(score, -vec_id) for score, vec_id in best])
    return out


FOUND = "query_id bigint, vec_id bigint, score bigint"
LONG = (1 << 63) - 1


def _searcher(k: int, scale: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, score, vec_id = [], [], []
        if left.num_rows and right.num_rows:
            ids, points, _ = V.rows_of(left, "vec_id", "vector")
            own, queries, right = V.rows_of(right, "query_id", "query")
            found = search(Tree(quantised(points, scale)), ids, own, quantised(queries, scale), k, right.column("floor").to_pylist())
            for q, rows in zip(own.tolist(), found, strict=True):
                query_ids += [q] * len(rows)
                score += [max(-LONG, min(LONG, s)) for s, _ in rows]
                vec_id += [v for _, v in rows]
        return pa.table([pa.array(query_ids, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(df: DataFrame, k: int, query_every: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` greatest inner products of each query (ids divisible by ``query_every``) over all rows but its own.

    Columns ``query_id``, ``rank``, ``vec_id``, ``score``.
    """
    vectors, queries, shards, blocks = V.deal(V.usable(df, id_col, vector_col), query_every, SHARD_ROWS, BLOCK_ROWS)
    run = _searcher(k, scale)
    at_home = queries.withColumn("floor", F.lit(None).cast("long"))
    first = vectors.groupBy("dim", "shard").cogroup(at_home.groupBy("q_dim", "home")).applyInArrow(run, FOUND)
    if shards == 1:
        return V.nearest(first, k)
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") == k, F.col("floor")).alias("floor"))
    away = V.every(queries.join(floors, "query_id", "left"), "q_shard", shards).where("q_shard <> home")
    spread = V.every(vectors, "v_block", blocks).groupBy("dim", "shard", "v_block")
    rest = spread.cogroup(away.groupBy("q_dim", "q_shard", "block")).applyInArrow(run, FOUND)
    return V.nearest(first.unionByName(rest), k)


def op7_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
