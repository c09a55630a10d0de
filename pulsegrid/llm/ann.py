"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each of
``BOOKS`` codebooks.  The codebooks start as k-means of successive residuals
and are then fitted jointly (least squares over all books, given beam-search
codes).  They are fitted on at most ``SAMPLE_ROWS`` vectors, least by a hash of
the id; every vector is encoded by beam search over residuals and keeps the
ratio of its norm to its code's norm.  A query scores a shard with lookup
tables (a sum of ``BOOKS`` numbers, times the stored ratio); the ``RERANK``
best of each shard are scored again exactly, in double precision on the
original vectors.

See ``vectors`` for the defined results; zero vectors take no part either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors as V
from .common import table

SAMPLE_ROWS = 16_384
BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 4, 1
RERANK = 512
SHARD_ROWS, BLOCK_ROWS = 16_384, 1024
STEP = 512


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin((centre**2).sum(1) - 2 * (part @ centre.T), 1) for part in np.array_split(x, -(-len(x) // 4096))])
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
    return centre.astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows by books) that beam search over residuals finds."""
    count, words, _ = books.shape
    squares = (books**2).sum(2)
    out = np.empty((len(x), count), np.uint8)
    for begin in range(0, len(x), STEP):
        part = x[begin : begin + STEP]
        n = len(part)
        residual, codes, error = part[:, None, :], np.zeros((n, 1, 0), np.uint8), (part**2).sum(1)[:, None]
        for m in range(count):
            cost = error[:, :, None] + squares[m] - 2 * (residual @ books[m].T)
            width = min(beam, cost.shape[1] * words)
            flat = cost.reshape(n, -1)
            pick = np.argpartition(flat, width - 1, 1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
            parent, word = pick // words, pick % words
            row = np.arange(n)[:, None]
            error = flat[row, pick]
            residual = residual[row, parent] - books[m][word]
            codes = np.concatenate([codes[row, parent], word[:, :, None].astype(np.uint8)], 2)
        best = np.argmin(error, 1)
        out[begin : begin + n] = codes[np.arange(n), best]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def fit(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """Codebooks (books by words by dimension) for the rows of ``x``."""
    rng = np.random.default_rng(seed)
    words = int(min(WORDS, max(1, len(x) // 4)))
    books, residual = [], x.astype(np.float32)
    for _ in range(BOOKS):
        books.append(_k_means(residual, words, rng))
        near = np.concatenate([np.argmin((books[-1] ** 2).sum(1) - 2 * (part @ books[-1].T), 1) for part in np.array_split(residual, -(-len(residual) // 4096))])
        residual = residual - books[-1][near]
    books = np.stack(books)
    for _ in range(ROUNDS):
        column = encode(x, books).astype(np.int64) + np.arange(BOOKS) * words
        pairs, right = np.zeros((BOOKS * words,) * 2), np.zeros((BOOKS * words, x.shape[1]))
        for a in range(BOOKS):
            np.add.at(right, column[:, a], x)
            for b in range(BOOKS):
                np.add.at(pairs, (column[:, a], column[:, b]), 1)
        ridge = np.eye(len(pairs)) * 1e-2
        start = books.reshape(-1, x.shape[1])  # unused words stay as they are
        books = np.linalg.solve(pairs + ridge, right + 1e-2 * start).reshape(books.shape).astype(np.float32)
    return books


def _codebooks(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Codebooks for each dimension in a bounded sample, fitted in one task."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("dim", "vec_id", "vector")

    def train(batches):
        batches = list(batches)
        if batches:
            rows = pa.Table.from_batches(batches)
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims):
                _, x, _ = V.rows_of(rows.filter(pa.array(dims == dim)), "vec_id", "vector")
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([fit(x.astype(np.float32)).astype("<f4").tobytes()], pa.binary())], names=["dim", "books"])

    found = sample.repartition(1).mapInArrow(train, "dim int, books binary").collect()
    return {r["dim"]: np.frombuffer(r["books"], "<f4").reshape(BOOKS, -1, r["dim"]) for r in found}


def index(vectors: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with ``codes`` (a byte for each book) and ``ratio``, its norm to its code's norm.

    A dimension that no sampled vector had has no codes; such vectors are all reranked.
    """
    names = vectors.columns

    def run(batches):
        for batch in batches:
            rows = batch.column(names.index("vector")).to_pylist()
            codes, ratio = [None] * len(rows), np.ones(len(rows), np.float32)
            dims = np.array([len(r) for r in rows])
            for dim in np.unique(dims):
                if dim in books:
                    at = np.flatnonzero(dims == dim)
                    x = np.array([rows[i] for i in at], np.float32)
                    code = encode(x, books[dim])
                    norm = np.sqrt((decode(code, books[dim]) ** 2).sum(1))
                    ratio[at] = np.sqrt((x**2).sum(1)) / np.where(norm > 0, norm, 1)
                    for i, c in zip(at, code, strict=True):
                        codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(ratio)], names=[*names, "codes", "ratio"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kinds}, codes binary, ratio float")


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` greatest, ties to the first."""
    if len(scores) <= most:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - most)[len(scores) - most]
    above = np.flatnonzero(scores > least)
    return np.r_[above, np.flatnonzero(scores == least)[: most - len(above)]]


def search(ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None, ratio: np.ndarray, books: np.ndarray | None, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
    """Yields the query, the places of its ``k`` best rows and their exact scores; ``ids`` ascend."""
    wide, exact = x.astype(np.float64), queries.astype(np.float64)
    for begin in range(0, len(queries), 32):
        part = queries[begin : begin + 32].astype(np.float32)
        if codes is not None:
            rough = np.zeros((len(part), len(ids)), np.float32)
            for m in range(len(books)):
                rough += np.take(part @ books[m].T, codes[:, m], axis=1)
            rough *= ratio
        for i in range(len(part)):
            at = _best(rough[i], rerank + 1) if codes is not None else np.arange(len(ids))
            at = at[ids[at] != query_ids[begin + i]]
            score = (wide[at] * exact[begin + i]).sum(1)
            order = np.lexsort((ids[at], -score))[:k]
            yield int(query_ids[begin + i]), at[order], score[order]


def approximate_nearest(df: DataFrame, k: int, query_every: int, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """The ``k`` nearest found of each query (ids divisible by ``query_every``): ``query_id``, ``rank``, ``vec_id``, ``score``."""
    vectors = V.usable(df, id_col, vector_col, nonzero=True)
    books = _codebooks(vectors)
    vectors, queries, shards, blocks = V.deal(vectors, query_every, SHARD_ROWS, BLOCK_ROWS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, vec_id, score = [], [], []
        if left.num_rows and right.num_rows:
            ids, x, left = V.rows_of(left, "vec_id", "vector")
            own, queries, _ = V.rows_of(right, "query_id", "query")
            book = books.get(x.shape[1])
            codes = None
            if book is not None:
                codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            for q, at, s in search(ids, x, codes, left.column("ratio").to_numpy(), book, own, queries, k, rerank):
                query_ids += [q] * len(at)
                vec_id.append(ids[at])
                score.append(s)
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table([pa.array(query_ids, pa.int64()), pa.array(flat(vec_id, np.int64)), pa.array(flat(score, np.float64))], names=["query_id", "vec_id", "score"])

    indexed = V.every(index(vectors, books), "v_block", blocks)
    asked = V.every(queries.drop("home"), "q_shard", shards)
    found = indexed.groupBy("dim", "shard", "v_block").cogroup(asked.groupBy("q_dim", "q_shard", "block")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    return V.nearest(found, k)


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)
