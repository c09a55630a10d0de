"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs
and character n-grams (bytes of UTF-8), followed by a softmax over the two
labels; vectors and output are trained together by stochastic gradient descent
in numpy.  A word pair of equal words is one feature whatever the word.

Training takes place in one task on a bounded sample of labelled rows
(``SAMPLE_ROWS``, least by a hash of the id, so the same rows at every run and
size).  With two labels the trained model folds into one number for each
feature, a megabyte in all, so scoring gathers and averages numbers over the
whole text.  Only the text enters a score.

Defined results: null text counts as empty; an empty text gets the score of
the bias; with labels of one kind only the score is the smoothed share of
label 1, and without any label 1.0 (nothing speaks against a document); a
labelled id that repeats counts once, with its greatest label and least text; null labels and
ids are not learned from; repeated rows are each scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TABLES, chunks, free, map_arrow, table

SAMPLE_ROWS = 6144
BITS, DIM, EPOCHS, RATE = 18, 8, 8, 0.5
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
STEP_BYTES = 1 << 20
#: Feature of an equal word pair, before hashing.
SAME = np.uint64(0x9E3779B97F4A7C15)
BASE, INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 20)
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)])
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, INVERSE, np.uint64)])
        return cls.up[:n], cls.down[:n]

    @classmethod
    def clear(cls) -> None:
        cls.up = cls.down = np.ones(1, np.uint64)


TABLES.append(_Powers.clear)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * SAME) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (feature numbers, document numbers) of words, word pairs and n-grams."""
    raw = [t.encode("utf-8", "replace") + b" " for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    found = []
    space = SPACE[data]
    edge = np.diff(np.r_[True, space].view(np.int8))  # -1 where a word begins, 1 where it has ended
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _Powers.to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    word = (total[end] - total[start]) * down[start]
    of = doc[start]
    found.append((_bucket(word), of))
    if len(word) > 1:
        pair = np.where(word[:-1] == word[1:], SAME, word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:])
        inside = of[:-1] == of[1:]
        found.append((_bucket(pair[inside]), of[:-1][inside]))
    wide = data.astype(np.uint32)
    for n, factor in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        if len(data) >= n:
            gram = wide[: len(data) - n + 1].copy()
            for k in range(1, n):
                gram |= wide[k : len(data) - n + 1 + k] << np.uint32(8 * k)
            inside = doc[: len(gram)] == doc[n - 1 :]
            gram = (gram * np.uint32(factor)) >> np.uint32(32 - BITS)
            found.append((gram[inside].astype(np.int32), doc[: len(gram)][inside]))
    return found


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """The folded model, a number for each feature and the bias, from (features, shares) and labels 0 or 1."""
    n, ones = len(labels), int(labels.sum())
    if not 0 < ones < n:
        share = (ones + 1) / (n + 2) if n else 1 - 1e-9
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    epochs, step = max(EPOCHS, min(60, 40_000 // n)), 0
    for _ in range(epochs):
        for i in rng.permutation(n):
            rate = RATE * (1 - step / (epochs * n))
            step += 1
            ids, share = documents[i]
            rows = vectors[ids]
            hidden = share @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * 0.1 * p
            vectors[ids] = rows - (rate * len(ids) ** 0.5) * share[:, None] * back
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = features([text])
    ids, counts = np.unique(np.concatenate([f for f, _ in parts]), return_counts=True)
    return ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


def scores(texts: list[str], model: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, of in features(texts):
        total += np.bincount(of, model[ids], len(texts))
        count += np.bincount(of, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -60, 60)))


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Train on the documents of at most ``sample_rows`` labelled ids outside the held-out fold."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold() != HELD_OUT)
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # At most sample_rows rows of two numbers: a bounded broadcast.
    # An id that repeats has one row here, of its least text, however many there are.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")

    def featured(batches):
        for batch in batches:
            parts = [_shares(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[0].tobytes() for p in parts], pa.binary()), pa.array([p[1].tobytes() for p in parts], pa.binary())], names=["quality", "ids", "shares"]
            )

    def trained(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in (1, 2, 0)), strict=True)
        rows.sort()
        documents = [(np.frombuffer(ids, np.int32), np.frombuffer(shares, np.float32)) for ids, shares, _ in rows]  # in an order that arrival doesn't change
        model, bias = train(documents, np.array([label for _, _, label in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], names=["model", "bias"])

    rows = map_arrow(texts, featured, "quality int, ids binary, shares binary").repartition(1)
    got = map_arrow(rows, trained, "model binary, bias double").collect()
    if not got:
        return train([], np.zeros(0, np.int64))
    return np.frombuffer(got[0]["model"], "<f4"), got[0]["bias"]


def score(docs: DataFrame, model: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """The id, columns named in ``keep`` and the score, named ``out``, for every row."""
    named = [id_col, *keep]
    source = docs.select(*[F.col(f"`{c}`") for c in named], F.col(f"`{text_col}`").alias(free([*named, out], "text")[0]))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, len(named), STEP_BYTES):
                got = scores([x or "" for x in part.column(len(named)).to_pylist()], model, bias)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got)], names=[*named, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_arrow(source, run, f"{kinds}, `{out}` double")


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns, whatever else they are called."""
    others = [c for c in docs.columns if c != "text"]
    scored, found = free(docs.columns, "scored", "score")
    shadow = docs.withColumn(scored, F.col("text"))
    kept = score(shadow, *fit(docs, labels), id_col="text", text_col=scored, keep=tuple(others), out=found)
    return kept.where(F.col(found) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
