"""Byte-level BPE, encoded and decoded by DuckDB inside each partition.

Encoding: the pre-tokens that a partition has not met yet become rows of byte
tokens by position.  A recursive query joins neighbouring tokens with the merge
table and contracts, in each word, the leftmost pair of least rank until no
word has a pair left.  Results are kept (a bounded memo: the work follows the
number of different words), and a document's ids are those of its
pre-tokens in order.  Decoding: token-position rows join the vocabulary and
an ordered aggregation joins the bytes.

The vocabulary file's path is a parameter; its content (50 thousand ranks and
their splits) is a fixed size and is loaded once by each Python worker.

Defined results: null text counts as empty, and an empty text has no ids and
decodes to no bytes; rows with repeated or null ids are each encoded; other
columns are not looked at.
"""

from __future__ import annotations

import base64
import functools

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

#: Words encoded in one recursive query, words kept by a worker, token rows decoded in one query, bytes of text per step.
WORDS, KEPT, DECODED, STEP_BYTES = 100_000, 250_000, 200_000, 1 << 22

ENCODE = """
WITH RECURSIVE step(word, ids, done) AS (
    SELECT word, list(id ORDER BY pos), false FROM start GROUP BY word
  UNION ALL
    SELECT s.word,
           CASE WHEN least.spot IS NULL THEN s.ids ELSE s.ids[:least.spot - 1] || [least.merged] || s.ids[least.spot + 2:] END,
           least.spot IS NULL
    FROM (SELECT word, ids FROM step WHERE NOT done) s LEFT JOIN (
        SELECT word, arg_min(spot, rank * 4294967296 + spot) AS spot, min(rank)::INT AS merged
        FROM (SELECT word, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, unnest(range(1, len(ids))) AS spot FROM step WHERE NOT done)
        JOIN merges USING (a, b)
        GROUP BY word
    ) least USING (word)
)
SELECT word, ids FROM step WHERE done ORDER BY word
"""

DECODE = "SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


def _database(name: str, rows: pa.Table) -> duckdb.DuckDBPyConnection:
    """An in-memory database of bounded size that holds one table."""
    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
    db.execute("SET preserve_insertion_order = false")
    db.register("rows", rows)
    db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
    db.unregister("rows")
    return db


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """The merge table of one file, and the ids of the pre-tokens met lately."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = _ranks(path)
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        splits = ((ranks.get(t[:i]), ranks.get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t)))
        a, b, rank = np.array([x for x in splits if x[0] is not None and x[1] is not None], np.int64).T
        self.db = _database("merges", pa.table({"a": a.astype(np.int32), "b": b.astype(np.int32), "rank": rank}))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], "<i4")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        self.db.register("start", pa.table({"word": word.astype(np.int32), "pos": pos.astype(np.int32), "id": ids}))
        lists = self.db.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("start")
        flat, ends = lists.values.to_numpy().astype("<u4").tobytes(), lists.offsets.to_numpy() * 4
        return [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not kept yet."""
        out, rest = {}, []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:  # a pre-token of the vocabulary is one token
                out[w] = whole.to_bytes(4, "little")
            else:
                rest.append((w, raw))
        rest.sort(key=lambda x: len(x[1]))  # words of like length need like numbers of steps
        for i in range(0, len(rest), WORDS):
            part = rest[i : i + WORDS]
            out.update(zip((w for w, _ in part), self._contract([raw for _, raw in part]), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        if len(self.kept) > KEPT:  # words not met since the last change of the memo are forgotten
            self.kept, self.old = {}, self.kept
        new = set().union(*split).difference(self.kept)
        if again := {w: self.old[w] for w in new if w in self.old}:
            self.kept |= again
            new -= again.keys()
        if new:
            self.kept.update(self.learn(new))
        get = self.kept.__getitem__
        return [b"".join(map(get, words)) for words in split]


class Decoder:
    """The vocabulary of one file."""

    def __init__(self, path: str):
        ranks = _ranks(path)
        self.db = _database("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids; long lists are decoded in slices."""
        out: list[list[bytes]] = [[] for _ in ids]
        rows, sizes, total = [], [], 0

        def flush():
            nonlocal rows, sizes, total
            if rows:
                flat = np.concatenate([r for _, r in rows])
                begin = np.cumsum(sizes) - sizes
                self.db.register("tokens", pa.table({
                    "doc": np.repeat(np.arange(len(rows), dtype=np.int32), sizes),
                    "pos": (np.arange(len(flat)) - np.repeat(begin, sizes)).astype(np.int32),
                    "id": flat.astype(np.int32),
                }))
                found = dict(self.db.execute(DECODE).fetchall())
                self.db.unregister("tokens")
                for k, (doc, _) in enumerate(rows):
                    out[doc].append(found[k])
            rows, sizes, total = [], [], 0

        for doc, raw in enumerate(ids):
            tokens = np.frombuffer(raw, "<u4")
            for i in range(0, len(tokens), DECODED):
                part = tokens[i : i + DECODED]
                if total + len(part) > DECODED:
                    flush()
                rows.append((doc, part))
                sizes.append(len(part))
                total += len(part)
        flush()
        return [b"".join(parts) for parts in out]


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for part in chunks(batch, 1, STEP_BYTES):
                ids = own.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[id_col, "ids", "n_tokens"]
                )

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids binary, n_tokens bigint")


def decode_bpe(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with a further column ``decoded`` (binary)."""
    at = tokens.columns.index(ids_col)

    def run(batches):
        own = decoder(path)
        for batch in batches:
            for part in chunks(batch, at, 4 * DECODED):
                raw = own.decode([x or b"" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{kinds}, decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = decode_bpe(encode_bpe(table(spark, sf_dir, "documents"), *how), how[0])
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
