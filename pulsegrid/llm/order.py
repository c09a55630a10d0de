"""Training-order materialisation: sequences written to disk in a keyed random order.

Every sequence has a dense number (its part of the staged table, then its row
there).  A keyed Feistel network permutes ``[0, 4^b)``, the least such range
that holds all numbers; a result beyond the number of sequences is permuted
again until it falls inside (cycle-walking), which makes a permutation of the
numbers themselves.  The result is the global slot; nothing is sorted or drawn.

A shard is a range of ``SHARD_ROWS`` slots and one file of fixed-stride
records: a sequence's ids, padded.  So slot ``s`` is in shard ``s // SHARD_ROWS``
at byte ``(s % SHARD_ROWS) * stride``; training reads files from end to end and
resumes at any slot without an index.  Files are written under another name and
then renamed, so a task that is run again replaces nothing by half.  Shards are
made in waves of slot ranges, so only a part of the table is in shuffle at once.

Defined results: null text is empty; every document ends with the separator id
and so has a sequence; repeated rows and rows with null ids have sequences of
their own; an empty table makes no file; other columns are not looked at.
"""

from __future__ import annotations

import functools
import gc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, dropped, shared_dir, table, written

LENGTH, WIDTH = 256, 2  # ids of a record, bytes of an id
SHARD_ROWS, WAVES, ROUNDS = 8192, 4, 6
STEP_BYTES = 1 << 22
KEY = 0x5EED
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def feistel(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of ``[0, n)`` at ``numbers``."""
    half = U(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (U(1) << half) - U(1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) ^ U(key))
    out = numbers.astype(U)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        out[walk] = left << half | right
        walk = walk[out[walk] >= U(n)]
    return out.astype(np.int64)


@functools.lru_cache(2)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sequences(docs: DataFrame, path: str, pattern: str, separator: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the separator in pieces of ``length``: the id, ``piece``, ``ids`` (binary), and ``part`` and ``row``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    step, kind = WIDTH * length, f"<u{WIDTH}"

    def run(batches):
        own, part_no, row = _encoding(path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in chunks(batch, 1, STEP_BYTES):
                of, piece, ids = [], [], []
                for i, text in enumerate(part.column(1)):
                    raw = np.array([*own.encode_ordinary(text.as_py() or ""), separator], kind).tobytes()
                    cut = [raw[k : k + step] for k in range(0, len(raw), step)]
                    of += [i] * len(cut)
                    piece += range(len(cut))
                    ids += cut
                n = len(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(ids, pa.binary()), pa.array(np.full(n, part_no, np.int32)), pa.array(np.arange(row, row + n))], names=["doc_id", "piece", "ids", "part", "row"]
                )
                row += n

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, piece int, ids binary, part int, row bigint")


def shard_name(shard: int) -> str:
    return f"shard-{shard:012d}.bin"


def materialise(seqs: DataFrame, folder: str, key: int = KEY, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """Write ``seqs`` to fixed-stride shards below ``folder`` (a URI that pyarrow opens) and return their index.

    One row per sequence: ``slot``, ``shard``, ``byte_offset``, ``doc_id``,
    ``piece``, ``n_tokens``, ``ids_crc32`` (of the ids as they stand in the file).
    """
    spark = seqs.sparkSession
    staged = written(seqs, "sequences")
    counts = sorted((r["part"], r["n"]) for r in staged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row for each input partition
    base, total = {}, 0
    for part, n in counts:
        base[part], total = total, total + n
    kind = staged.schema["doc_id"].dataType.simpleString()
    names = ["shard", "slot", "doc_id", "piece", "ids"]
    stride = WIDTH * length
    shards = -(-total // SHARD_ROWS)

    def placed(low: int, high: int):
        def run(batches):
            for batch in batches:
                begin = np.array([base[p] for p in batch.column(3).to_pylist()], np.int64)
                slot = feistel(begin + batch.column(4).to_numpy(), total, key)
                keep = pa.array((slot // SHARD_ROWS >= low) & (slot // SHARD_ROWS < high))
                yield pa.RecordBatch.from_arrays([pa.array(slot // SHARD_ROWS), pa.array(slot), *batch.columns[:3]], names=names).filter(keep)

        return run

    def write(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("slot")
        shard, slot = rows.column("shard")[0].as_py(), rows.column("slot").to_numpy()
        filler = np.full(length, pad, f"<u{WIDTH}").tobytes()
        raw = rows.column("ids").to_pylist()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        path, attempt = f"{root}/{shard_name(shard)}", f"{root}/.{shard_name(shard)}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(attempt) as out:
            out.write(b"".join(x + filler[len(x) :] for x in raw))
        fs.move(attempt, path)
        return pa.table({
            "slot": slot, "shard": rows.column("shard"), "byte_offset": (slot % SHARD_ROWS) * stride, "doc_id": rows.column("doc_id"), "piece": rows.column("piece"),
            "n_tokens": pa.array([len(x) // WIDTH for x in raw], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
        })

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    index = None
    step = max(1, -(-shards // WAVES))
    schema = f"slot bigint, shard bigint, byte_offset bigint, doc_id {kind}, piece int, n_tokens bigint, ids_crc32 bigint"
    for low in range(0, max(1, shards), step):
        wave = staged.mapInArrow(placed(low, low + step), f"shard bigint, slot bigint, doc_id {kind}, piece int, ids binary")
        done = written(wave.groupBy("shard").applyInArrow(write, schema), "index")
        index = done if index is None else index.unionByName(done)
        del wave
        gc.collect()
        spark._jvm.System.gc()  # the wave's shuffle files go before the next wave's come
    dropped(spark, staged)
    return index


def read_from(folder: str, slot: int = 0, length: int = LENGTH):
    """Yields (slot, padded ids) in training order from ``slot`` on: one seek, then sequential reads."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    stride = WIDTH * length
    while fs.get_file_info(f"{root}/{shard_name(slot // SHARD_ROWS)}").type == pyarrow.fs.FileType.File:
        with fs.open_input_file(f"{root}/{shard_name(slot // SHARD_ROWS)}") as f:
            f.seek(slot % SHARD_ROWS * stride)
            while raw := f.read(stride):
                yield slot, np.frombuffer(raw, f"<u{WIDTH}")
                slot += 1
        if slot % SHARD_ROWS:  # the last shard is shorter
            return


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    seqs = sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, separator=50256)
    return materialise(seqs, f"{shared_dir(spark)}/training-order")
