"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A bin is filled greedily, always with the longest unpacked piece that fits.
If space is left, the bin's smallest piece is taken out again when two unpacked
pieces fit the expanded gap more tightly.  Only lengths matter, so the unpacked
pieces of a group are a bit mask of lengths and a stack for each length, and a
bin takes a few operations on the mask whatever the size of the group.

Groups are of bounded size (``GROUP_DOCS`` documents on average), chosen by a
hash over the row and its number in the scan, so that no source, id or row
that repeats makes a large one; each group leaves at most one ill-filled
sequence, so the loss against one global packing vanishes as groups are many
times a sequence.  The number is that of a row in its part of the table's
files, so a retried task gives its rows the same groups.

Defined results: null text is empty; every document ends with the separator id
and so has a piece; repeated rows are packed each; rows with null ids too;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, map_arrow, table, trim
from .words import word_ids

CAPACITY = 2048
SEPARATOR = 0
GROUP_DOCS = 32_768
STEP_BYTES = 1 << 21


def best_two_fit(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each length (each 1 to ``capacity``)."""
    stacks: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        stacks[n].append(i)
    mask = 0
    for n in stacks:
        mask |= 1 << n
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def fit(room: int) -> int:
        """The greatest unpacked length that fits, or 0."""
        return (mask & ((2 << room) - 1)).bit_length() - 1 if room > 0 and mask & ((2 << room) - 1) else 0

    def take(n: int) -> int:
        nonlocal mask
        item = stacks[n].pop()
        if not stacks[n]:
            mask ^= 1 << n
        return item

    made = 0
    while mask:
        n = mask.bit_length() - 1
        content, gap = [(n, take(n))], capacity - n
        while n := fit(gap):
            content.append((n, take(n)))
            gap -= n
        if gap and len(content) > 1:
            least = content[-1][0]
            room, best, pair = gap + least, least, None
            a = fit(room - 1)
            while a and 2 * a > best:
                b = fit(min(a, room - a))
                if b == a and len(stacks[a]) < 2:
                    b = fit(a - 1)
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = fit(a - 1)
            if pair:
                n, item = content.pop()
                stacks[n].append(item)
                mask |= 1 << n
                content += [(n, take(n)) for n in pair]
        at = 0
        for n, item in content:
            bins[item], offsets[item] = made, at
            at += n
        made += 1
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each document's ids and separator, cut into pieces of ``capacity`` where longer.

    Columns: the id, ``piece`` (from 0), ``start`` (ids before it), ``length``,
    ``ids`` (binary, little-endian unsigned 32-bit); with ``digest`` the CRC-32
    of these bytes, ``ids_crc32``, in their place.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    end, step = SEPARATOR.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        own = word_ids(path)
        for batch in batches:
            for part in chunks(batch, 1, STEP_BYTES):
                row, piece, ids = [], [], []
                for i, raw in enumerate(own.encode([x or "" for x in part.column(1).to_pylist()])):
                    cut = [(raw + end)[k : k + step] for k in range(0, len(raw) + 4, step)]
                    row += [i] * len(cut)
                    piece += range(len(cut))
                    ids += cut
                number = np.array(piece, np.int32)
                last = pa.array(list(map(zlib.crc32, ids)), pa.int64()) if digest else pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array([len(x) // 4 for x in ids], pa.int64()), last],
                    names=[id_col, "piece", "start", "length", name],
                )

    name = "ids_crc32" if digest else "ids"
    return map_arrow(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, piece int, start bigint, length bigint, {name} {'bigint' if digest else 'binary'}")


def pack_pieces(pieces: DataFrame, documents: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    ``documents``: how many documents the pieces come from; it sets the number of groups.
    """
    groups = max(1, math.ceil(documents / GROUP_DOCS))
    names = pieces.columns
    at = names.index("length")
    keyed = pieces.withColumn("__group", F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(groups)))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(n, "ascending") for n in names])
        bins, offsets = best_two_fit(rows.column(at).to_pylist(), capacity)
        trim()
        group = pc.cast(rows.column("__group"), pa.int64()).to_numpy()
        return pa.table([*(rows.column(n) for n in names), pa.array((group << 32) + bins), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return keyed.groupBy("__group").applyInArrow(pack, f"{kinds}, sequence_id bigint, offset bigint")


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's rows for ``docs``: the ids become a checksum before anything is shuffled."""
    import public_tokenizers

    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)
    return pack_pieces(pieces, docs.count())


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"))
