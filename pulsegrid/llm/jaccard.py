"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Its parity sketch XORs every hash into one of many cells (and a single bit of
it into a bit sketch).  A shingle that only one of two documents has touches
one cell, so the number of unequal cells, and of unequal bits, is at most the
symmetric difference, which is at most ``(a + b) / 7`` for two sets of sizes
``a`` and ``b`` that are 75 % similar.

Per size band (sizes ``[2^g, 2^(g+1))``; a set whose partners may be in the next
band joins that one too) all documents have the same cells, little more than
the bound needs, so that most cells hold several shingles.  By the pigeonhole
principle two linked documents agree in one of the first ``d + 1`` cells of
either, in any order of cells that all documents share, ``d`` being the bound
above for the largest possible partner.  The order takes cells that are
frequent in a sample of documents last (the sample is a hint about order and
never decides a result), cells of many shingles first (few documents share
them by a passage), then goes by a hash.  Candidates are pruned by size and by
the bit sketches (larger ones fold to smaller ones) and verified on whole sets.

Documents that share a cell value form a run.  Pairs of a run are not made:
its members are compared with one of them first, and linked documents become
components.  Runs that still hold more than one component are compared block
by block inside tasks; pairs within a component need no comparison, and only
pairs that size and sketches let link leave the task.  So no link is lost, and
a group of copies costs its size.

Defined results: null and empty texts, and texts without words, have an empty
set and are linked with nothing; exact copies are linked whatever their number;
rows that share an id are one node; rows with a null id are linked with
nothing and have a null component; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TABLES, chunks, dropped, map_arrow, partitions, spread_join, table, written
from .graph import components

SHINGLE = 5
PERCENT = 75
STEP_BYTES = 1 << 20
#: A hint about frequent cells comes from so many documents; a cell is frequent if so many of them have it.
SAMPLE_DOCS, FREQUENT = 8192, 8
#: Ids that may be broadcast (8 MB of longs); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Bytes of a word from which on its hash is a digest.
LONG = 32
#: Rows of a run that are compared in one block.
BLOCK_ROWS = 1024

U = np.uint64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE, INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix."""
    h = h ^ U(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.r_[U(1), np.full(n - 1, BASE, U)])
    return up, np.cumprod(np.r_[U(1), np.full(n - 1, INVERSE, U)])


TABLES.append(_powers.cache_clear)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, the number of words of each text, and each word's start in the joined bytes."""
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    edge = np.diff(np.r_[True, SPACE[data]].view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(1 << max(20, int(len(data) + 1).bit_length()))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    words = mixed((total[end] - total[start]) * down[start])
    # Long runs of letters can be made to meet in a polynomial of any base; a digest is asked instead.
    for i in np.flatnonzero(end - start > LONG).tolist():
        words[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    counts = np.diff(np.searchsorted(start, np.r_[0, np.cumsum(sizes)]))
    return words, counts, start


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts, _ = word_hashes([t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts])
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), U)
    for k in range(SHINGLE):
        rolled = rolled * U(BASE) + words[k : len(words) - SHINGLE + 1 + k]
    rolled, out, at = mixed(rolled), [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            whole = U(n)
            with np.errstate(over="ignore"):
                for w in words[at : at + n]:
                    whole = whole * U(BASE) + w
            out.append(mixed(np.array([whole], U), 1))
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def band(n: int) -> int:
    return n.bit_length() - 1


def cells(own: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the non-empty cells of a set in band ``g``, how many hashes each has, and the number of all cells."""
    count = max(64, (7 << g) // 10)
    cell = (mixed(own, 2) % U(count)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    value = np.bitwise_xor.reduceat(mixed(own[order], 3), first)
    keys = mixed(value ^ mixed(np.array([g], U), 11), 4) ^ mixed(cell[first].astype(U), 5)
    return keys, np.diff(np.r_[first, len(cell)]), count


def _prefix(own: np.ndarray, g: int, need: int, frequent: np.ndarray) -> np.ndarray:
    keys, sizes, count = cells(own, g)
    late = np.zeros(len(keys), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)] == keys
    keys = keys[np.lexsort((keys, -sizes, late))]
    if need > len(keys):  # empty cells are the last in order
        cell = set((mixed(own, 2) % U(count)).tolist())
        rest = np.array([c for c in range(count) if c not in cell][: need - len(keys)], U)
        keys = np.r_[keys, mixed(rest, 6) ^ mixed(np.full(len(rest), g, U), 7)]
    return keys[:need]


def partner(n: int) -> int:
    """The size of the largest set that can be linked with one of size ``n``."""
    return n * 100 // PERCENT


def difference(a: int, b: int) -> int:
    """The greatest symmetric difference of linked sets of these sizes: |A∆B| <= (a + b)(1 - t)/(1 + t)."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def join_keys(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    n = len(own)
    if not n:
        return own
    g = band(n)
    top = (2 << g) - 1
    keys = [_prefix(own, g, difference(n, min(partner(n), top)) + 1, frequent)]
    if partner(n) > top:
        keys.append(_prefix(own, g + 1, difference(n, partner(n)) + 1, frequent))
    return np.concatenate(keys)


def bit_sketch(own: np.ndarray) -> bytes:
    """The parity of the hashes in each of 4 * 2^g bits (64 at least)."""
    bits = max(64, 4 << band(len(own))) if len(own) else 64
    return np.packbits((np.bincount((mixed(own, 8) & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), 0)


def may_link(a: bytes, n: int, b: bytes, m: int) -> bool:
    size = min(len(a), len(b))
    both = _folded(np.frombuffer(a, np.uint8), size) ^ _folded(np.frombuffer(b, np.uint8), size)
    return int(np.bitwise_count(both).sum()) <= difference(n, m)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


SIGNED = lambda a: pa.array(a.view(np.int64))


def _signatures(docs: DataFrame, frequent: np.ndarray | None) -> DataFrame:
    """By document: set size, set hash, join keys (all cells where ``frequent`` is None), bit sketch."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1, STEP_BYTES):
                sets = shingle_sets([x or "" for x in part.column(1).to_pylist()])
                if frequent is None:
                    keys = [np.concatenate([cells(s, g)[0] for g in (band(len(s)), band(len(s)) + 1)]) if len(s) else s for s in sets]
                else:
                    keys = [join_keys(s, frequent) for s in sets]
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                total = lambda seed: np.array([np.add.reduce(mixed(s, seed)) for s in sets], U)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), SIGNED(total(9)), SIGNED(total(10)), pa.ListArray.from_arrays(pa.array(ends), SIGNED(np.concatenate(keys))), pa.array([bit_sketch(s) for s in sets], pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "keys", "sketch"],
                )

    return map_arrow(docs, run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>, sketch binary")


def _frequent(docs: DataFrame) -> np.ndarray:
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = _signatures(docs.join(F.broadcast(ids), "doc_id", "left_semi"), None)
    keys = sample.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") >= FREQUENT).select("key").toArrow()
    return np.sort(keys.column("key").to_numpy().astype(np.int64).view(U))


def _runs(keyed: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The rows of ``keyed`` (``key`` and more) whose key more than one row has.

    Sorted rows are streamed, so a run of any length takes no memory.  Keys
    that are frequent in the sample would fill single tasks; their rows are
    dealt out by document and stay without a look, since a run of one row does
    no harm later.  The sample bounds their table, which is broadcast.
    """
    spark = keyed.sparkSession
    n, names = partitions(spark), keyed.columns
    hot = spark.createDataFrame(pd.DataFrame({"key": frequent.view(np.int64)}), "key bigint").withColumn("hot", F.lit(True))
    marked = keyed.join(F.broadcast(hot), "key", "left").select(*names, F.coalesce("hot", F.lit(False)).alias("hot"))

    def run(batches):
        held = None  # the last row of what came before, its key, and whether it is kept
        for batch in batches:
            if not batch.num_rows:
                continue
            key, stays = batch.column(0).to_numpy(), batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            rows = batch.select(names)
            same = np.r_[held is not None and key[0] == held[1], key[1:] == key[:-1]]
            if held is not None and (same[0] or held[2]):
                yield held[0]
            yield rows.slice(0, len(key) - 1).filter(pa.array(same[:-1] | same[1:] | stays[:-1]))
            held = rows.slice(len(key) - 1), key[-1], bool(same[-1] or stays[-1])
        if held is not None and held[2]:
            yield held[0]

    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(n))).otherwise(0)
    return marked.withColumn("spread", spread).repartition(n, "key", "spread").drop("spread").sortWithinPartitions("key", "doc_id").mapInArrow(run, keyed.schema)


def close_pairs(n: np.ndarray, component: np.ndarray, block: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int]]:
    """Places of the pairs of different components (and blocks, if there are two) that size and sketches let link."""
    size = min(map(len, sketches))
    bits = np.stack([_folded(np.frombuffer(s, np.uint8), size) for s in sketches]).view(U)
    two, out = block[0] != block[-1] or (block != block[0]).any(), []
    for r in range(len(n) - 1):
        m = n[r + 1 :]
        ok = (component[r + 1 :] != component[r]) & (100 * np.minimum(m, n[r]) >= PERCENT * np.maximum(m, n[r]))
        if two:
            ok &= block[r + 1 :] != block[r]
        at = np.flatnonzero(ok) + r + 1
        if len(at):
            differ = np.bitwise_count(bits[at] ^ bits[r]).sum(1, dtype=np.int64)
            out += [(r, k) for k in at[differ <= (n[r] + n[at]) * (100 - PERCENT) // (100 + PERCENT)].tolist()]
    return out


def _compared(state: DataFrame, sig: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) of the rows of each run that may link, by comparing sketches within blocks.

    A run of more than ``BLOCK_ROWS`` rows is dealt out as pairs of blocks, so a
    task holds two blocks at a time; only pairs that the bound lets through
    leave it.
    """
    size = state.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = state.join(size, "key").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.join(sig.where("doc_id IS NOT NULL").select("doc_id", F.col("n").cast("int").alias("n"), "sketch").distinct(), ["doc_id", "n"])
    part = rows.select("key", "i", "j", "block", "doc_id", "n", "component", "sketch")

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        block, doc, n, component, sketches = zip(*group, strict=True)
        near = close_pairs(np.array(n, np.int64), np.array(component), np.array(block), list(sketches))
        return [(min(doc[x], doc[y]), max(doc[x], doc[y])) for x, y in near if doc[x] != doc[y]]

    def run(batches):
        held, group = None, []
        for batch in batches:
            out = []
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != held:
                    out += compare(group)
                    held, group = (key, i, j), []
                group.append(tuple(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        if out := compare(group):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    n = partitions(state.sparkSession)
    return part.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id").mapInArrow(run, "a bigint, b bigint").distinct()


def _verified(docs: DataFrame, sig: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (``a`` < ``b``) that are linked."""
    narrow = sig.select("doc_id", "n", "sketch")
    side = lambda x: narrow.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def close(batches):
        for batch in batches:
            a, n, b, m = (batch.column(batch.schema.names.index(x)).to_pylist() for x in ("sketch_a", "n_a", "sketch_b", "n_b"))
            keep = pa.array(list(map(may_link, a, n, b, m)), pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    near = written(map_arrow(sized, close, "a bigint, b bigint").distinct(), "near")
    ids = written(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def sets(batches):
        for batch in batches:
            for part in chunks(batch, 1, STEP_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets([x or "" for x in part.column(1).to_pylist()])], pa.binary())], names=["doc_id", "hashes"])

    whole = written(map_arrow(texts, sets, "doc_id bigint, hashes binary"), "sets")
    side = lambda x: whole.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"hashes_{x}"))
    both = near.join(side("b"), "b").join(side("a"), "a")

    def exact(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(batch.schema.names.index("hashes_a")), batch.column(batch.schema.names.index("hashes_b")), strict=True):
                keep.append(linked(np.frombuffer(a.as_py(), U), np.frombuffer(b.as_py(), U)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = written(map_arrow(both, exact, "a bigint, b bigint").distinct(), "links")
    for done in (near, ids, whole):
        dropped(docs.sparkSession, done)
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the least id reachable by links)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = _frequent(docs)
    full = written(_signatures(docs, frequent), "keys")
    sig = written(full.drop("keys"), "signatures")
    own = sig.where("doc_id IS NOT NULL AND n > 0")
    # Exact copies: a star around the least id of each set.
    same = written(own.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("rows")).where("least < most").select("h1", "h2", "least", "rows"), "same")
    total = same.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    copies = written(spread_join(own.select("doc_id", "h1", "h2"), same.drop("rows"), ["h1", "h2"], same, total, ["doc_id"]).where("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v")).distinct(), "copies")
    runs = _runs(full.where("doc_id IS NOT NULL").select(F.explode("keys").alias("key"), "doc_id", F.col("n").cast("int").alias("n")), frequent)
    # Copies need no other links; but an id that repeats with another set does, for that set.
    several = own.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low < high").select("doc_id")
    gone = copies.select(F.col("u").alias("doc_id")).join(several, "doc_id", "left_anti")
    runs = written(runs.join(gone, "doc_id", "left_anti").select("key", "doc_id", "n").distinct(), "runs")
    dropped(docs.sparkSession, full)
    # First a star in each run, around the document of the largest runs: the middle of a group of near copies is in nearly all of them.
    weight = runs.join(runs.groupBy("key").agg(F.count("*").alias("size")), "key").groupBy("doc_id").agg(F.sum("size").alias("weight"))
    state = written(runs.join(weight, "doc_id"), "state")
    pivot = F.max_by(F.struct("doc_id", "n"), F.struct("weight", -F.col("doc_id"))).alias("p")
    pivots = state.groupBy("key").agg(pivot).select("key", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("m"))
    stars = state.join(pivots, "key").where(f"doc_id <> pivot AND 100 * least(n, m) >= {PERCENT} * greatest(n, m)")
    found = _verified(docs, sig, stars.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct())
    links = copies.unionByName(found.select(F.col("b").alias("u"), F.col("a").alias("v")))
    group = written(components(links), "components")
    # Then all pairs of runs that still hold more than one component, but for those within a component and with the pivot.
    left = state.join(pivots.toDF("key", "doc_id", "n"), ["key", "doc_id", "n"], "left_anti").join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    left = left.select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    open_keys = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = written(left.join(open_keys, "key", "left_semi"), "open")
    if left.limit(1).count():
        found = _verified(docs, sig, _compared(left, sig))
        if found.limit(1).count():
            group = written(components(links.unionByName(found.select(F.col("b").alias("u"), F.col("a").alias("v")))), "components")
    for done in (same, copies, runs, state, left):
        dropped(docs.sparkSession, done)
    rows = sig.select("doc_id", F.col("n").alias("n_shingles"))
    return rows.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM overlap WHERE 100 * i >= 75 * (n + m - i)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM sets s LEFT JOIN reach USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
