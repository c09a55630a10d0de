"""Substring dedup: windows of 50 words that start in a document with a smaller id.

Where a window is looked for is decided by content.  Among the 8-word grams of
every 50-word window the one of least hash is its anchor, so equal windows have
equal anchors at equal places (winnowing).  Around an anchor stand all the
windows that may have it: the piece from 42 words before it to 42 behind it.
Anchors that occur once are dropped.  Equal pieces are aggregated to one with
their least owner before any text moves, so a group of copies costs one piece.

Pieces go to shards by their key, at first the anchor.  Each shard builds a
compressed FM-index (wavelet matrix) over its pieces and streams the pieces
through it by backward search; the matching statistics, capped at the window,
give for every window the least owner of an equal one, and the intervals where
it is smaller than the document's own id are reported.

An anchor with more than ``KEY_PIECES`` different pieces (one passage in very
many contexts) would make a large shard, so its pieces are cut.  The windows
that hold the anchor are dealt to ranges of its place in them; all windows of a
range share some words around the anchor, which become the longer key, and the
pieces shrink to the windows of the range, so they lose their different
contexts.  Ranges become smaller (``RANGES``) until a key has few pieces; at
the last, key and piece are one window.  Every level goes through the index.

Defined results: null and empty texts have no words; rows that share an id
never match each other, and each is cut by itself; rows with a null id are
neither cut nor a reason to cut; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, dropped, free, map_arrow, spread_join, table, trim, written
from .fmindex import FMIndex
from .jaccard import BASE, BROADCAST_IDS, SIGNED, U, _powers, mixed, word_hashes

WINDOW, GRAM = 50, 8
REACH = WINDOW - GRAM  # words of a piece on either side of its anchor
SHARD_PIECES, KEY_PIECES = 2500, 6000
#: Widths of the ranges of an anchor's place in its windows, level by level.
RANGES = (REACH + 1, 11, 1)
STEP_BYTES = 1 << 20


def _rolled(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    out = np.zeros(max(0, len(words) - n + 1), U)
    for k in range(n):
        out = out * U(BASE) + words[k : len(words) - n + 1 + k]
    return mixed(out, seed)


def anchors(words: np.ndarray, begin: int, grams: np.ndarray) -> np.ndarray:
    """Places (from ``begin``) of the anchors of all windows of a document's ``words``."""
    own = grams[begin : begin + len(words) - GRAM + 1]
    least = np.lib.stride_tricks.sliding_window_view(own, REACH + 1).argmin(1)
    return np.unique(least + np.arange(len(least)))


def _hashed(batch: pa.RecordBatch):
    """Steps of a batch (``doc_id``, ``text_hash``, ``text`` and more) with the word hashes of its texts."""
    for part in chunks(batch, 2, STEP_BYTES):
        words, counts, _ = word_hashes([(x or "").encode("utf-8", "surrogatepass") for x in part.column(2).to_pylist()])
        yield part, words, counts


class Runs:
    """Hashes of runs of words as differences of one running polynomial."""

    def __init__(self, words: np.ndarray):
        up, self.down = _powers(1 << max(20, len(words).bit_length()))
        self.total = np.zeros(len(words) + 1, U)
        np.cumsum(words * up[: len(words)], out=self.total[1:])

    def hash(self, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
        return mixed((self.total[high] - self.total[low]) * self.down[low], seed) ^ mixed((high - low).astype(U), 24)


PIECES = "key bigint, piece bigint, doc_id bigint, text_hash bigint, place int, a int, low int, high int"
#: What tells a piece's place: the anchor, the least place of the anchor in its windows, and its bounds.
WHERE = ("place", "a", "low", "high")


def _batch(key, piece, docs, texts, *where) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([SIGNED(key), SIGNED(piece), docs, texts, *(pa.array(x.astype(np.int32)) for x in where)], names=["key", "piece", "doc_id", "text_hash", *WHERE])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each anchor of each document: its hash, the hash of its piece, and where that is (``PIECES``)."""

    def run(batches):
        for batch in batches:
            for part, words, counts in _hashed(batch):
                if len(words) < WINDOW:
                    continue
                grams, runs, found, at = _rolled(words, GRAM, 22), Runs(words), [], 0
                for i, n in enumerate(counts.tolist()):
                    if n >= WINDOW:
                        place = anchors(words[at : at + n], at, grams)
                        found.append((i, at, place, np.maximum(place - REACH, 0), np.minimum(place + GRAM + REACH, n)))
                    at += n
                if not found:
                    continue
                sizes = [len(f[2]) for f in found]
                base = np.repeat([f[1] for f in found], sizes)
                place, low, high = (np.concatenate([f[k] for f in found]) for k in (2, 3, 4))
                take = pa.array(np.repeat([f[0] for f in found], sizes))
                piece = runs.hash(base + low, base + high, 23) ^ mixed((place - low).astype(U), 28)
                yield _batch(grams[base + place], piece, part.column(0).take(take), part.column(1).take(take), place, np.zeros(len(place)), low, high)

    return map_arrow(docs.where("doc_id IS NOT NULL"), run, PIECES)


def _at_places(docs: DataFrame, where: DataFrame, f, schema: str, made: list[DataFrame]) -> DataFrame:
    """``f(doc, text, words, places)`` for documents with rows in ``where`` (``doc_id``, ``text_hash``, ``WHERE``), rereading their texts.

    Rows of one id and text are one; an id's other texts are apart.
    """
    lists = written(where.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(*WHERE)).alias("places")), "places")
    made.append(lists)
    ids = lists.select("doc_id", "text_hash")
    few = ids.count() <= BROADCAST_IDS
    one = docs.join(F.broadcast(ids) if few else ids, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = one.join(lists, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places")

    def run(batches):
        for batch in batches:
            for part, words, counts in _hashed(batch):
                ids, hashes, lists, at = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3), 0
                for i, n in enumerate(counts.tolist()):
                    places = lists[i].values
                    yield f(ids[i], hashes[i], words[at : at + n], {c: places.field(c).to_numpy().astype(np.int64) for c in WHERE})
                    at += n

    return map_arrow(texts, run, schema)


def _content(doc: int, text: int, words: np.ndarray, at: dict[str, np.ndarray]) -> pa.RecordBatch:
    raw = [words[low:high].tobytes() for low, high in zip(at["low"].tolist(), at["high"].tolist(), strict=True)]
    n = len(raw)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.full(n, text)), pa.array(at["place"].astype(np.int32)), pa.array(at["a"].astype(np.int32)), pa.array(raw, pa.binary())], names=["doc_id", "text_hash", "place", "a", "words"])


def _narrower(before: int, width: int):
    """From pieces of ranges of ``before`` places, those of ranges of ``width``."""

    def cut(doc: int, text: int, words: np.ndarray, at: dict[str, np.ndarray]) -> pa.RecordBatch:
        n, runs = len(words), Runs(words)
        step = np.arange(0, before, width)
        p, a = np.repeat(at["place"], len(step)), (at["a"][:, None] + step).ravel()
        end = np.minimum(np.repeat(at["a"], len(step)) + before - 1, REACH)
        b = np.minimum(a + width - 1, end)
        # A window that has the anchor at place x begins at p - x; of these the text holds:
        least, most = np.maximum(a, p + WINDOW - n), np.minimum(b, p)
        ok = least <= most
        p, a, b, least, most = p[ok], a[ok], b[ok], least[ok], most[ok]
        key = runs.hash(p - a, p + WINDOW - b, 25) ^ mixed(a.astype(U), 26) ^ mixed(np.full(len(p), width, U), 29)
        low, high = p - most, p + WINDOW - least
        piece = runs.hash(low, high, 23) ^ mixed((p - low).astype(U), 28)
        return _batch(key, piece, pa.array(np.full(len(p), doc)), pa.array(np.full(len(p), text)), p, a, low, high)

    return cut


RUNS = "key bigint, piece bigint, runs array<struct<first:int,last:int,least:bigint>>"


def _search(rows: pa.Table) -> pa.Table:
    """Index the pieces of a shard, stream them through it, and report where owners are least."""
    raw = rows.column("words").to_pylist()
    texts = [np.frombuffer(x, U) for x in raw]
    owners = rows.column("doc_id").to_numpy()
    found = FMIndex(texts, owners, WINDOW).statistics(texts)
    trim()
    ends, first, last, least = [0], [], [], []
    for least_owner in found:
        edge = np.flatnonzero(np.r_[True, least_owner[1:] != least_owner[:-1]]) if len(least_owner) else np.zeros(0, int)
        first += edge.tolist()
        last += (np.r_[edge[1:], len(least_owner)] - 1).tolist()[: len(edge)]
        least += least_owner[edge].tolist()
        ends.append(len(least))
    runs = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(least, pa.int64())], names=["first", "last", "least"])
    return pa.table([rows.column("key"), rows.column("piece"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)], names=["key", "piece", "runs"])


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """Intervals of words to remove: ``doc_id``, ``text_hash``, ``cut``, an array of ``start``, ``end`` (word numbers, end exclusive); a document may have several rows.

    ``docs``: ``doc_id`` (long), ``text_hash``, ``text``.
    """
    spark, parts, old, left = docs.sparkSession, [], [], None
    for level, width in enumerate(RANGES):
        rows = _anchor_rows(docs) if level == 0 else _at_places(docs, left, _narrower(RANGES[level - 1], width), PIECES, old)
        rows = written(rows, f"rows{level}")
        distinct = rows.groupBy("key", "piece").agg(F.min(F.struct("doc_id", "text_hash", *WHERE)).alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("rows"))
        distinct = written(distinct.select("key", "piece", "most", "rows", "least.*"), f"pieces{level}")
        per = distinct.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("small"), F.max("most").alias("great")).where("small < great").select("key", "n")
        per = written(per, f"shared{level}")
        old += [rows, distinct, per]
        last = level == len(RANGES) - 1  # a key is a window there, and has one piece
        shared = distinct.join(per if last else per.where(F.col("n") <= KEY_PIECES), "key", "left_semi")
        count, total = shared.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if count:
            content = _at_places(docs, shared, _content, "doc_id bigint, text_hash bigint, place int, a int, words binary", old)
            same = ["doc_id", "text_hash", "place", "a"]
            sharded = content.join(shared.select("key", "piece", *same), same).select(F.pmod(F.xxhash64("key"), F.lit(-(-count // SHARD_PIECES))).alias("shard"), "key", "piece", "doc_id", "words")
            found = written(sharded.groupBy("shard").applyInArrow(_search, RUNS), f"found{level}")
            found = found.withColumn("least", F.array_min(F.transform("runs", lambda x: x["least"])))
            # A passage that goes on and on has the same window at many places of a document: one row has them all.
            own = ["key", "piece", "doc_id", "text_hash"]
            placed = rows.select(*own, F.array("low").alias("lows")) if level == 0 else rows.groupBy(*own).agg(F.collect_set("low").alias("lows"))
            hit = spread_join(placed, found, ["key", "piece"], shared, total, ["doc_id", "lows"] if level == 0 else ["doc_id"]).where("least < doc_id")
            # All windows of a piece hold its anchor, so those that go make one interval.
            gone = hit.withColumn("runs", F.filter("runs", lambda x: x["least"] < F.col("doc_id")))
            gone = gone.withColumns({"first": F.array_min(F.transform("runs", lambda x: x["first"])), "last": F.array_max(F.transform("runs", lambda x: x["last"]))})
            cut = F.transform("lows", lambda low: F.struct((low + F.col("first")).alias("start"), (low + F.col("last") + WINDOW).alias("end")))
            parts.append(written(gone.select("doc_id", "text_hash", cut.alias("cut")), f"intervals{level}"))
            old.append(found)
        many = per.where(F.col("n") > KEY_PIECES)
        if last or not many.limit(1).count():
            break
        left = rows.join(many.select("key"), "key", "left_semi")
    out = parts[0] if parts else spark.createDataFrame([], "doc_id bigint, text_hash bigint, cut array<struct<start:int,end:int>>")
    for more in parts[1:]:
        out = out.unionByName(more)
    for done in old:
        dropped(spark, done)
    return out


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """Per input row: the id, columns named in ``keep``, and under the names in ``out`` how many words it has and loses and the kept ones joined by one space."""
    named = [id_col, *keep]
    text, own, hashed, cut, id_, hash_ = free([*named, *out], "text", "own", "hashed", "cut", "id", "hash")
    column = lambda c: F.col(f"`{c}`")
    narrow = docs.select(column(id_col).cast("long").alias("doc_id"), F.xxhash64(column(text_col)).alias("text_hash"), column(text_col).alias("text"))
    found = repeated_intervals(narrow)
    lists = found.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias(cut))
    source = docs.select(*map(column, named), column(text_col).alias(text), column(id_col).cast("long").alias(own), F.xxhash64(column(text_col)).alias(hashed))
    source = source.join(lists, (F.col(own) == F.col(id_)) & (F.col(hashed) == F.col(hash_)), "left").select(*map(column, named), text, cut)
    n = len(named)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, n, STEP_BYTES):
                cut, kept, total, removed = part.column(n + 1), [], [], []
                for i, text in enumerate(part.column(n)):
                    words, gone = (text.as_py() or "").encode("utf-8", "surrogatepass").split(), 0
                    total.append(len(words))
                    if cut[i].is_valid and words:
                        rows = cut[i].values
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, rows.field("start").to_numpy(), 1)
                        np.add.at(step, rows.field("end").to_numpy(), -1)
                        stay = np.cumsum(step)[:-1] == 0
                        gone = int(len(words) - stay.sum())
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s] if gone else words
                    removed.append(gone)
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*named, *out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n])
    return map_arrow(source, run, f"{kinds}, `{out[0]}` bigint, `{out[1]}` bigint, `{out[2]}` string")


def op9_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM each e ANTI JOIN gone USING (doc_id, k) GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN kept USING (doc_id)
"""
