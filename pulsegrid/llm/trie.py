"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is a sequence of turns; a turn is the SHA-256 of its role and
text, so no text leaves the task that reads it.  Map tasks sort sequences into
runs of bounded size; each row carries its LCP, the number of leading turns it
shares with the row before.  Runs are dealt by ranges of (sequence, id), and
each range merges its runs by a loser tree.  Two heads whose LCPs with the last
winner differ are ordered by those alone; only equal ones are compared, from
that turn on.  So no turn that is known to be shared is compared again.  The
merged stream moves along an open path: what the next row does not share is
finished and leaves the stack as a node.

A range does not hold whole subtrees: its first and last sequences tell, beside
the borders of the ranges next to it, which nodes of the open path reach across.
Those leave as partial sums that add up by node: members and their words in
each range, a node's own words, and its place as a child, in its first range
only, leaves in their last.  There are at most the depth of two paths of them
for each range.  A very common sequence lies in several ranges, since ids are
part of the order; the ids that end in it leave as text in pieces, which one
pass in order hashes as a stream.

Bounds: a task holds one range of sequences (``RANGE_TURNS`` turns on average)
and the longest conversation, 32 bytes a turn.

Defined results: turns stand in order of ``turn``, null first, then of that
hash; null role or text is empty; a row that repeats is a further turn; rows
without a conversation id belong to none; an empty table has no node, not even
a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, map_arrow, partitions, table, word_count, written

#: Turns of a sorted run, and of a range on average.
RUN_TURNS, RANGE_TURNS = 1 << 15, 1 << 17
#: Ids in a piece of a text that is hashed across ranges.
PIECE_IDS = 1024
#: Conversations of a block start with the turns of its first one.
BLOCK, SHARED = 20, 4
#: Beyond so many rows the table of nodes that cross ranges is not broadcast.
BROADCAST_NODES = 50_000


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` in order: an array of the ``digest`` of each and its ``words``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", digest.alias("digest"), word_count(text).alias("words")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of c - c % 20 in place of its own first h; h is the CRC-32 of c's decimals mod 4."""
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads = convs.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    own = convs.withColumn("base", base).withColumn("h", h)
    none = F.array().cast(convs.schema["turns"].dataType)
    joined = own.join(heads, "base", "left")
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(none)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), rest).alias("turns"))


def _lcp(a: list, b: list, start: int = 0) -> int:
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


RUNS = "run bigint, place int, lcp int, conv_id bigint, path array<binary>, words array<bigint>"


def runs(paths: DataFrame) -> DataFrame:
    """``conv_id``, ``path``, ``words`` in sorted runs: ``run``, ``place`` in it and ``lcp`` with the row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, turns = TaskContext.get().partitionId() << 32, [], 0

        def sorted_run() -> pa.RecordBatch:
            held.sort(key=lambda r: r[:2])
            lcps = [0] + [_lcp(a[0], b[0]) for a, b in zip(held, held[1:])]
            path, conv, words = zip(*held)
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(lcps, pa.int32()), pa.array(conv, pa.int64()), pa.array(path, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int64()))],
                names=["run", "place", "lcp", "conv_id", "path", "words"],
            )

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in (batch.column("path"), batch.column("conv_id"), batch.column("words"))]):
                held.append(r)
                turns += len(r[0]) + 1
                if turns >= RUN_TURNS:
                    yield sorted_run()
                    number, held, turns = number + 1, [], 0
        if held:
            yield sorted_run()

    return map_arrow(paths.select("conv_id", "path", "words"), run, RUNS)


def merged(sorted_runs: list[list[tuple]]) -> Iterator[tuple]:
    """One sorted stream of all rows (path, conv_id, words, lcp), each with its LCP with the row before, by a loser tree over ``sorted_runs``.

    Every head and every loser has the LCP with the last row of the stream, or
    with the winner it lost to, which is the same once that one has left.
    """
    k = len(sorted_runs)
    at = [0] * k
    heads = [list(r[0]) for r in sorted_runs]
    for h in heads:
        h[3] = 0  # the row before it is in another range

    def beats(i: int, j: int) -> bool:
        """Whether the head of run ``i`` comes first; the loser's LCP becomes that with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if a[3] != b[3]:
            return a[3] > b[3]
        n = _lcp(a[0], b[0], a[3])
        x, y = a[0], b[0]
        first = (x[n] < y[n]) if n < len(x) and n < len(y) else (len(x) < len(y) if len(x) != len(y) else a[1] < b[1])
        (b if first else a)[3] = n
        return first

    # Leaves k..2k-1 are the runs; node 1 is the root; a node keeps its loser.
    losers = [0] * k

    def play(node: int) -> int:
        """The winner below ``node``, level by level from the leaves."""
        winners = list(range(k))
        level = [0] * k + winners
        for n in range(k - 1, 0, -1):
            a, b = level[2 * n], level[2 * n + 1]
            won = beats(a, b)
            level[n], losers[n] = (a, b) if won else (b, a)
        return level[node] if k > 1 else 0

    winner = play(1)
    while (head := heads[winner]) is not None:
        yield tuple(head)
        at[winner] += 1
        own = sorted_runs[winner]
        heads[winner] = list(own[at[winner]]) if at[winner] < len(own) else None
        n = (winner + k) // 2
        while n:
            if not beats(winner, losers[n]):
                winner, losers[n] = losers[n], winner
            n //= 2


NODES = "kind string, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, part bigint, piece bigint, ids string"


class Open:
    """A node of the open path."""

    __slots__ = ("children", "digest", "ends", "inner", "leaves", "least", "left", "members", "saved", "words")

    def __init__(self, digest: bytes, words: int, left: bool):
        self.digest, self.words, self.left = digest, words, left
        self.members = self.children = self.leaves = self.saved = 0
        self.least, self.inner, self.ends = None, False, []


def nodes(stream: Iterator[tuple], left: int, right: int, part: int) -> Iterator[tuple]:
    """Rows of ``NODES`` from one range's sorted stream.

    The path's first ``left`` turns (-1: not even the root) were open in the
    range before; its last row's first ``right`` turns go on in the next one.
    A ``node`` is finished; its parent is named by ``parent_key`` if that one
    crosses ranges.  A ``part`` is what this range adds to a node that does; an
    ``ids`` row is a piece of the ids that end in one.
    """
    path: list[Open] = []
    left_keys: list[bytes] = []
    right_keys: list[bytes] = []
    kept: dict[int, list[tuple]] = {}  # finished children of open nodes, by depth: they wait for the parent's least id

    def keys(most: int) -> list[bytes]:
        """Names of the open path's nodes down to depth ``most``."""
        h, out = hashlib.sha256(), [hashlib.sha256().digest()][: most + 1]
        for n in path[1 : most + 1]:
            h.update(n.digest)
            out.append(h.digest())
        return out

    def close(crossing: bool) -> Iterator[tuple]:
        depth = len(path) - 1
        across = crossing or path[-1].left
        own_keys = right_keys if crossing else left_keys
        node = path.pop()
        if not crossing and not node.inner:
            node.leaves += 1
        node.saved += node.words * (node.members - (not node.left))
        if path:
            up = path[-1]
            up.inner = True
            up.children += not node.left
            up.members += node.members
            up.leaves += node.leaves
            up.saved += node.saved
            up.least = node.least if up.least is None else min(up.least, node.least)
        children = kept.pop(depth + 1, [])
        if across:
            for c in children:
                yield ("node", None, own_keys[depth], *c[:2], None, *c[2:], None, None, None)
            above = own_keys[depth - 1] if depth else None
            yield ("part", own_keys[depth], above, node.least, depth, None, node.members, node.children, node.leaves, node.saved, None, None, None, None)
            for k in range(0, len(node.ends), PIECE_IDS):
                yield ("ids", own_keys[depth], *[None] * 9, part, k // PIECE_IDS, ",".join(map(str, node.ends[k : k + PIECE_IDS])))
            return
        for c in children:
            yield ("node", None, None, *c[:2], node.least, *c[2:], None, None, None)
        done = (node.least, depth, node.members, node.children, node.leaves, node.saved, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest())
        if path:
            kept.setdefault(depth, []).append(done)
        else:
            yield ("node", None, None, *done[:2], None, *done[2:], None, None, None)

    for turns, conv, words, lcp in stream:
        while len(path) - 1 > lcp:
            yield from close(False)
        if path:
            path += [Open(turns[d], words[d], False) for d in range(lcp, len(turns))]
        else:
            path = [Open(b"", 0, left >= 0), *[Open(turns[d], words[d], d < left) for d in range(len(turns))]]
            left_keys = keys(left)
        top = path[-1]
        top.ends.append(conv)
        top.members += 1
        top.least = conv if top.least is None else min(top.least, conv)
    right_keys = keys(right)
    while path:
        yield from close(len(path) - 1 <= right)


def _range_nodes(rows: pa.Table) -> pa.Table:
    """Merges one range: its runs, and the border rows (``run`` -1: the last of the range before, -2: the first of the next)."""
    part = rows.column("part")[0].as_py()
    own: dict[int, list] = {}
    for run, place, lcp, conv, path, words in sorted(zip(*[rows.column(c).to_pylist() for c in ("run", "place", "lcp", "conv_id", "path", "words")]), key=lambda r: r[:2]):
        own.setdefault(run, []).append((path, conv, words, lcp))
    before, after = own.pop(-1, None), own.pop(-2, None)
    first = min(r[0][:2] for r in own.values())[0]
    last = max(r[-1][:2] for r in own.values())[0]
    left = _lcp(before[0][0], first) if before else -1
    right = _lcp(last, after[0][0]) if after else -1
    found = list(nodes(merged(list(own.values())), left, right, part))
    schema = pa.schema([(n, {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}[k]) for n, k in (c.split() for c in NODES.split(", "))])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def _hashes(pieces: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256`` of the texts of ``pieces`` in order of part and piece, as streams."""
    dealt = pieces.select("key", "part", "piece", "ids").repartition(partitions(pieces.sparkSession), "key").sortWithinPartitions("key", "part", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: bytes, h) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])

        last, h = None, None
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key != last:
                    if last is not None:
                        yield row(last, h)
                    last, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
        if last is not None:
            yield row(last, h)

    return map_arrow(dealt, run, "key binary, ends_sha256 string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The trie of ``convs`` (``conv_id``, once each, and its ``turns`` as ``sequences`` gives them): one row for each node.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` (subtree sums),
    ``ends_sha256`` (of the ids of those that end there).
    """
    spark = convs.sparkSession
    staged = written(runs(convs.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.words").alias("words"))), "runs")
    turns = staged.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    ranges = max(partitions(spark), -(-turns // RANGE_TURNS))
    dealt = written(staged.repartitionByRange(ranges, "path", "conv_id").withColumn("part", F.spark_partition_id().cast("long")), "ranges")
    # One row for each range; its neighbours' borders go to it as rows of two further runs.
    ends = dealt.groupBy("part").agg(F.min_by("path", F.struct("path", "conv_id")).alias("first"), F.max_by("path", F.struct("path", "conv_id")).alias("last"))
    near = Window.orderBy("part")
    beside = ends.select("part", F.lag("last").over(near).alias("before"), F.lead("first").over(near).alias("after"))
    null = lambda kind: F.lit(None).cast(kind)

    def border(run: int, path: Column) -> DataFrame:
        return beside.where(path.isNotNull()).select(F.lit(run).cast("long").alias("run"), F.lit(0).alias("place"), F.lit(0).alias("lcp"), null("long").alias("conv_id"), path.alias("path"), null("array<bigint>").alias("words"), "part")

    rows = dealt.unionByName(border(-1, F.col("before"))).unionByName(border(-2, F.col("after")))
    found = written(rows.groupBy("part").applyInArrow(_range_nodes, NODES), "nodes")
    sums = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    parts = found.where("kind = 'part'").groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums.values())
    empty = hashlib.sha256(b"").hexdigest()
    shared = written(parts.join(_hashes(found.where("kind = 'ids'")), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))), "crossing")
    least = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    if shared.count() <= BROADCAST_NODES:
        least = F.broadcast(least)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    done = found.where("kind = 'node'")
    finished = done.where("parent_key IS NULL").select(out)
    hung = done.where("parent_key IS NOT NULL").drop("parent_conv_id").unionByName(shared, allowMissingColumns=True).join(least, "parent_key", "left").select(out)
    for old in (staged, dealt):
        dropped(spark, old)
    return finished.unionByName(hung)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = written(sequences(table(spark, sf_dir, "conversations")), "sequences")
    return prefix_trie(rebuilt(convs))


#: CRC-32 bit by bit; nodes as lists of digests; subtrees by all prefixes of each node.
OP11_SQL = """
WITH turns AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(digest || ' ' || words ORDER BY turn NULLS FIRST, digest) AS t FROM turns GROUP BY conv_id),
bits AS (
  SELECT conv_id, t, conv_id - conv_id % 20 AS base,
    flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: list_transform(range(8), lambda k: (ascii(x) >> CAST(k AS INT)) & 1))) AS b
  FROM own),
heads AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, CAST(b AS BIGINT[])), lambda x, y: xor(x >> 1, CASE WHEN xor(x, y) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 4 AS h
  FROM bits),
whole AS (
  SELECT c.conv_id, list_concat(coalesce(o.t, []::VARCHAR[])[1:c.h], c.t[c.h + 1:]) AS p FROM heads c LEFT JOIN own o ON o.conv_id = c.base),
members AS (SELECT conv_id, p, unnest(range(len(p) + 1)) AS depth FROM whole),
nodes AS (
  SELECT p[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(p) = depth) AS ends
  FROM members GROUP BY ALL),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE CAST(split_part(node[depth], ' ', 2) AS BIGINT) * (n_convs - 1) END AS saved
  FROM nodes LEFT JOIN children USING (node)),
above AS (SELECT node[1:k] AS node, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(depth + 1)) AS k FROM valued)),
below AS (SELECT node, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY node)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN below USING (node) LEFT JOIN valued u ON v.depth > 0 AND u.node = v.node[1:v.depth - 1]
"""
