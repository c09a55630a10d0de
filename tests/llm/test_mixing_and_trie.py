"""Mixing and the prefix trie against plain versions, and their cases of nulls, ties, repeats and hot groups."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def words(text):
    return len(WORD.findall(text or ""))


# Mixing


def plain_targets(sizes: dict, most=3):
    """Shares by resharing what is above until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: share.get(s, float(most * sizes[s])) for s in order}
        capped |= above


def check_mix(spark, rows, schema="doc_id bigint, text string, source string"):
    docs = spark.createDataFrame(rows, schema).repartition(5)
    got = mixing.allocation(docs, ["source"]).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[2], words(r[1])) for r in rows)
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[2]] += words(r[1])
        longest[r[2]] = max(longest[r[2]], words(r[1]))
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(longest[s], 1e-6 * t), s
    return got


def test_mix_of_a_hot_source(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 40, 40, 40, 500])), "hot" if i % 3 else f"s{i % 8}") for i in range(3000)]
    rows += [(7, "same words here", "hot")] * 800 + [(None, "a b", None), (None, None, None), (5, None, "s1"), (6, "", ""), (8, "x  y\tz\x0b\n\r", "")]
    got = check_mix(spark, rows)
    again = mixing.allocation(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string").repartition(3), ["source"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_where_sources_stop_at_their_limit(spark):
    check_mix(spark, [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1000), ("b", 1), ("c", 2), ("d", 40), ("é", 300), ("😀", 5), ("ﬀ", 5), (None, 3)] * 3)])
    check_mix(spark, [(1, "", "a"), (2, None, "b"), (3, "w w w", "c")])
    check_mix(spark, [(1, "", "a"), (2, None, None)])
    check_mix(spark, [(1, "only", "a")])


def test_mix_of_no_rows_and_of_clashing_columns(spark):
    assert mixing.allocation(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
    rows = [(i, "w " * (i % 7), f"s{i % 4}", i, i + 1, i + 2, i + 3) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy int, at int, size int, `k0` int")
    mix = mixing.mixture(docs)
    assert mix.columns == [*docs.columns, "_copy"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.allocation(docs).collect()}
    got = mix.collect()
    assert Counter(r["doc_id"] for r in got) == Counter({i: n for i, n in plan.items() if n})
    assert all(tuple(r)[:7] == rows[r["doc_id"]] for r in got)


def test_mix_uses_no_python(spark, sf_dir):
    plan = mixing.op12_systematic_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Trie


def plain_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: h[c]] + t[h[c] :] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in own.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = Counter(n[:-1] for n in members if n)
    saved, leaves = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * words(n[-1][1]) if n else 0
            leaves[n[:d]] += not children[n]
    return Counter(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items()
    )


def own_trie(spark, rows, rebuild=True):
    convs = trie.sequences(spark.createDataFrame(rows, CONVERSATIONS).repartition(6))
    return Counter(map(tuple, trie.prefix_trie(trie.rebuilt(convs) if rebuild else convs).collect()))


def conversations(n, seed, alphabet="ab", depth=6):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "bot"]), rnd.choice(alphabet) * rnd.randrange(3)) for c in range(n) for t in range(rnd.randrange(depth))]


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_a_plain_one(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "RUN_TURNS", 40)
    monkeypatch.setattr(trie, "RANGE_TURNS", [30, 100, 10**6][seed])
    monkeypatch.setattr(trie, "BROADCAST_NODES", [0, 10**6, 0][seed])
    rows = conversations(400, seed)
    assert own_trie(spark, rows) == plain_trie(rows)
    assert own_trie(spark, rows, rebuild=False) == plain_trie(rows, rebuild=False)


def test_trie_of_one_very_common_conversation(spark, monkeypatch):
    """Its copies lie in many ranges, and so do the ids that end in it; a shorter and a longer one are beside it."""
    monkeypatch.setattr(trie, "RUN_TURNS", 64)
    monkeypatch.setattr(trie, "RANGE_TURNS", 64)
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    same = [(0, "user", "one two"), (1, "bot", "three"), (2, "user", None)]
    rows = [(c * 20, t, r, x) for c in range(900) for t, r, x in same]
    rows += [(20 * 900 + 20, *same[0])] + [(20 * 900 + 40, t, r, x) for t, r, x in [*same, (3, "bot", "four five six")]] + conversations(60, 5)
    assert own_trie(spark, rows, rebuild=False) == plain_trie(rows, rebuild=False)


def test_trie_of_nulls_ties_repeats_and_turnless_conversations(spark):
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, 1, None, "b"), (0, 1, "", "b"), (1, 0, "user", "x"), (21, 0, "u", "only"), (25, 5, "u", "far"), (41, 0, "1:", "a"), (42, 0, "1", ":a")]
    assert any(k[1] == 0 and k[3] == 6 for k in plain_trie(rows))
    assert own_trie(spark, rows) == plain_trie(rows)
    assert own_trie(spark, []) == Counter()
    other = spark.createDataFrame([(1, 0, "user", "x", 5, "p")], CONVERSATIONS + ", path int, words string")
    assert trie.prefix_trie(trie.sequences(other)).count() == 2


def test_trie_of_a_long_chain(spark):
    rows = [(c, t, "u", "w w") for c in (3, 4) for t in range(3000)] + [(4, 3000, "u", "end")]
    nodes = own_trie(spark, rows, rebuild=False)
    assert sum(nodes.values()) == 3002 and max(k[6] for k in nodes) == 6000


def test_merge_compares_no_shared_turn_again(monkeypatch):
    """With long shared prefixes, comparisons of turns stay near the number of rows, not rows times prefix."""
    seen, real = [0], trie._lcp

    def counted(a, b, start=0):
        n = real(a, b, start)
        seen[0] += n - start + 1
        return n

    rnd = random.Random(3)
    rows = sorted(([b"p"] * 200 + [bytes([rnd.randrange(256)]) for _ in range(4)], i, [1] * 204) for i in range(640))
    split = [rows[i::8] for i in range(8)]
    sorted_runs = [[(*r, real(r[0], run[i - 1][0]) if i else 0) for i, r in enumerate(run)] for run in split]
    monkeypatch.setattr(trie, "_lcp", counted)
    out = list(trie.merged(sorted_runs))
    assert [r[:2] for r in out] == [(r[0], r[1]) for r in rows]
    assert [r[3] for r in out[1:]] == [real(a[0], b[0]) for a, b in zip(rows, rows[1:])]
    assert seen[0] < 640 * 12 + 8 * 210


def test_op11_and_op12_equal_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for df, sql in ((trie.op11_prefix_trie(spark, sf_dir), trie.OP11_SQL), (mixing.op12_systematic_mixing(spark, sf_dir), mixing.OP12_SQL)):
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        near = lambda r: tuple(float(f"{x:.12g}") if isinstance(x, float) else x for x in r)
        assert Counter(near(r) for r in df.select(names).collect()) == Counter(near(r) for r in want.fetchall())
