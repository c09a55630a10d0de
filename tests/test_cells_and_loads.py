"""Nearest places and screenlines by cells against brute force; loads and overlaps on a small network."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from pulsegrid.operators import joins as J
from pulsegrid.operators import loads as L
from pulsegrid.operators import spatial as G


def test_nearest_equals_brute_force(spark):
    rng = random.Random(3)
    places = [(i, rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(300)] + [(300 + i, 1.0, 1.0) for i in range(9)] + [(400, 900.0, -700.0), (401, None, 1.0)]
    points = [(i, rng.gauss(0, 6), rng.gauss(0, 6)) for i in range(200)] + [(500, -4000.0, 4000.0), (501, 1.0, 1.0), (502, 899.0, -700.0), (503, 2.0, None)]
    p, q = spark.createDataFrame(points, "point int, x double, y double"), spark.createDataFrame(places, "place int, px double, py double")
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    run = lambda a, b, k: J.nearest(a, b, d, "point", "place", k, ["x", "y"], ["px", "py"])
    got = {(r["point"], r["rank"]): (r["place"], round(r["km"], 9)) for r in run(p, q, 5).collect()}
    want = {}
    for i, x, y in points:
        if y is not None:
            best = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in places if a is not None)[:5]
            want |= {(i, n): (j, round(km, 9)) for n, (km, j) in enumerate(best, 1)}
    assert got == want
    assert run(p, q.limit(0), 5).count() == 0 and run(p.limit(0), q, 5).count() == 0
    assert run(p, q.where("place < 3"), 5).count() == 3 * 203  # fewer places than asked for
    assert run(p, q.where("place = 301"), 1).count() == 203
    assert "NestedLoop" not in run(p, q, 5)._jdf.queryExecution().toString()


def test_degrees_are_a_lower_bound(spark):
    rng, bound = random.Random(5), J.degrees_beyond(60)
    for _ in range(2000):
        a, b, o, p = rng.uniform(-60, 60), rng.uniform(-60, 60), rng.uniform(-80, 80), rng.uniform(-80, 80)
        if rng.random() < 0.5:
            b, p = min(60, max(-60, a + rng.uniform(-1, 1))), o + rng.uniform(-1, 1)
        h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
        assert 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h))) >= bound(max(abs(a - b), abs(o - p))) - 1e-9


def _apart(p, s):
    dx, dy = s[2] - s[0], s[3] - s[1]
    t = max(0.0, min(1.0, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(p[0] - s[0] - t * dx, p[1] - s[1] - t * dy)


def test_screenlines_equal_brute_force(spark):
    rng = random.Random(7)
    links = [(i, x := rng.uniform(-60, 60), y := rng.uniform(-60, 60), x + rng.gauss(0, 9), y + rng.gauss(0, 9)) for i in range(900)]
    links += [(1000, 3.0, -50.0, 3.0, 50.0), (1001, -55.0, 7.0, 55.0, 7.0), (1002, 1.0, 1.0, 1.0, 1.0), (1003, None, 0.0, 1.0, 1.0), (1004, -60.0, -60.0, 60.0, 60.0)]
    corridors = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(25)] + [(90, 5.0, 5.0, 5.0, 25.0), (91, 0.0, 0.0, 30.0, 0.0), (92, 4.0, 4.0, 4.0, 4.0)]
    c, li = spark.createDataFrame(corridors, "corridor int, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(links, "link int, a_x double, a_y double, b_x double, b_y double")
    want = set()
    for i, x1, y1, x2, y2 in corridors:
        d = math.hypot(x2 - x1, y2 - y1)
        if not d:
            continue  # a corridor without a direction has no line
        h, mx, my = max(2.5, min(12.0, 0.35 * d)) / d, (x1 + x2) / 2, (y1 + y2) / 2
        s = (mx - (y2 - y1) * h, my + (x2 - x1) * h, mx + (y2 - y1) * h, my - (x2 - x1) * h)
        for j, *e in links:
            if None in e:
                continue
            side = lambda g, x, y: (g[2] - g[0]) * (y - g[1]) - (g[3] - g[1]) * (x - g[0])
            cross = side(s, *e[:2]) * side(s, *e[2:]) <= 0 and side(e, *s[:2]) * side(e, *s[2:]) <= 0
            if cross or min(_apart(e[:2], s), _apart(e[2:], s), _apart(s[:2], e), _apart(s[2:], e)) <= 0.5:
                want.add((i, j))
    for width in (0.6, 4.0, 50.0):
        got = [(r["corridor"], r["link"]) for r in G.screenline_links(c, li, 0.5, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 50
    assert G.screenline_links(c, li.limit(0), 0.5).count() == 0
    assert "NestedLoop" not in G.screenline_links(c, li, 0.5)._jdf.queryExecution().toString()


LEG = "path int, seq int, line string, train string, a string, b string, dep int, arr int, flow double, instances int"
#: Path 1 rides A-B-C on line I, changes at C to line II and rides C-D-E; path 2 joins at B; path 3 changes at B; path 4 rides a train twice.
LEGS = [
    (1, 0, "I", "i1", "A", "B", 0, 5, 10.0, 2), (1, 1, "I", "i1", "B", "C", 6, 10, 10.0, 2), (1, 2, "II", "ii1", "C", "D", 14, 20, 10.0, 2), (1, 3, "II", "ii1", "D", "E", 21, 25, 10.0, 2),
    (2, 0, "I", "i1", "B", "C", 6, 10, 4.0, 1), (2, 1, "II", "ii1", "C", "D", 14, 20, 4.0, 1),
    (3, 0, "III", "iii", "X", "B", 0, 3, 1.0, 1), (3, 1, "I", "i1", "B", "C", 6, 10, 1.0, 1),
    (4, 0, "I", "i1", "A", "B", 0, 5, 3.0, 3), (4, 1, "II", "ii2", "B", "A", 9, 12, 3.0, 3), (4, 2, "I", "i2", "A", "B", 20, 25, 3.0, 3),
    (5, 0, "I", "i1", "A", "B", 0, 5, None, 1),
]


def test_service_loads(spark):
    rows = L.service_loads(spark.createDataFrame(LEGS, LEG)).collect()
    at = {tuple(r[:5]): r["load"] for r in rows}
    assert len(at) == len(rows)
    assert at["service", "I", None, "A", "B"] == 13 and at["service", "I", None, "B", "C"] == 15  # path 4 rides A-B twice and counts once
    assert at["network", None, None, "B", "C"] == 15 and at["network", None, None, "C", "D"] == 14
    assert at["riders", "I", None, None, None] == 18 and at["volume", "I", None, None, None] == 10 * 2 + 4 + 1 + 3 * 2
    assert at["train", "I", "i1", "A", "B"] == 5 + 1 and at["train", "I", "i2", "A", "B"] == 1
    assert L.service_loads(spark.createDataFrame([], LEG)).count() == 0


def test_transfer_overlap(spark):
    moved = L.path_transfers(spark.createDataFrame(LEGS[:8], LEG))
    kinds = {tuple(r[:4]): (r["paths"], r["flow"]) for r in L.transfer_rows(moved).collect()}
    assert kinds == {("C", "I", 4, "II"): (2, 14.0), ("B", "III", 3, "I"): (1, 1.0)}
    passed = {tuple(r[:6]): r["flow"] for r in L.transfer_overlap(moved).collect()}
    # B is a station of change of line I; A, D, E and X are not, and C is the end of what path 3 rides.
    assert passed == {("C", "I", 4, "II", "prior", "B"): 14.0, ("B", "III", 3, "I", "following", "C"): 1.0}
    assert L.transfer_overlap(L.path_transfers(spark.createDataFrame([], LEG))).count() == 0


def test_links_of_few_corridors_are_not_shuffled(spark):
    c = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0), (1, 0.0, 0.0, 0.0, 10.0)], "corridor int, x1 double, y1 double, x2 double, y2 double")
    li = spark.range(5000).select(F.col("id").alias("link"), (F.col("id") % 100 / 5).alias("a_x"), (F.floor(F.col("id") / 100) / 5).alias("a_y"), (F.col("id") % 97 / 5).alias("b_x"), (F.col("id") % 41 / 5).alias("b_y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = [sorted(map(tuple, G.screenline_links(c, li, 0.5, few=few).select("corridor", "link").collect())) for few in (False, True)]
        plan = G.screenline_links(c, li, 0.5, few=True)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == got[1] and got[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
