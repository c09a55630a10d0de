"""Departure profiles against exhaustive search, and service metrics against a loop over the minutes."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import profiles as P
from pulsegrid.operators import routing as R

MOVES = "trip string, seq int, from_station string, to_station string, dep int, arr int"


def network(seed, trips=26, stops=7):
    """Trips with dwells and hops that may take no time."""
    rnd, rows = random.Random(seed), []
    for trip in range(trips):
        t, at = rnd.randrange(300, 460), rnd.randrange(stops)
        for seq in range(rnd.randrange(2, 5)):
            to = rnd.choice([s for s in range(stops) if s != at])
            dep = t + rnd.choice([0, 0, 1, 3])
            t = dep + rnd.choice([0, 2, 5, 9, 17])
            rows.append((f"t{trip}", seq, str(at), str(to), dep, t))
            at = to
    return rows


def plain_profile(rows, place, edges, start, end):
    """All paths from every departure; of each pair the best of a departure, where no later one arrives as early."""
    after = {(r[0], r[1]): r for r in rows}
    boards = defaultdict(list)
    for r in rows:
        boards[r[2]].append(r)
    best: dict = {}

    def label(path):
        roll, dwell, still, none, changes = 0, 0, 0, 0, 0
        for i, r in enumerate(path):
            roll, still = roll + r[5] - r[4], still + (r[5] == r[4])
            if i and path[i - 1][0] == r[0]:
                gap = r[4] - path[i - 1][5]
                dwell, none = dwell + gap, none + (gap == 0)
            elif i:
                changes += 1
        return path[-1][5], changes, len(path), roll, dwell, still, none

    def walk(path, trips):
        r, o = path[-1], place[path[0][2]]
        key, own = (o, place[r[3]], path[0][4]), label(path)
        if key not in best or own < best[key]:
            best[key] = own
        if len(path) > 12:
            return
        on = after.get((r[0], r[1] + 1))
        if on and on[2] == r[3]:
            walk([*path, on], trips)
        for s, m in edges.get(r[3], ()):
            for c in boards[s]:
                if c[4] >= r[5] + max(1, m) and c[0] not in trips:
                    walk([*path, c], trips | {c[0]})

    for r in rows:
        walk([r], {r[0]})
    out = {}
    for (o, d, dep), own in best.items():
        if o != d and start <= dep < end and not any(x[:2] == (o, d) and x[2] > dep and y[0] <= own[0] for x, y in best.items()):
            out[o, d, dep] = own
    return out


@pytest.mark.parametrize("seed", range(4))
def test_profiles_against_exhaustive_search(spark, seed, monkeypatch):
    monkeypatch.setattr(P, "TOGETHER", 2)
    rows = network(seed, trips=11)
    place = {str(i): "hub" if i >= 5 else str(i) for i in range(7)}
    stations = spark.createDataFrame(list(place.items()), "station string, place string")
    transfers = P.complex_transfers(stations, F.lit(3), F.when(F.col("from_station") == F.col("to_station"), 4).otherwise(7))
    edges = defaultdict(list)
    for a, b, m in transfers.collect():
        edges[a].append((b, m))
    assert sorted(edges["5"]) == [("5", 4), ("6", 7)] and edges["0"] == [("0", 3)]
    con = spark.createDataFrame(rows, MOVES).repartition(3)
    got = P.profiles(con, stations, transfers, 300, 460, paths=True).collect()
    want = plain_profile(rows, place, edges, 300, 460)
    assert {(r["origin"], r["destination"], r["dep"]): tuple(r[i] for i in range(3, 10)) for r in got} == want and len(got) == len(want)
    known = set(rows)
    for r in got:
        path = r["path"]
        assert place[path[0]["from_station"]] == r["origin"] and place[path[-1]["to_station"]] == r["destination"] and len(path) == r["hops"]
        assert (path[0]["dep"], path[-1]["arr"]) == (r["dep"], r["arr"])
        assert all(any(k[0] == h["trip"] and k[2:] == tuple(h[:4]) for k in known) for h in path)
        assert sum(a["trip"] != b["trip"] for a, b in zip(path, path[1:])) == r["changes"]


def test_times_add_up_to_the_way(spark):
    rows = network(9, trips=40)
    stations = spark.createDataFrame([(str(i), str(i)) for i in range(7)], "station string, place string")
    con = spark.createDataFrame(rows, MOVES)
    found = P.profiles(con, stations, P.complex_transfers(stations, F.lit(3), F.lit(3)), 300, 460, paths=True)
    times = P.with_times(found).withColumn("l", R.leg_times(F.col("path"))).collect()
    assert len(times) > 30
    for r in times:
        assert r["rolling"] + r["dwell"] + r["transfer"] == pytest.approx(r["arr"] - r["dep"] or 0)
        assert (r["rolling"], r["dwell"], r["transfer"]) == pytest.approx(tuple(r["l"]))


def test_legs_join_hops_of_a_train(spark):
    path = [("a", "b", 1, 2, "x"), ("b", "c", 2, 3, "x"), ("c", "d", 9, 10, "y"), ("d", "e", 11, 12, "x")]
    df = spark.createDataFrame([(path,)], "path array<struct<from_station:string,to_station:string,dep:int,arr:int,trip:string>>")
    legs = df.select(R.train_legs(F.col("path")).alias("l")).first()["l"]
    assert [tuple(x) for x in legs] == [("a", "c", 1, 3, "x"), ("c", "d", 9, 10, "y"), ("d", "e", 11, 12, "x")]


def plain_metrics(pattern, start=300, end=420, day_end=1440):
    cycle, options = end - start, []
    for dep, arr, *times in pattern:
        options += [(arr, dep, times), (arr + cycle, dep + cycle, times)]
    wait, parts = 0.0, [0.0] * 3
    for minute in range(start, end):
        arr, dep, times = min(o for o in options if o[1] >= minute)
        wait += dep - minute
        parts = [p + t for p, t in zip(parts, times)]
    frequency = sum(1 for dep, arr, *_ in pattern for k in range(20) if dep + cycle * k < day_end and dep + cycle * k + arr - dep <= day_end)
    return [frequency, min(arr - dep for dep, arr, *_ in pattern), wait / cycle, *[p / cycle for p in parts]]


def test_service_metrics_against_a_loop(spark):
    rnd, rows, want = random.Random(2), [], {}
    for pair in range(60):
        deps = sorted(rnd.sample(range(300, 420), rnd.choice([1, 1, 2, 5, 20])))
        arrs = sorted(rnd.sample(range(420, 1500), len(deps)))
        pattern = [(d, a if pair % 3 else d + rnd.randrange(1, 400), float(rnd.randrange(9)), float(rnd.randrange(9)), 1.0) for d, a in zip(deps, arrs)]
        want[str(pair)] = plain_metrics(pattern)
        rows += [(str(pair), *p) for p in pattern]
    df = spark.createDataFrame(rows, "pair string, dep int, arr int, rolling double, dwell double, transfer double")
    got = {r["pair"]: [r[m] for m in P.METRICS] for r in P.service_metrics(df, ["pair"]).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_pairs_without_service(spark):
    metrics = spark.createDataFrame([("a", "b", 2.0, 5.0, 1.0, 4.0, 0.0, 1.0)], "origin string, destination string, " + ", ".join(f"{m} double" for m in P.METRICS))
    got = {(r["origin"], r["destination"]): r for r in P.all_pairs(metrics, spark.createDataFrame([("a",), ("b",)], "place string")).collect()}
    assert got["a", "a"]["frequency"] == got["a", "a"]["wait"] == 0 and got["b", "a"]["frequency"] == 0 and got["b", "a"]["fastest"] is None and got["a", "b"]["wait"] == 1
    assert len(got) == 4


def test_a_route_leaves_as_late_as_it_can(spark):
    """Of the ways that arrive first the latest departure counts, also where a station on the way is reached earlier by another."""
    rows = [("slow", 0, "a", "b", 300, 310), ("late", 0, "a", "b", 305, 320), ("on", 0, "b", "c", 330, 340)]
    con = spark.createDataFrame(rows, MOVES)
    asked = spark.createDataFrame([("a", 300)], "origin string, ready int")
    got = {r["destination"]: r for r in R.one_to_all(con, asked, spark.createDataFrame([("b", 4)], "station string, minutes int")).collect()}
    assert (got["c"]["arrival"], got["c"]["departure"], got["c"]["transfers"]) == (340, 305, 1) and got["b"]["departure"] == 300


def test_rides_do_not_grow_with_trips(spark):
    """More trips with the same connections leave the rides and the profiles as they are."""
    rows = network(5, trips=30)
    more = [(f"{r[0]}/{k}", *r[1:]) for k in range(12) for r in rows]
    count = lambda x: P.rides(spark.createDataFrame(x, MOVES)).count()
    assert 0 < count(more) == count(rows) < len(rows) * 2


def test_rides_of_steps_and_without_the_fastest(spark, monkeypatch):
    """Trips that go on beyond a step, and a table of fastest connections that is too large to hold."""
    rows = network(6, trips=60)
    stations = spark.createDataFrame([(str(i), str(i)) for i in range(7)], "station string, place string")
    con = spark.createDataFrame(rows, MOVES).coalesce(1)
    found = lambda: sorted(tuple(r)[:10] for r in P.profiles(con, stations, P.complex_transfers(stations, F.lit(3), F.lit(3)), 300, 460, paths=True).collect())
    want = found()
    monkeypatch.setattr(P, "STEP_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert found() == want
        monkeypatch.setattr(P, "QUICK_ROWS", 5)
        assert found() == want and len(want) > 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
