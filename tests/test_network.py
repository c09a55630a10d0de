"""Worked examples and brute force for expansion, routing, fitting, selection, contours, sources, sinks and streams."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import demand as D
from pulsegrid.operators import routing as R
from pulsegrid.operators import selection as Z
from pulsegrid.operators import sequences as Q
from pulsegrid.operators import spatial as G
from pulsegrid.operators import timetable as T
from pulsegrid.sources import readers, writers
from pulsegrid.streaming import incremental


def segment(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "segment string, seq int, station string, kind string, raw string").withColumn("token", S.token("raw"))


def test_hour_and_a_half_hourly_pair(spark):
    got = T.trips(segment(spark, [("A", "ab", "17"), ("B", "an", "26Q")])).where("start <= 377").orderBy("start").collect()
    assert [[e["minute"] for e in r["events"]] for r in got] == [[317, 386], [377, 446]]


@pytest.mark.parametrize(("mark", "want"), [("P", 370), ("Q", 430)])
def test_next_hour_and_an_hour_later(spark, mark, want):
    got = T.trips(segment(spark, [("A", "ab", "50"), ("B", "an", f"10{mark}")])).where("start = 350").collect()
    assert got[0]["events"][1]["minute"] == want


def test_trips_end_at_long_dwells_and_turnbacks(spark):
    first = lambda rows: [len(r["events"]) for r in T.trips(segment(spark, rows)).where("start_seq = 0 AND start = 300").collect()]
    assert first([("A", "ab", "00"), ("B", "an", "10"), ("B", "ab", "30"), ("C", "an", "40")]) == [2]
    assert first([("A", "ab", "00"), ("B", "an", "10"), ("B", "ab", "12"), ("A", "an", "20")]) == [2]  # back to A: another trip
    assert first([("A", "ab", "00"), ("B", "an", "10"), ("B", "ab", "12"), ("C", "an", "20")]) == [4]
    assert first([("A", "ab", "00"), ("B", "ab", "30")]) == []  # no arrival ends it


def test_tokens(spark):
    raw = ["17", "5i", "5n", "17I", "10p", "10PQ", " 07 n q ", "61", "—", "5ni"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").withColumn("t", S.token("raw")).orderBy("i").select("t", S.token_text("t"), S.token_text(S.token_shifted("t", F.lit(3)))).collect()
    assert [r[0] and tuple(r[0]) for r in rows] == [
        (17, "all", False, False), (5, "odd", False, False), (5, "even", False, False), (17, "odd", False, False), (10, "all", True, False), (10, "all", True, True), (7, "even", False, True), None, None, None,
    ]
    assert [r[1] for r in rows[:7]] == ["17", "5i", "5n", "17i", "10P", "10PQ", "7nQ"]
    assert spark.createDataFrame([("58n",)], "raw string").select(S.token_text(S.token_shifted(S.token("raw"), F.lit(3)))).first()[0] == "1i"


def test_both_continuation_marks_take_the_later_bound(spark):
    got = T.trips(segment(spark, [("A", "ab", "50"), ("B", "an", "10PQ")])).where("start = 350").collect()
    assert got[0]["events"][1]["minute"] == 430


def test_edits_and_structure(spark):
    rows = segment(spark, [("A", "ab", "58n"), ("B", "an", "08i"), ("B", "ab", "10i"), ("C", "an", "9n")])
    kind = "edit string, rank int, segment string, from_station string, to_station string, dep int, arr int, delta int"
    edits = spark.createDataFrame([("one", 1, "s", "A", "B", 118, 8, 3), ("again", 2, "s", "A", "B", 118, 8, 1), ("none", 3, "s", "A", "B", 58, 8, 1)], kind)
    assert {r["edit"]: r["status"] for r in T.matched(rows, edits).collect()} == {"one": "applied", "again": "stale", "none": "unmatched"}
    assert [r[0] for r in T.edited(rows, edits).orderBy("seq").select(S.token_text("token")).collect()] == ["1i", "11i", "10i", "9n"]
    # The arrival now follows the departure of its dwell, which breaks the trip: the segment stays as it was.
    assert T.compatibility(rows, T.edited(rows, edits).drop("edit")).first()["reason"] in ("count", "structure")
    assert [r[0] for r in T.composed(rows, edits).orderBy("seq").select(S.token_text("token")).collect()] == ["58n", "8i", "10i", "9n"]
    early = spark.createDataFrame([("one", 1, "s", "A", "B", 118, 8, -2)], kind)
    assert T.compatibility(rows, T.edited(rows, early).drop("edit")).first()["reason"] == ""
    same = T.distinct_trips(T.trips(rows), ["segment", "start"])
    assert same.count() == T.trips(rows).count()


def test_boards_drop_false_ends(spark):
    rows = segment(spark, [("A", "ab", "00"), ("B", "an", "10"), ("B", "ab", "12"), ("C", "an", "20")])
    got = {(r["board"], r["minute"], r["previous"], r["following"]) for r in T.board_rows(T.distinct_trips(T.trips(rows), ["start"]), ["B"], 300, 360).collect()}
    assert got == {("arrival", 310, "A", "C"), ("departure", 312, "A", "C")}
    assert [tuple(r) for r in T.line_timings(T.trips(rows).where("start < 420")).where("from_station = 'A'").collect()] == [("s", "A", "B", "05:00, 06:00", "05:10, 06:10")]


def test_dominance_example(spark):
    travel = (20, 18, 25, 20, 18)
    paths = spark.createDataFrame([(d, i, t) for i, (d, t) in enumerate(zip((303, 333, 348, 363, 393), travel, strict=True))], "dep int, path int, travel int").withColumn("od", F.lit("x"))
    day = Q.periodic(paths, "dep", 300, 1440)
    own = Q.dominance(day, ["od"], "path", "at", "travel").withColumn("demand", F.lit(1.0))
    got = {r["path"]: r for r in Q.demand_shares(own, ["od"], "dominance", "demand").collect()}
    assert [got[i]["dominance"] for i in range(5)] == [273, 300, 135, 135, 270]
    assert sum(r["instances"] for r in got.values()) == 47
    assert [round(got[i]["share"], 6) for i in range(5)] == [0.245283, 0.269542, 0.121294, 0.121294, 0.242588]
    wide = Q.minute_best(paths.withColumn("arr", F.col("dep") + F.col("travel")), ["od"], "dep", "arr", "path", 300, 420)
    assert wide.agg(F.avg("wait")).first()[0] == pytest.approx(12.625)
    per = {r["idx"]: r["n"] for r in wide.groupBy("idx").agg(F.count("*").alias("n")).collect()}
    assert sum(per[i] * travel[i] for i in range(5)) / 120 == pytest.approx(19.625) and [per[i] for i in range(5)] == [30, 30, 15, 15, 30]


def test_fitting_example(spark):
    seed, rows, columns = [[0, 4, 6], [2, 0, 3], [5, 1, 0]], [10, 6, 4], [6, 6, 8]
    cells = spark.createDataFrame([(1, f"o{i}", f"d{j}", float(seed[i][j]), float(rows[i]), float(columns[j]), i != 0 or j != 1) for i in range(3) for j in range(3)], "k int, origin string, destination string, s double, r double, c double, on boolean")
    once = {(r["origin"], r["destination"]): round(r["value"], 6) for r in D.sweeps(cells, [], "s", "r", "c", 1).collect()}
    assert [once[f"o{i}", f"d{j}"] for i in range(3) for j in range(3)] == [0, 5.142857, 5, 2.511628, 0, 3, 3.488372, 0.857143, 0]
    for fit in ("throughput", "absolute", "shrunk"):
        got = {(r["origin"], r["destination"]): round(r["value"], 6) for r in D.balanced(cells, "k", "s", "r", "c", fit).collect()}
        assert [got[f"o{i}", f"d{j}"] for i in range(3) for j in range(3)] == [0, 5.203631, 4.796369, 2.796369, 0, 3.203631, 3.203631, 0.796369, 0], fit
    assert {r["value"] for r in D.balanced(cells, "k", "s", "r", "c", "absolute", "on").where("origin = 'o0' AND destination = 'd1'").collect()} == {0.0}
    with pytest.raises(Exception, match="more than half"):
        D.throughput_seeds(spark.createDataFrame([("a", "b", 1.0, 9.0, 1.0), ("b", "a", 1.0, 1.0, 9.0)], "origin string, destination string, s double, o double, d double"), [], "s", "o", "d").collect()


def test_as_of_takes_another_train(spark):
    from pulsegrid.operators import joins as J

    rng = np.random.default_rng(3)
    a = [(i, int(rng.integers(3)), int(rng.integers(60)), int(rng.integers(3))) for i in range(60)]
    d = [(i, int(rng.integers(3)), int(rng.integers(60)), int(rng.integers(3))) for i in range(40)]
    left = spark.createDataFrame(a, "id int, s int, m int, train int").withColumn("slack", F.lit(3))
    right = spark.createDataFrame(d, "dep_id int, s int, dep int, train int")
    got = {r["id"]: r["next"] and r["next"]["dep_id"] for r in J.as_of(left, right, ["s"], "m", "dep", "slack", ["dep_id"], "train").collect()}
    for i, s, m, t in a:
        fit = [(dep, k) for k, s2, dep, t2 in d if s2 == s and t2 != t and dep >= m + 3]
        assert got[i] == (min(fit)[1] if fit else None)


def test_border_points_are_inside(spark):
    ring = spark.createDataFrame([([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0])], "xs array<double>, ys array<double>")
    points = [(0.0, 2.0), (4.0, 4.0), (2.0, 0.0), (2.0, 2.0), (4.1, 2.0), (-1.0, 0.0)]
    assert [ring.select(S.inside(F.lit(x), F.lit(y), "xs", "ys")).first()[0] for x, y in points] == [True, True, True, True, False, False]


def test_equal_shares_without_weight(spark):
    from pulsegrid.operators import aggregates as A

    rows = spark.createDataFrame([("g", n, 0, 10) for n in "abc"] + [("h", "a", 1, 100), ("h", "b", 1, 100), ("h", "c", 1, 100)], "g string, name string, w int, total int")
    got = {(r["g"], r["name"]): r["units"] for r in A.largest_remainder(rows, "g", "total", "w", "name").collect()}
    assert [got["g", n] for n in "abc"] == [3, 3, 4] and [got["h", n] for n in "abc"] == [33, 33, 34]


def legs(spark, rows):
    return spark.createDataFrame([([("a", "b", d, a, t) for d, a, t in rows],)], f"legs array<{R.LEG}>")


@pytest.mark.parametrize(("rows", "balanced", "plain"), [
    ([(0, 10, "A"), (10, 20, "A"), (25, 40, "B")], (34.666667, 0.333333, 5), (34.666667, 0.333333, 5)),
    ([(0, 10, "A"), (12, 20, "A"), (20, 30, "A")], (27.688889, 2.311111, 0), (27.666667, 2.333333, 0)),
])
def test_leg_times(spark, rows, balanced, plain):
    r = legs(spark, rows).select(R.leg_times(F.col("legs")).alias("a"), R.leg_times(F.col("legs"), rebalance=False).alias("b")).first()
    assert tuple(r["a"]) == pytest.approx(balanced, abs=1e-6) and tuple(r["b"]) == pytest.approx(plain, abs=1e-6)


def test_routes_against_exhaustive_search(spark):
    rng = np.random.default_rng(5)
    rows = []
    for trip in range(40):
        t, at = int(rng.integers(300, 500)), int(rng.integers(8))
        for _ in range(4):
            to = int(rng.integers(8))
            if to != at:
                dep = t + int(rng.integers(0, 4))
                t = dep + int(rng.integers(3, 20))
                rows.append((str(trip), str(at), str(to), dep, t))
                at = to
    con = spark.createDataFrame(rows, "trip string, from_station string, to_station string, dep int, arr int")
    stations = spark.createDataFrame([(str(i), 3) for i in range(8)], "station string, minutes int")
    got = {(r["origin"], r["destination"]): (r["arrival"], r["legs"]) for r in R.one_to_all(con, stations.select(F.col("station").alias("origin"), F.lit(320).alias("ready")), stations).collect()}
    for origin in map(str, range(8)):
        best, seen = {}, set()
        work = [(origin, 320, None)]
        while work:
            at, minute, trip = work.pop()
            for c in rows:
                ready = minute if c[0] == trip or at == origin and trip is None else minute + 3
                if c[1] == at and c[3] >= ready and (c[2], c[4], c[0]) not in seen:
                    seen.add((c[2], c[4], c[0]))
                    best[c[2]] = min(best.get(c[2], 9999), c[4])
                    work.append((c[2], c[4], c[0]))
        best.pop(origin, None)
        assert {d: a for (o, d), (a, _) in got.items() if o == origin} == best
    for (origin, destination), (arrival, path) in got.items():
        assert path[0]["from_station"] == origin and path[-1]["to_station"] == destination and path[-1]["arr"] == arrival
        assert all(a["to_station"] == b["from_station"] and a["arr"] <= b["dep"] for a, b in zip(path, path[1:]))


def plain_fit(seed, rows, columns, count):
    x = seed.copy()
    for _ in range(count):
        for axis, target in ((1, rows), (0, columns)):
            total = x.sum(axis)
            x = x * np.expand_dims(np.divide(target, total, out=np.zeros_like(total), where=total > 0), axis)
    return x


def test_fitting_converges(spark):
    """Two keys of different size, one of which converges later; the factors give what scaling the whole matrix gives."""
    rng, rows = np.random.default_rng(0), []
    want = {}
    for key, (m, n) in enumerate([(12, 9), (5, 7)]):
        seed, r, c = rng.random((m, n)) ** (1 + 6 * key) * (rng.random((m, n)) > 0.1), rng.random(m), rng.random(n)
        c *= r.sum() / c.sum()
        rows += [(key, f"o{i}", f"d{j}", float(seed[i, j]), float(r[i]), float(c[j])) for i in range(m) for j in range(n)]
        want |= {(key, f"o{i}", f"d{j}"): v for (i, j), v in np.ndenumerate(plain_fit(seed, r, c, 400))}
    df = spark.createDataFrame(rows, "k int, origin string, destination string, s double, r double, c double")
    got = D.balanced(df, "k", "s", "r", "c").collect()
    assert len(got) == len(want) and all(abs(r["value"] - want[r["k"], r["origin"], r["destination"]]) < 1e-6 for r in got)
    ends = {(r["k"], r["iterations"]) for r in got}
    assert len(ends) == 2 and all(r["error"] <= 1e-8 for r in got) and len({n for _, n in ends}) == 2


def test_a_side_without_a_target_is_emptied(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0, 0.0, 2.0), (1, "b", "x", 3.0, 2.0, 2.0), (1, "b", "y", 5.0, 2.0, 0.0)], "k int, origin string, destination string, s double, r double, c double")
    assert {(r["origin"], r["destination"]): r["value"] for r in D.balanced(df, "k", "s", "r", "c").collect()} == {("a", "x"): 0, ("b", "x"): 2, ("b", "y"): 0}


def test_greedy_caps_and_events(spark):
    c = spark.createDataFrame([(i, i, i % 2, 1) for i in range(8)], "candidate long, rank int, year int, all int")
    events = spark.createDataFrame([(i, i // 2) for i in range(8)], "candidate long, event int")
    ids = lambda df: sorted(r["candidate"] for r in df.collect())
    assert ids(Z.capped(c, events, {"all": 3}, 99)) == [0, 2, 4]
    assert ids(Z.capped(c, events, {"year": 2}, 99)) == [0, 2, 5, 7]
    assert ids(Z.capped(c, events, {}, 2)) == [0, 2]


def example_edits(seed):
    rng = np.random.default_rng(seed)
    effects = [(i, "near" if i % 3 == 0 else "existing", f"a{rng.integers(9)}", f"d{rng.integers(9)}", int(rng.integers(-4, 3)) if i % 3 == 0 else int(rng.integers(4, 20)), 4, float(rng.integers(1, 9))) for i in range(50)]
    probes = [(c, k, int(d)) for c in range(14) for d in [rng.choice([-4, -3, -2, -1, 1, 2, 3, 4])] for k in (f"a{rng.integers(9)}", f"d{rng.integers(9)}")]
    return effects, probes


def plain_score(effects, probes, c, shifts):
    """The reference rule in plain loops: the change of the objective and the passengers of broken transfers."""

    def worth(source, wait, least, pax, now):
        if source == "near":
            return pax * (max(0, least - wait) - max(0, least - now)), 0.0
        return (-pax * (least - now + 60), pax) if now < least else (pax * (wait - now), 0.0)

    trial = dict(shifts)
    for x, k, d in probes:
        if x == c:
            trial[k] = trial.get(k, 0) + d
    keys, gain, broken = {k for x, k, _ in probes if x == c}, 0.0, 0.0
    for _, source, a, d, wait, least, pax in effects:
        if a in keys or d in keys:
            before, _ = worth(source, wait, least, pax, wait + shifts.get(d, 0) - shifts.get(a, 0))
            after, lost = worth(source, wait, least, pax, wait + trial.get(d, 0) - trial.get(a, 0))
            gain, broken = gain + after - before, broken + lost
    return gain, broken, trial


EFFECT, PROBE = "effect int, source string, arr_key string, dep_key string, wait int, least int, pax double", "candidate long, key string, delta int"


@pytest.mark.parametrize("seed", [1, 4])
def test_multi_pass_selection_equals_one_by_one(spark, seed):
    effects, probes = example_edits(seed)
    allow = 6.0
    shifts, used, want, gone = {}, set(), {}, set()
    for turn in range(1, 5):
        took = False
        for c in range(14):
            if c in gone:
                continue
            gain, broken, trial = plain_score(effects, probes, c, shifts)
            keys = {k for x, k, _ in probes if x == c}
            status = "breaks" if broken > allow else "deferred" if gain <= 0 else "stale" if keys & used else "accepted"
            want[c] = (status, turn, round(gain, 9))
            if status != "deferred":
                gone.add(c)
            if status == "accepted":
                shifts, used, took = trial, used | keys, True
        if not took:
            break
    ranks = spark.createDataFrame([(c, c) for c in range(14)], "candidate long, rank int")
    got = Z.greedy(spark.createDataFrame(effects, EFFECT), spark.createDataFrame(probes, PROBE), ranks, allow_broken=allow, passes=4)
    assert {r["candidate"]: (r["status"], r["pass"], round(r["marginal"], 9)) for r in got.collect()} == want
    assert {w[0] for w in want.values()} >= {"accepted"}


def chained_edits(n, chain):
    """``n`` candidates with three effects each; each of the first ``chain`` also shares an effect with the next, so that they are decided one after the other."""
    effects = [(f"{c}/{i}", "existing", f"a{c}/{i}", f"d{c}", 20, 4, 1.0) for c in range(n) for i in range(3)] + [(f"{c}-", "existing", f"b{c + 1}", f"d{c}", 20, 4, 1.0) for c in range(chain - 1)]
    probes = [(c, f"d{c}", -2) for c in range(n)] + [(c, f"b{c}", 1) for c in range(1, chain)]
    return effects, probes


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_rounds_of_a_selection_do_not_exchange_all_rows(spark):
    """A longer chain of candidates means more rounds, but each exchanges only what it decides."""
    made, broadcast = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        for chain in (2, 10):
            effects, probes = chained_edits(4000, chain)
            ranks = spark.createDataFrame([(c, c) for c in range(4000)], "candidate long, rank int")
            before = shuffled(spark)
            got = Z.greedy(spark.createDataFrame(effects, EFFECT.replace("effect int", "effect string")), spark.createDataFrame(probes, PROBE), ranks, passes=1).collect()
            made.append(shuffled(spark) - before)
            assert len(got) == 4000 and {r["status"] for r in got} == {"accepted"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert made[1] < 1.5 * made[0], made


def test_levels_of_candidates(spark):
    """A candidate's level is above that of all before it on each of its links; a link of many is a chain, one of none or of one makes none wait."""
    links = [(c, c, "all") for c in range(0, 8, 2)] + [(c, c, f"own{c}") for c in range(10)] + [(1, 1, "x"), (6, 6, "x"), (6, 6, "x"), (7, 7, "x"), (9, 9, None), (8, 8, None)]
    from pulsegrid.plans.inputs import shared_folder

    got, depth = Z.levels(spark.createDataFrame(links, "candidate long, rank int, link string"), shared_folder(spark, "levels"))
    assert {r["candidate"]: r["level"] for r in got.collect()} == {2: 1, 4: 2, 6: 3, 7: 4} and depth == 5


def test_multi_pass_selection_with_trials(spark):
    """Each candidate also edits a section of one of four segments; a trial refuses those that change the runs, and the order is still one by one."""
    from pulsegrid.operators import timetable as T

    effects, probes = example_edits(11)
    table = [(f"s{k}", i, st, kind, tok) for k in range(4) for i, (st, kind, tok) in enumerate([("a", "ab", "0"), ("b", "an", "10"), ("b", "ab", "12"), ("c", "an", "20"), ("c", "ab", "21"), ("d", "an", "40")])]
    rows = spark.createDataFrame(table, "segment string, seq int, station string, kind string, text string").withColumn("token", S.token("text")).drop("text").cache()
    places = [("a", "b", 0, 10), ("b", "c", 12, 20), ("c", "d", 21, 40)]
    edits = [(c, f"s{c % 4}", *places[c // 4 % 3], (1, 5, -1, 1, 2, -3, 1)[c % 7]) for c in range(14)]
    own = spark.createDataFrame(edits, "edit long, segment string, from_station string, to_station string, dep int, arr int, delta int").cache()

    def fits(taken, new):
        made = own.where(F.col("edit").isin([*taken, new])).withColumn("rank", F.when(F.col("edit") == new, 1).otherwise(0))
        applies = T.matched(rows, made).where((F.col("edit") == new) & (F.col("status") == "applied")).count()
        return bool(applies) and not T.compatibility(rows, T.edited(rows, made).drop("edit")).where("reason <> ''").count()

    shifts, used, want, taken = {}, set(), {}, []
    for c in range(14):
        gain, broken, moved = plain_score(effects, probes, c, shifts)
        keys = {k for x, k, _ in probes if x == c}
        status = "breaks" if broken > 99 else "deferred" if gain <= -1e9 else "stale" if keys & used else "accepted" if fits(taken, c) else "structure"
        want[c] = status
        if status == "accepted":
            shifts, used = moved, used | keys
            taken.append(c)
    ranks = spark.createDataFrame([(c, c) for c in range(14)], "candidate long, rank int")
    apart = own.select(F.col("edit").alias("candidate"), F.col("segment").alias("link"))
    got = Z.greedy(spark.createDataFrame(effects, EFFECT), spark.createDataFrame(probes, PROBE), ranks, least=-1e9, allow_broken=99.0, passes=1, apart=apart, refused=Z.trial(rows, own))
    assert {r["candidate"]: r["status"] for r in got.collect()} == want
    assert {"structure", "accepted"} <= set(want.values())


def test_trials_exchange_only_the_segments_of_new_candidates(spark):
    """The same two candidates are tried on timetables of few and of many segments, all of which have an edit; one of them changes its segment's runs."""
    made, broadcast = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        for n in (10, 1000):
            table = [(f"s{k}", i, st, kind, tok) for k in range(n) for i, (st, kind, tok) in enumerate([("a", "ab", "0"), ("b", "an", "10"), ("b", "ab", "12"), ("c", "an", "20")])]
            rows = spark.createDataFrame(table, "segment string, seq int, station string, kind string, text string").withColumn("token", S.token("text")).drop("text")
            edits = [(c, f"s{c}", *(("a", "b", 0, 10) if c % 2 else ("b", "c", 12, 20)), 1 if c != 4 else -3) for c in range(n)]
            own = spark.createDataFrame(edits, "edit long, segment string, from_station string, to_station string, dep int, arr int, delta int")
            refused, ids = Z.trial(rows, own), lambda *c: spark.createDataFrame([(x,) for x in c], "candidate long")
            before = shuffled(spark)
            assert [r["candidate"] for r in refused(ids(5, 7), ids(3, 4)).collect()] == [4]
            made.append(shuffled(spark) - before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert made[1] < 1.5 * made[0], made


def test_best_first_equals_brute_force(spark):
    effects, probes = example_edits(7)
    shifts, want = {}, []
    for _ in range(3):
        scores = {c: plain_score(effects, probes, c, shifts) for c in range(14) if c not in [x for x, _ in want]}
        fine = [c for c in scores if scores[c][1] == 0 and scores[c][0] > 0]
        if not fine:
            break
        best = min(fine, key=lambda c: (-scores[c][0], c))
        want.append((best, scores[best][0]))
        shifts = scores[best][2]
    assert want and Z.best_first(spark.createDataFrame(effects, EFFECT), spark.createDataFrame(probes, PROBE), 3) == want


def test_contours_lie_on_the_level(spark):
    grid = G.raster(spark, 0.0, 0.0, 1.0, 9, 9).withColumn("value", F.col("x") * 0.7 + F.col("y") * 0.3 + 0.01)
    got = G.contour_segments(grid, 3.0).collect()
    assert got and all(abs(x * 0.7 + y * 0.3 + 0.01 - 3) < 1e-9 for r in got for x, y in ((r["x1"], r["y1"]), (r["x2"], r["y2"])))


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,x\nA,1\nB,\n", encoding="utf-8")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv")).orderBy("name").collect()] == [("A", "1"), ("B", "")]
    (tmp_path / "t.csv").write_text("Bern,an\nBern,ab,17,26Q\n\nOlten,an,40\n")
    assert [tuple(r) for r in readers.headed_rows(spark, str(tmp_path / "t.csv"), 4).orderBy("rownum").collect()] == [(1, "Bern", "an", "", ""), (2, "Bern", "ab", "17", "26Q"), (4, "Olten", "an", "40", "")]
    (tmp_path / "w.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="too many cells"):
        readers.headed_rows(spark, str(tmp_path / "w.csv"), 2).collect()
    (tmp_path / "m.csv").write_text("o,A,B\nA,0,x\nB,2.5,0\n")
    assert {(r[0], r[1]): r[2] for r in readers.matrix(spark, str(tmp_path / "m.csv")).collect()} == {("A", "A"): 0, ("A", "B"): 0, ("B", "A"): 2.5, ("B", "B"): 0}
    (tmp_path / "z.txt").write_text("* comment\n 1 2  3.5\n1 x 4\n$\n5 6\n7 8 9\n")
    assert sorted(tuple(r) for r in readers.whitespace_matrix(spark, str(tmp_path / "z.txt")).collect()) == [(1, 2, 3.5), (7, 8, 9.0)]
    (tmp_path / "j.js").write_text('var data = {"a": 3, "b": [1, 2]};')
    assert readers.assigned_json(spark, str(tmp_path / "j.js"), "data", "a INT, b ARRAY<INT>").first()["b"] == [1, 2]
    (tmp_path / "l.tex").write_text("\\label{tab:x} a & b \\\\ 1 & 2 \\\\ \\hline \\end{table}")
    assert [(r["c0"], r["c1"]) for r in readers.latex_rows(spark, str(tmp_path / "l.tex"), "tab:x", 2).orderBy("n").collect()] == [("a", "b"), ("1", "2")]


def test_nested_sources(spark, tmp_path):
    cell = json.dumps({"same_station": False, "path_count": 1, "daily_demand_total": 4.0, "paths": [{"dep_min": 300, "arr_min": 320, "num_transfers": 0, "line_names": ["A"]}]})
    with gzip.open(tmp_path / "row_000001.json.gz", "wt") as f:
        json.dump({"row_idx": 1, "origin": "A", "year": "2026", "cells": [cell, None]}, f)
    assert [(r["col_idx"], r["dep_min"], r["daily_demand_total"]) for r in readers.row_states(spark, str(tmp_path / "row_000001.json.gz")).collect()] == [(0, 300, 4.0)]
    cube = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "value array<double>")
    assert [tuple(r) for r in readers.statistics_cube(cube, "value", [2, 3], ["y", "k"], [["a", "b"], ["p", "q", "r"]]).where("y = 'b'").collect()] == [("b", "p", 4.0), ("b", "q", 5.0), ("b", "r", 6.0)]
    ring = readers.polygons(spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 4))",)], "w string"), "w").select(S.ring_area("xs", "ys"), S.inside(F.lit(1.0), F.lit(1.0), "xs", "ys")).first()
    assert tuple(ring) == (16.0, True)
    made = []
    for _ in range(2):
        readers.fingerprinted(spark, f"file://{tmp_path}/kept", lambda: made.append(1) or spark.range(3), "v1").count()
    assert made == [1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "B", 1.0), ("B", "A", 2.25)], "origin string, destination string, value double")
    writers.csv(df, f"{tmp_path}/c", ["value", "none", "origin"])
    assert sorted(tuple(r) for r in readers.csv(spark, f"{tmp_path}/c").collect()) == [("1.0", "", "A"), ("2.25", "", "B")]
    writers.ragged_csv([df, df.select("origin", F.lit(7).alias("extra"))], f"{tmp_path}/r")
    assert readers.csv(spark, f"{tmp_path}/r").columns == ["origin", "destination", "value", "extra"]
    writers.matrix(df, f"{tmp_path}/m", ["A", "B"], 2)
    assert sorted(tuple(r) for r in readers.csv(spark, f"{tmp_path}/m").collect()) == [("A", "", "1.00"), ("B", "2.25", "")]
    for n in (1, 2):
        writers.replaced(df.limit(n), f"{tmp_path}/p")
        assert readers.current(spark, f"{tmp_path}/p").count() == n
    assert readers.current(spark, f"{tmp_path}/none") is None
    writers.json_rows(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_streams_equal_batches(spark, tmp_path):
    schema = "k string, w double, m int, ts timestamp"
    rows = [(f"k{i % 3}", float(i), i % 7 or None, None) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = incremental.files(spark, f"{tmp_path}/in", schema, 1)
    incremental.merged(stream.select("k", "w", "m"), f"{tmp_path}/state", f"{tmp_path}/c1", ["k"], ["w"], ["m"]).awaitTermination()
    got = {r["k"]: (r["w"], r["m"]) for r in readers.current(spark, f"{tmp_path}/state").collect()}
    assert got == {k: (sum(w for a, w, _, _ in rows if a == k), min(m for a, _, m, _ in rows if a == k and m)) for k in ("k0", "k1", "k2")}
    for _ in range(2):
        incremental.appended(incremental.files(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60
