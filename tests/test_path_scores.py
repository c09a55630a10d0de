"""Edits scored on paths, together and one by one, against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import path_scores as X
from pulsegrid.operators import timetable as T

LEGS = "array<struct<line:string,trip:string,from_station:string,to_station:string,dep:int,arr:int>>"
EDIT = "edit string, line string, from_station string, to_station string, dep int, arr int, delta int"
MINUTES = {("a", "a"): 4, ("b", "b"): 3, ("c", "c"): 5, ("b", "c"): 7}


def paths_of(seed, n=120):
    rnd, out = random.Random(seed), []
    for i in range(n):
        t, legs, at = rnd.randrange(300, 330), [], rnd.choice("abc")
        for _ in range(rnd.randrange(1, 4)):
            line, to = rnd.choice("LM"), rnd.choice("abc")
            arr = t + rnd.choice([0, 5, 10])
            legs.append((line, rnd.choice("xy"), at, to, t, arr))
            at = "c" if to == "b" and rnd.random() < 0.3 else to
            t = arr + rnd.choice([0, 3, 5, 8])
        out.append((str(i), legs, rnd.choice([0.0, 1.0, 2.5])))
    return out


def edits_of(paths, seed, n=25):
    rnd = random.Random(seed)
    keys = sorted({(leg[0], leg[2], leg[3], leg[4] % 120, leg[5] % 120) for _, legs, _ in paths for leg in legs})
    return [(f"e{i:02d}", *k, rnd.choice([-3, -2, -1, 1, 2, 3])) for i, k in enumerate(rnd.sample(keys, n))]


def times(legs):
    """Minutes and rolling share of a path, or None where it does not hold."""
    ok = all(a[5] >= a[4] for a in legs)
    for a, b in zip(legs, legs[1:]):
        need = 0 if a[1] == b[1] else MINUTES.get((a[3], b[2]))
        ok = ok and need is not None and b[4] >= a[5] + need
    total = legs[-1][5] - legs[0][4]
    if not ok or total <= 0:
        return None
    roll = sum(a[5] - a[4] for a in legs)
    dwell = sum(b[4] - a[5] for a, b in zip(legs, legs[1:]) if a[1] == b[1])
    z = sum(a[5] == a[4] for a in legs) / 3
    k = sum(b[4] == a[5] for a, b in zip(legs, legs[1:]) if a[1] == b[1]) / 3
    rolling = z if roll + dwell == 0 else max(0, roll + z - (z + k) * roll / (roll + dwell))
    return total, rolling / total


def shifted(legs, shifts):
    out = []
    for line, trip, a, b, dep, arr in legs:
        by = shifts.get((line, a, b, dep % 120, arr % 120), 0)
        out.append((line, trip, a, b, dep + by, arr + by))
    return out


def plain_marginal(paths, candidates, accepted):
    base, out = {e[1:6]: e[6] for e in accepted}, {}
    for name, *key, delta in candidates:
        sums = defaultdict(float)
        for _, legs, weight in paths:
            if weight <= 0 or tuple(key) not in {(x[0], x[2], x[3], x[4] % 120, x[5] % 120) for x in legs}:
                continue
            was, now = times(shifted(legs, base)), times(shifted(legs, base | {tuple(key): delta}))
            if was is None:
                continue
            sums["pax"] += weight
            sums["paths"] += 1
            if now is None:
                sums["invalidated"] += weight
            else:
                sums["saved"] += (was[0] - now[0]) * weight
                sums["rolling"] += (now[1] - was[1]) * weight
        out[name] = (sums["paths"], sums["pax"], sums["saved"], sums["invalidated"], sums["rolling"] / sums["pax"] if sums["pax"] else 0.0)
    return out


def plain_combined(paths, accepted):
    base, sums = {e[1:6]: e[6] for e in accepted}, defaultdict(float)
    for _, legs, weight in paths:
        moved = shifted(legs, base)
        if weight <= 0 or moved == legs or times(legs) is None:
            continue
        was, now = times(legs), times(moved)
        sums["pax"] += weight
        if now is None:
            sums["invalidated"] += weight
        else:
            sums["saved"] += (was[0] - now[0]) * weight
    return sums["pax"], sums["saved"], sums["invalidated"]


def frames(spark, paths, edits):
    transfers = spark.createDataFrame([(*k, m) for k, m in MINUTES.items()], "from_station string, to_station string, minutes int")
    ready = X.prepared(spark.createDataFrame(paths, f"path string, legs {LEGS}, weight double"), transfers).cache()
    return ready, X.sections(ready).cache(), spark.createDataFrame(edits, EDIT)


@pytest.mark.parametrize("seed", range(2))
def test_scores_equal_a_loop(spark, seed):
    paths = paths_of(seed)
    edits = edits_of(paths, seed)
    ready, index, df = frames(spark, paths, edits)
    for accepted in ([], edits[:9]):
        names = [e[0] for e in accepted]
        rest = [e for e in edits if e[0] not in names]
        got = {r["edit"]: (r["paths"], r["pax"], r["saved"], r["invalidated"], r["rolling_share_change"]) for r in X.marginal(ready, index, df.where(~F.col("edit").isin(names)), df.where(F.col("edit").isin(names))).collect()}
        want = plain_marginal(paths, rest, accepted)
        assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)
        assert any(v[3] for v in want.values()) and any(v[2] for v in want.values())
    totals, broken = X.combined(ready, index, df)
    r = totals.first()
    assert (r["pax"], r["saved"], r["invalidated"]) == pytest.approx(plain_combined(paths, edits))
    assert broken.count() and X.combined(ready, index, df.where("false"))[0].first()["paths"] == 0


def plain_best_first(paths, edits, most, floor, apart=True):
    taken, gone, out, total = [], set(), [], 0.0
    while len(taken) < most:
        used = {k for e in taken for k in (f"{e[2]}{e[4]}", f"{e[3]}{e[5]}")}
        open_ = [e for e in edits if e not in taken and e[0] not in gone and not (apart and {f"{e[2]}{e[4]}", f"{e[3]}{e[5]}"} & used)]
        scores = plain_marginal(paths, open_, taken)
        ranked = sorted((e for e in open_ if scores[e[0]][2] >= floor and scores[e[0]][3] <= 0 and scores[e[0]][1] > 0), key=lambda e: (-scores[e[0]][2], -scores[e[0]][1], abs(e[6]), e[0]))
        for e in ranked:
            pax, saved, invalidated = plain_combined(paths, [*taken, e])
            if invalidated > 0 or saved - total < floor:
                gone.add(e[0])
                out.append((e[0], "refused"))
                continue
            total = saved
            taken.append(e)
            out.append((e[0], "taken"))
            break
        else:
            break
    return out


@pytest.mark.parametrize("tried", [1, 32])
def test_best_first_equals_a_loop(spark, tried, monkeypatch):
    monkeypatch.setattr(X, "TRIED", tried)
    paths = paths_of(5, 60)
    edits = edits_of(paths, 6, 60)
    ready, index, df = frames(spark, paths, edits)
    events = df.select("edit", F.explode(F.array(F.concat("from_station", F.col("dep").cast("string")), F.concat("to_station", F.col("arr").cast("string")))).alias("event"))
    got = X.best_first(ready, index, df, events, 3, least=0.5, least_saved=0.5).collect()
    want = plain_best_first(paths, edits, 3, 0.5)
    assert [(r["edit"], "taken" if r["status"] == "taken" else "refused") for r in got] == want and len(want) == 3


def test_an_edit_that_breaks_the_structure_is_not_taken(spark):
    """The trial expands only the segments of the new edit and refuses one that makes a train leave before it comes."""
    rows = [("s", i, st, kind, S_token) for i, (st, kind, S_token) in enumerate([("a", "ab", "0"), ("b", "an", "10"), ("b", "ab", "11"), ("c", "an", "20")])]
    rows += [("t", i, st, kind, tok) for i, (st, kind, tok) in enumerate([("a", "ab", "5"), ("c", "an", "25")])]
    table = spark.createDataFrame(rows, "segment string, seq int, station string, kind string, text string").withColumn("token", S.token("text")).drop("text")
    edits = spark.createDataFrame([("late", "s", "a", "b", 0, 10, 5), ("fine", "s", "a", "b", 0, 10, 1), ("other", "t", "a", "c", 5, 25, 2), ("none", "t", "a", "c", 6, 25, 2)], "edit string, segment string, from_station string, to_station string, dep int, arr int, delta int")
    fits = X.trial(table, edits)
    assert T.matched(table, edits.withColumn("rank", F.col("edit"))).count() >= 4
    assert fits([], "fine") and fits([], "other") and not fits([], "none")
    assert not fits([], "late") and not fits(["fine"], "late")
    paths = [("p", [("s", "x", "a", "b", 300, 310), ("s", "y", "b", "c", 340, 350)], 1.0)]
    ready, index, _ = frames(spark, paths, [("z", "s", "a", "b", 60, 70, 1)])
    found = spark.createDataFrame([("late", "s", "a", "b", 60, 70, 5), ("fine", "s", "a", "b", 60, 70, 1)], EDIT)
    got = X.best_first(ready, index, found, found.select("edit", F.col("edit").alias("event")), 1, fits=lambda taken, new: new != "late").collect()
    assert [(r["edit"], r["status"]) for r in got] == [("late", "structure"), ("fine", "taken")]
