"""Queries that take all rows of their tables, against brute force on small tables."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import joins as J
from pulsegrid.operators import profiles as P
from pulsegrid.operators import routing as R
from pulsegrid.plans import registry


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with a table of events, and its rows: id, trip, type, minute of the day."""
    rows = [(i, i * 13 % 101, ("view", "purchase", "click")[i % 3], i * 37 % 240 + 300) for i in range(1, 400)]
    at = lambda m: datetime.datetime(2024, 1, 1, m // 60, m % 60)
    path = str(tmp_path_factory.mktemp("events"))
    table = spark.createDataFrame([(i, trip, kind, at(m), 1.0) for i, trip, kind, m in rows], "event_id bigint, user_id bigint, event_type string, ts timestamp, value double")
    table.write.parquet(f"{path}/events.parquet")
    return path, rows


def test_near_misses_of_all_trips(spark, events):
    path, rows = events
    want = {
        (i, j, n - m) for i, t, kind, m in rows for j, u, other, n in rows
        if (kind, other) == ("view", "purchase") and i % 11 == j % 11 and t % 7 != u % 7 and -5 <= n - m <= 3 + i % 11 % 4 + 10
    }
    got = [tuple(r) for r in registry.QUERIES["near_miss_all_trips"](spark, path).select("arrival", "departure", "gap").collect()]
    assert len(got) == len(want) and set(got) == want
    trip = {i: t for i, t, *_ in rows}
    assert any(trip[i] % 20 != trip[j] % 20 for i, j, _ in got)


def test_a_band_exchanges_in_proportion_to_its_input(spark):
    """Also where the smaller of two tables would go to all tasks and the larger would not."""
    made, broadcast = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        for n in (2000, 8000):
            at = spark.range(n).select((F.col("id") % 11).alias("station"), (F.col("id") * 37 % 1440).cast("int").alias("minute"), "id")
            a = at.select("station", F.col("id").alias("arrival"), F.col("minute").alias("arr"), F.lit(3).alias("least"))
            d = at.select("station", F.col("id").alias("departure"), F.col("minute").alias("dep"))
            before = spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
            J.band(a, d, ["station"], 5, 10, "least").write.format("noop").mode("overwrite").save()
            made.append(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite() - before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert 0 < made[1] < 6 * made[0], made


def test_best_departure_of_all_lines(spark, events):
    path, rows = events
    copies = [(i % 11, m % 120 + 300 + cycle, m % 120 + 310 + i % 40 + cycle, i) for i, _, kind, m in rows if kind == "purchase" for cycle in (0, 120)]
    want = {}
    for station in {s for s, *_ in copies}:
        for minute in range(300, 420):
            arr, dep, idx = min((arr, dep, i) for s, dep, arr, i in copies if s == station and dep >= minute)
            want[station, minute] = (arr, dep, idx, dep - minute)
    got = {(r["station"], r["minute"]): (r["arr"], r["dep"], r["idx"], r["wait"]) for r in registry.QUERIES["best_departure_all_lines"](spark, path).collect()}
    assert got == want
    line = {i: t % 7 for i, t, *_ in rows}
    assert any(line[idx] >= 3 for _, _, idx, _ in got.values())


@pytest.mark.parametrize("unreached", [False, True])
def test_routes_of_a_large_timetable(spark, monkeypatch, unreached):
    """Beyond the timetable that a task may hold, the routes are the same, legs included."""
    rng = np.random.default_rng(7)
    rows = []
    for trip in range(150):
        t, at = int(rng.integers(300, 700)), int(rng.integers(9))
        for _ in range(5):
            to, dep = int(rng.integers(9)), t + int(rng.integers(0, 4))
            t = dep + int(rng.integers(1, 30))
            if to != at:
                rows.append((str(trip), str(at), str(to), dep, t))
            at = to
    rows += [("last", "x", "y", 900, 910)] * unreached
    con = spark.createDataFrame(rows, "trip string, from_station string, to_station string, dep int, arr int").repartition(7)
    stations = spark.createDataFrame([(str(i), 3) for i in range(9)], "station string, minutes int")
    asked = stations.select(F.col("station").alias("origin"), F.explode(F.array(F.lit(320), F.lit(500))).alias("ready"))
    found = lambda: sorted(map(str, R.one_to_all(con, asked, stations).collect()))
    want = found()
    assert len(want) > 100
    monkeypatch.setattr(P, "TOGETHER", 2)
    assert found() == want


def test_probes_of_both_ends_without_a_sort_of_the_hits(spark):
    """Of an effect at both ends the later counts, of a section without an end the other; the hits are not shuffled again."""
    candidates = [(c, c % 3, c % 5, (c + 1) % 3 if c % 7 else None, (c + 2) % 5) for c in range(60)]
    effects = [(e, s, m, side, float(e)) for e in range(20) for s in range(3) for m in range(5) for side in ("ab", "an") if (e * 7 + s * 5 + m * 3 + (side == "an")) % 4 == 0]
    got = J.clockface_probes(
        spark.createDataFrame(candidates, "candidate int, from_station int, from_mod int, to_station int, to_mod int"), spark.createDataFrame(effects, "effect int, station int, mod int, side string, pax double"), ["station", "mod"], "effect", "candidate"
    )
    want = {}
    for c, *ends in candidates:
        for k, side in ((0, "ab"), (2, "an")):  # the later replaces the former
            want |= {(c, e): (s, m, d, p) for e, s, m, d, p in effects if d == side and [s, m] == ends[k : k + 2]}
    rows = got.select("candidate", "effect", "station", "mod", "side", "pax").collect()
    assert len(rows) == len(want) and {(r[0], r[1]): tuple(r[2:]) for r in rows} == want
    assert {r[4] for r in rows} == {"ab", "an"} and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """A folder with a table of 15,000 events of a few minutes, whose ids, trips and values are in no order."""
    path, mixed = str(tmp_path_factory.mktemp("crowded")), lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_000))
    kind = F.element_at(F.array(*map(F.lit, ("view", "purchase", "click"))), (mixed(0) % 3 + 1).cast("int"))
    ts = F.timestamp_seconds(1_704_100_000 + mixed(1) % 6 * 60)
    table = spark.range(15_000).select((mixed(2) * 15_000 + F.col("id")).alias("event_id"), mixed(3).alias("user_id"), kind.alias("event_type"), ts.alias("ts"), (mixed(4) / 7).alias("value"))
    table.write.parquet(f"{path}/events.parquet")
    return path


def bytes_a_row(df, path):
    df.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / df.sparkSession.read.parquet(str(path)).count()


def test_pairs_are_those_of_a_join(spark, monkeypatch):
    """Also of keys with several blocks, with rows that stand twice and with nulls."""
    monkeypatch.setattr(J, "BLOCK", 2)
    monkeypatch.setattr(J, "HELD", 6)
    left = spark.createDataFrame([(i % 5 or None, i % 2, i // 2 % 15 or None) for i in range(80)], "k int, m int, a int")
    right = spark.createDataFrame([(i % 6 or None, i % 3, i // 3 % 9 or None) for i in range(60)], "k int, n int, b int")
    want = left.join(right, "k").where("n >= m")
    got = J.pairs(left, right, ["k"], ["m"], ["n"], F.col("n") >= F.col("m"))
    assert got.columns == want.columns and want.count() > 300
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_probes_take_little_room(spark, crowded, tmp_path):
    """Rows of the probes are far more than the events, so their files are what fills a disk."""
    assert bytes_a_row(registry.QUERIES["clockface_effect_probes"](spark, crowded), tmp_path / "out") < 0.8


def test_near_misses_take_little_room(spark, crowded, tmp_path):
    """Rows of the near misses are far more than the events, so their files are what fills a disk."""
    assert bytes_a_row(registry.QUERIES["near_miss_all_trips"](spark, crowded), tmp_path / "out") < 0.8


def test_components_ask_for_their_edges_once(spark):
    """Labels of a chain take several rounds; its edges are read in one."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], "a string, b string").mapInArrow(run, "a string, b string")
    got = R.components(edges, spark.createDataFrame([(f"n{i:02}",) for i in range(21)], "node string")).collect()
    assert {r["component"] for r in got} == {"n00"} and len(got) == 21
    assert seen.value <= 2 * 20  # either direction
