"""Trips of whole batches of segments beside a plain walk, and what the operators on them keep."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import expansion
from pulsegrid.operators import timetable as T

MARKS = ["", "i", "n", "P", "q", "PQ"]


def tokens(rows):
    """(station, kind, minute, parity, p, q) of one segment."""
    return [(s, k, int(raw.rstrip("inPqQ")), 0 if "n" in raw else 1 if "i" in raw else None, "P" in raw, "q" in raw.lower()) for s, k, raw in rows]


def walked(rows):
    """All trips of one segment, one event after the other."""
    r, out = tokens(rows), []
    fits = lambda x, t: t < 1440 if x[1] == "ab" else t <= 1560
    minutes = lambda x: [t for h in range(5, 27) for t in [h * 60 + x[2]] if x[3] in (None, h % 2) and fits(x, t)]
    for i, first in enumerate(r):
        for start in minutes(first) if first[1] == "ab" else []:
            events = [(first[0], "ab", start)]
            for j in range(i + 1, len(r)):
                x, (station, kind, last) = r[j], events[-1]
                dwell = station == x[0] and station is not None and kind == "an" and x[1] == "ab"
                least = max(last + (not dwell), (last // 60 + 1) * 60 if x[4] else 0, last + 60 if x[5] else 0)
                at = next((t for t in minutes(x) if t >= least), None)
                turns = 2 <= j < len(r) - 1 and [r[j + d][1] for d in (-2, -1, 0, 1)] == ["ab", "an", "ab", "an"] and None not in (r[j][0], r[j + 1][0]) and r[j - 1][0] == r[j][0] and r[j - 2][0] == r[j + 1][0]
                if at is None or dwell and (turns or at - last > 15):
                    break
                events.append((x[0], x[1], at))
            if len(events) > 1 and events[-1][1] == "an":
                out.append((i, start, events))
    return out


def segments(seed, n, most):
    pick = random.Random(seed)
    return {f"s{i}": [(pick.choice(["A", "B", "C", None]), pick.choice(["an", "ab"]), f"{pick.randrange(60)}{pick.choice(MARKS)}") for _ in range(pick.randrange(1, most))] for i in range(n)}


def frame(spark, made):
    rows = [(name, i, *r) for name, rows in made.items() for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "segment string, seq int, station string, kind string, raw string").withColumn("token", S.token("raw"))


@pytest.mark.parametrize("sizes", [(16_384, 262_144), (7, 20)])
def test_trips_equal_a_plain_walk(spark, monkeypatch, sizes):
    made = segments(5, 60, 12) | segments(6, 1, 2) | {"long": segments(7, 1, 120)["s0"]}
    bounds = (T.DAY_START, T.DEPARTURE_END, T.ARRIVAL_END, T.HOURS, T.DWELL_MOST)
    monkeypatch.setattr(expansion, "ROWS", sizes[0])
    monkeypatch.setattr(expansion, "EVENTS", sizes[1])
    table = frame(spark, made).groupBy("segment").agg(T._collected().alias("rows")).toArrow()
    got = {(r["segment"], r["start_seq"], r["start"]): [tuple(e.values()) for e in r["events"]] for b in expansion.expanded(bounds, None)(iter(table.to_batches())) for r in b.to_pylist()}
    want = {(name, i, start): events for name, rows in made.items() for i, start, events in walked(rows)}
    assert got == want
    assert {(r["segment"], r["start_seq"], r["start"]): [tuple(e) for e in r["events"]] for r in T.trips(frame(spark, made)).collect()} == want


def test_structure_keeps_each_shape_once(spark):
    made = segments(11, 40, 10)
    for r in T.structure(frame(spark, made)).collect():
        trips = [e for _, _, e in walked(made[r["segment"]])]
        text = lambda e: "|".join(f"{s}:{k}" if s else k for s, k, _ in e) + "#" + ",".join(str(b[2] - a[2]) for a, b in zip(e, e[1:], strict=False) if (a[1], b[1]) == ("ab", "an"))
        shapes = sorted(map(text, trips))
        dwells = [b[2] - a[2] for e in trips for a, b in zip(e, e[1:], strict=False) if (a[1], b[1]) == ("an", "ab") and a[0] == b[0] and a[0]]
        assert (r["n"], r["low"], r["high"]) == (len(trips), min(dwells, default=None), max(dwells, default=None))
        assert (r["shapes"] and [tuple(x) for x in r["shapes"]]) == ([(x, shapes.count(x)) for x in sorted(set(shapes))] or None)
        kinds = [k for _, k, _ in made[r["segment"]]]
        assert (r["alternates"], r["ends"]) == (all((k == "ab") == (i % 2 == 0) for i, k in enumerate(kinds)), kinds[-1] == "an")


def test_shown_trips_alone_give_the_same_boards_and_timings(spark):
    rows = frame(spark, segments(13, 30, 10))
    order = ["segment", "start_seq", "start"]
    all_of, shown = T.distinct_trips(T.trips(rows), order), T.distinct_trips(T.trips(rows, until=420), order)
    assert 0 < shown.count() < all_of.count()
    boards = [sorted(map(str, T.board_rows(x, ["A", "B"], 300, 420).collect())) for x in (all_of, shown)]
    timings = [sorted(map(str, T.line_timings(x).collect())) for x in (all_of, shown)]
    assert boards[0] == boards[1] and boards[0] and timings[0] == timings[1] and timings[0]


def test_rows_without_tokens_count_for_the_order_alone(spark):
    rows = frame(spark, {"s": [("A", "ab", "00"), ("B", "an", "10"), ("B", "ab", "—"), ("C", "an", "20")], "none": [("A", "ab", "–")]})
    got = {r["segment"]: (r["n"], r["alternates"], r["ends"], r["shapes"] is None) for r in T.structure(rows).collect()}
    assert got["s"][1:] == (True, True, False) and got["none"] == (0, True, False, True)
    assert T.trips(rows.where(F.col("segment") == "none")).count() == 0


def test_headed_rows_are_numbered_over_blocks_and_parts(spark, tmp_path):
    from pulsegrid.sources import readers

    lines = [f"S{i},an" + ("\r" if i % 3 else "") if i % 7 else "" for i in range(500)]
    (tmp_path / "part-0.csv").write_bytes("\n".join(["﻿head,ab", *lines[:300], ""]).encode())
    (tmp_path / "part-1.csv").write_bytes("\n".join(lines[300:]).encode())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = readers.headed_rows(spark, str(tmp_path), 2)
        got = sorted(tuple(r) for r in rows.collect())
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [(1, "head", "ab"), *((i + 2, f"S{i}", "an") for i in range(500) if i % 7)]
