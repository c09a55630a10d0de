"""Areas with holes and several parts, joins that check their keys, fingerprints and reports."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import joins as J
from pulsegrid.operators import polygons as G
from pulsegrid.operators import selection as Z
from pulsegrid.sources import readers, writers

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]
FAR = [[20, 0], [24, 0], [24, 4], [20, 4], [20, 0]]


def layer(spark, tmp_path, *shapes):
    """A file of features: name, type, coordinates."""
    path = tmp_path / f"layer-{random.random()}.json"
    path.write_text(json.dumps({"features": [{"properties": {"zone": n}, "geometry": {"type": t, "coordinates": c} if t else None} for n, t, c in shapes]}))
    return readers.vector_layer(spark, str(path), "zone: STRING")


def test_holes_and_parts(spark, tmp_path):
    zones = layer(spark, tmp_path, ("one", "Polygon", [SQUARE, HOLE]), ("two", "MultiPolygon", [[SQUARE, HOLE], [FAR]]), ("none", None, None))
    points = [(5, 5), (4, 5), (1, 1), (0, 3), (10, 10), (11, 1), (22, 2), (24, 4), (25, 2)]
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    want = {("one", i) for i in (1, 2, 3, 4)} | {("two", i) for i in (1, 2, 3, 4, 6, 7)}
    for side in (0.7, 3.0, 100.0):
        assert {(r["zone"], r["i"]) for r in G.points_in(p, zones.where("rings IS NOT NULL").select("zone", "rings"), "x", "y", side).collect()} == want
    cx, cy = G.centroid("rings")
    got = {r["zone"]: (r["size"], r["cx"], r["cy"]) for r in zones.where("rings IS NOT NULL").select("zone", G.size("rings").alias("size"), cx.alias("cx"), cy.alias("cy")).collect()}
    assert got["one"] == pytest.approx((96, 5, 5)) and got["two"] == pytest.approx((112, (96 * 5 + 16 * 22) / 112, (96 * 5 + 16 * 2) / 112))
    assert zones.count() == 3 and zones.where("zone = 'two'").first()["xs"][:3] == [0, 10, 10]
    with pytest.raises(Exception, match="no polygon: Point"):
        layer(spark, tmp_path, ("p", "Point", [1, 2])).collect()


def test_cover_equals_the_plain_test(spark, tmp_path):
    """Random stars with holes: the join by cells finds what testing every point against every area finds."""
    rnd = random.Random(4)

    def star(x, y, r):
        import math

        angles = sorted(rnd.uniform(0, 6.28) for _ in range(9))
        pts = [[x + r * rnd.uniform(0.5, 1) * math.cos(a), y + r * rnd.uniform(0.5, 1) * math.sin(a)] for a in angles]
        return [*pts, pts[0]]

    shapes = [(f"z{i}", "Polygon", [star(*c, 5), star(*c, 1.5)]) for i in range(5) for c in [(rnd.uniform(0, 20), rnd.uniform(0, 20))]]
    zones = layer(spark, tmp_path, *shapes).select("zone", "rings")
    points = spark.createDataFrame([(i, rnd.uniform(-6, 26), rnd.uniform(-6, 26)) for i in range(600)], "i int, x double, y double")
    plain = points.crossJoin(zones).where(G.within("x", "y", "rings")).select("i", "zone")
    got = G.points_in(points, zones, "x", "y", 1.1).select("i", "zone")
    assert plain.count() > 60 and sorted(got.collect()) == sorted(plain.collect())
    assert G.cover(zones, 1.1).where("whole").count() > 0


def test_join_that_checks_its_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, a string")
    b = spark.createDataFrame([(1, None), (3, "q")], "k int, b string")
    assert sorted(map(tuple, J.one_to_one(a, b, ["k"]).collect()), key=str) == sorted([(1, "x", None), (2, "y", None), (None, "z", None)], key=str)
    with pytest.raises(Exception, match="more than once: 1"):
        J.one_to_one(a, b.unionByName(b.where("k = 1")), ["k"]).collect()
    with pytest.raises(Exception, match="missing: 2"):
        J.one_to_one(a.where("k = 2"), b, ["k"], complete=True).collect()
    assert J.one_to_one(a.where("k = 1"), b, ["k"], complete=True).count() == 1


def test_grid_of_shifts(spark):
    s = spark.createDataFrame([(1, 2, 1), (2, None, 0), (3, -4, -1)], "i int, earlier int, later int")
    got = sorted((r["i"], r["delta"]) for r in Z.shift_grid(s, 3).collect())
    assert got == [(1, -2), (1, -1), (1, 1), (2, -3), (2, -2), (2, -1)]


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = readers.fingerprint(spark, [path])
    assert readers.fingerprint(spark, [path]) == first
    spark.range(3).write.mode("append").parquet(path)
    second = readers.fingerprint(spark, [path])
    spark.range(3).write.mode("overwrite").parquet(path)
    assert len({first, second, readers.fingerprint(spark, [path])}) == 3


def test_a_report_is_whole_or_fails(spark, monkeypatch):
    assert writers.markdown(spark.range(5), "r").count() == 9
    monkeypatch.setattr(writers, "MOST_LINES", 4)
    with pytest.raises(ValueError, match="more than 4 lines"):
        writers.markdown(spark.range(5), "r")
