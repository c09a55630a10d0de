"""Areas of several polygons with holes: their points, size and centre, and a join of points by a cover of cells.

An area is ``rings``, an array of structs ``part`` (the polygon), ``hole`` and
the points ``xs`` and ``ys``.  A point is within by the even-odd rule over all
rings, and on any of their borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

RINGS = "array<struct<part:int,hole:boolean,xs:array<double>,ys:array<double>>>"


def rings(parts: Column) -> Column:
    """The rings of an array of polygons, each an array of rings of points ``[x, y]``; the first of a polygon is its border, the others are holes."""
    axis = lambda ring, i: F.transform(ring, lambda p: F.get(p, F.lit(i)))
    ring = lambda k: lambda r, i: F.struct(k.cast("int").alias("part"), (i > 0).alias("hole"), axis(r, 0).alias("xs"), axis(r, 1).alias("ys"))
    return F.flatten(F.transform(parts, lambda polygon, k: F.transform(polygon, ring(k))))


def within(x: Column | str, y: Column | str, area: Column | str) -> Column:
    """Whether a point is in the area or on a border of it."""
    x, y, area = map(S.col, (x, y, area))
    odd = F.aggregate(area, F.lit(False), lambda o, r: o != S.crossed(x, y, r["xs"], r["ys"]))
    return F.exists(area, lambda r: S.on_border(x, y, r["xs"], r["ys"])) | odd


def _signed(area: Column, value) -> Column:
    """The sum over all rings of their size times ``value``, holes taken off."""
    term = lambda r: F.when(r["hole"], -1.0).otherwise(1.0) * F.abs(S.ring_area(r["xs"], r["ys"])) * value(r)
    return F.aggregate(area, F.lit(0.0), lambda t, r: t + term(r))


def size(area: Column | str) -> Column:
    return _signed(S.col(area), lambda r: F.lit(1.0))


def centroid(area: Column | str) -> tuple[Column, Column]:
    """The centre of an area, its polygons weighed by their size; null for one without size."""
    area = S.col(area)
    total = F.nullif(size(area), F.lit(0.0))
    return tuple(_signed(area, lambda r, i=i: S.ring_centroid(r["xs"], r["ys"])[i]) / total for i in (0, 1))


def cover(zones: DataFrame, side: float) -> DataFrame:
    """The cells (``cx``, ``cy``, of ``side``) that each zone meets; ``whole`` where no border passes, so that all points in it are within."""
    low = lambda c: F.floor(F.array_min(F.transform("rings", lambda r: F.array_min(r[c]))) / side)
    high = lambda c: F.floor(F.array_max(F.transform("rings", lambda r: F.array_max(r[c]))) / side)
    cells = zones.withColumn("cx", F.explode(F.sequence(low("xs"), high("xs")))).withColumn("cy", F.explode(F.sequence(low("ys"), high("ys"))))
    x, y = F.col("cx") * side, F.col("cy") * side

    def meets(r: Column) -> Column:
        """An edge whose box meets the cell: more cells than need be are looked at, none too few."""
        n = F.size(r["xs"])
        ends = lambda c, i: (F.get(r[c], i), F.get(r[c], (i + 1) % n))
        near = lambda i: (F.least(*ends("xs", i)) <= x + side) & (F.greatest(*ends("xs", i)) >= x) & (F.least(*ends("ys", i)) <= y + side) & (F.greatest(*ends("ys", i)) >= y)
        return F.exists(F.sequence(F.lit(0), n - 1), near)

    judged = cells.withColumn("whole", ~F.exists("rings", meets))
    return judged.where(~F.col("whole") | within(x + side / 2, y + side / 2, "rings"))


def points_in(points: DataFrame, zones: DataFrame, x: str, y: str, side: float) -> DataFrame:
    """Each point with the zones that it is in (all columns of both but ``rings``): an equi-join on the cell; only cells with a border are tested point by point."""
    named = points.withColumns({"cx": F.floor(F.col(x) / side), "cy": F.floor(F.col(y) / side)})
    met = named.join(cover(zones, side), ["cx", "cy"])
    return met.where(F.col("whole") | within(x, y, "rings")).drop("cx", "cy", "whole", "rings")
