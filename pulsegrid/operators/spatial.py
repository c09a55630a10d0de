"""Spatial operators: kernel surfaces, coverage, contours, rasters' change, boxes, screenlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def raster(spark: SparkSession, low_x: float, low_y: float, step: float, columns: int, rows: int) -> DataFrame:
    return spark.range(columns * rows).select((F.col("id") % columns).cast("int").alias("i"), F.floor(F.col("id") / columns).cast("int").alias("j")).select(
        "i", "j", (F.lit(low_x) + F.col("i") * step).alias("x"), (F.lit(low_y) + F.col("j") * step).alias("y")
    )


def near(grid: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """Grid points with the places within ``radius`` (planar): an equi-join on cells as wide as the radius."""
    cell = lambda c: F.floor(F.col(c) / radius)
    spread = places.withColumns({"cx": F.explode(F.sequence(cell("px") - 1, cell("px") + 1))}).withColumn("cy", F.explode(F.sequence(cell("py") - 1, cell("py") + 1)))
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))
    return grid.withColumns({"cx": cell("x"), "cy": cell("y")}).join(spread, ["cx", "cy"]).drop("cx", "cy").withColumn("d", d).where(F.col("d") <= radius)


def kernel_surface(grid: DataFrame, places: DataFrame, value: str, weight: str, sigma: float, radius: float) -> DataFrame:
    """Gaussian-weighted mean of the values around each grid point; null where no place is near."""
    w = F.col(weight) * F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma))
    v = near(grid, places, radius).groupBy("i", "j").agg((F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0))).alias("value"), F.min("d").alias("nearest"))
    return grid.join(v, ["i", "j"], "left").withColumn("covered", F.col("nearest").isNotNull())


def raster_change(a: DataFrame, b: DataFrame, most: float) -> DataFrame:
    both = a.select("i", "j", F.col("value").alias("a")).join(b.select("i", "j", F.col("value").alias("b")), ["i", "j"])
    return both.withColumn("change", F.greatest(F.lit(-most), F.least(F.lit(most), F.col("b") - F.col("a"))))


def contour_segments(surface: DataFrame, level: float) -> DataFrame:
    """Marching squares: the line segments where the surface crosses ``level``, by linear interpolation.

    A cell is its lower left point joined with its right, upper and upper right
    neighbours; ambiguous saddles are cut by the mean of the four.
    """
    at = lambda di, dj, name: surface.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("value").alias(name))
    c = surface.select("i", "j", F.col("value").alias("v00")).join(at(1, 0, "v10"), ["i", "j"]).join(at(0, 1, "v01"), ["i", "j"]).join(at(1, 1, "v11"), ["i", "j"]).na.drop()
    over = lambda n: F.when(F.col(n) >= level, 1).otherwise(0)
    case = over("v00") + 2 * over("v10") + 4 * over("v11") + 8 * over("v01")
    cut = lambda a, b: (F.lit(level) - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    south, north = point(F.col("i") + cut("v00", "v10"), F.col("j")), point(F.col("i") + cut("v01", "v11"), F.col("j") + 1)
    west, east = point(F.col("i"), F.col("j") + cut("v00", "v01")), point(F.col("i") + 1, F.col("j") + cut("v10", "v11"))
    line = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    high = (F.col("v00") + F.col("v10") + F.col("v01") + F.col("v11")) / 4 >= level
    #: Fixed: which sides a contour joins, by the corners at or above the level.
    sides = {1: [(south, west)], 2: [(south, east)], 3: [(west, east)], 4: [(east, north)], 6: [(south, north)], 7: [(west, north)], 8: [(west, north)], 9: [(south, north)], 11: [(east, north)], 12: [(west, east)], 13: [(south, east)], 14: [(south, west)]}
    found = F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")
    for k, lines in sides.items():
        found = F.when(F.col("case") == k, F.array(*[line(a, b) for a, b in lines])).otherwise(found)
    one, two = F.array(line(south, west), line(east, north)), F.array(line(south, east), line(west, north))
    found = F.when(F.col("case") == 5, F.when(high, two).otherwise(one)).when(F.col("case") == 10, F.when(high, one).otherwise(two)).otherwise(found)
    return c.withColumn("case", case).select("i", "j", F.explode(found).alias("s")).select("i", "j", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def boxes(df: DataFrame, keys: list[str], pad: float) -> DataFrame:
    return df.groupBy(*keys).agg((F.min("lon") - pad).alias("low_x"), (F.max("lon") + pad).alias("high_x"), (F.min("lat") - pad).alias("low_y"), (F.max("lat") + pad).alias("high_y"), F.count("*").alias("n"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))))
    t = F.coalesce(t, F.lit(0.0))
    return F.sqrt(F.pow(px - x1 - t * dx, 2) + F.pow(py - y1 - t * dy, 2))


def screenline(x1: Column, y1: Column, x2: Column, y2: Column, share: float = 0.35, low: float = 2.5, high: float = 12.0) -> tuple[Column, Column, Column, Column]:
    """The line across the middle of a corridor, half as long as a bounded share of it."""
    dx, dy = x2 - x1, y2 - y1
    d = F.sqrt(dx * dx + dy * dy)
    half = F.greatest(F.lit(low), F.least(F.lit(high), share * d)) / F.nullif(d, F.lit(0.0))
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    return mx - dy * half, my + dx * half, mx + dy * half, my - dx * half


def crosses(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross or touch."""
    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    return (side(a, b[0], b[1]) * side(a, b[2], b[3]) <= 0) & (side(b, a[0], a[1]) * side(b, a[2], a[3]) <= 0)


def segment_cells(df: DataFrame, ends: tuple[str, str, str, str], width: float, pad: int = 0) -> DataFrame:
    """``df`` once for each square cell (``cx``, ``cy``) that its segment runs through, and for those ``pad`` cells around.

    A segment is cut by columns of cells, so the rows follow its length, not the area of its box.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ends)
    low, high = F.least(x1, x2), F.greatest(x1, x2)
    at = lambda x: F.when(x1 == x2, F.lit(None)).otherwise(y1 + (x - x1) * (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0)))
    column = df.withColumn("cx", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    left, right = at(F.greatest(low, F.col("cx") * width)), at(F.least(high, (F.col("cx") + 1) * width))
    bottom, top = F.coalesce(F.least(left, right), F.least(y1, y2)), F.coalesce(F.greatest(left, right), F.greatest(y1, y2))
    out = column.withColumn("cy", F.explode(F.sequence(F.floor(bottom / width), F.floor(top / width))))
    if pad:
        out = out.withColumn("cx", F.explode(F.sequence(F.col("cx") - pad, F.col("cx") + pad))).withColumn("cy", F.explode(F.sequence(F.col("cy") - pad, F.col("cy") + pad)))
        out = out.dropDuplicates([*df.columns, "cx", "cy"])
    return out


def screenline_links(corridors: DataFrame, links: DataFrame, buffer: float, width: float | None = None, few: bool = False) -> DataFrame:
    """Links that cross a corridor's screenline or come within ``buffer`` of it, each pair once.

    ``corridors``: ``corridor``, ``x1``…``y2``; ``links``: ``link``, ``a_x``, ``a_y``, ``b_x``, ``b_y``.
    Both are cut to cells wider than the buffer and meet by an equi-join; a pair
    that shares several is tested in each and counts once.  Where corridors are
    ``few`` their cells go to all tasks, and only the pairs found are shuffled.
    """
    width = width or max(1.0, 8 * buffer)
    if width <= buffer:
        raise ValueError("cells must be wider than the buffer")
    line = screenline(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    named = corridors.select("corridor", *[c.alias(n) for c, n in zip(line, ("s_x1", "s_y1", "s_x2", "s_y2"), strict=True)]).na.drop()
    s = tuple(F.col(c) for c in ("s_x1", "s_y1", "s_x2", "s_y2"))
    ends = ("a_x", "a_y", "b_x", "b_y")
    link = tuple(F.col(c) for c in ends)
    close = F.least(segment_distance(link[0], link[1], *s), segment_distance(link[2], link[3], *s), segment_distance(s[0], s[1], *link), segment_distance(s[2], s[3], *link)) <= buffer
    lines = segment_cells(named, ("s_x1", "s_y1", "s_x2", "s_y2"), width, 1)
    met = segment_cells(links.na.drop(subset=list(ends)), ends, width).join(F.broadcast(lines) if few else lines, ["cx", "cy"])
    return met.where(crosses(s, link) | close).dropDuplicates(["corridor", "link"]).drop("cx", "cy")
