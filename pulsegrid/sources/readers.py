"""Sources: text tables, matrices, nested rows, statistics cubes, caches; everything lands as text and is cast by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import polygons as polygons_of
from ..operators.ordering import kept


def csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """All columns as text, nulls as empty, a byte-order mark stripped from names; ``where`` is pushed into the plan."""
    if columns:
        out = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path, header=True, enforceSchema=True)
    else:
        out = spark.read.csv(path, header=True, inferSchema=False)
    out = out.toDF(*[c.lstrip("﻿") for c in out.columns]).na.fill("")
    return out.where(where) if where else out


def headed_rows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A table whose first line is data: ``rownum`` from 1 and ``c0`` to ``c<width-1>``; short rows are filled, wider ones fail.

    ``path`` is one file, or a folder of parts in the order of their names.  Its
    order has a meaning: lines are in order within a block of a file, and only
    the blocks' numbers of lines are summed in one task.
    """
    block = ["__file", "__from"]
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    read = kept(read)  # a block's lines keep their numbers
    blocks = read.groupBy(*block).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*block, (before - F.col("__first")).alias("__add"))
    lines = read.join(F.broadcast(blocks), block).select((F.col("__id") + F.col("__add")).cast("long").alias("n"), "line")
    lines = lines.withColumn("line", F.when(F.col("n") == 0, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))).where("trim(line) <> ''")
    kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width + 1)])
    out = lines.select((F.col("n") + 1).alias("rownum"), F.from_csv("line", ", ".join(f"{f.name} STRING" for f in kind)).alias("r")).select("rownum", "r.*")
    wide = F.col(f"c{width}").isNotNull()
    first = F.when(wide, F.raise_error(F.concat(F.lit("too many cells in row "), F.col("rownum")))).otherwise(F.coalesce("c0", F.lit("")))
    return out.select("rownum", first.alias("c0"), *[F.coalesce(f"c{i}", F.lit("")).alias(f"c{i}") for i in range(1, width)])


def matrix(spark: SparkSession, path: str, fault: float | None = 0.0) -> DataFrame:
    """A labelled square table as long rows; what is no number becomes ``fault``."""
    wide = csv(spark, path)
    row = wide.columns[0]
    long = wide.unpivot([row], wide.columns[1:], "destination", "raw").withColumnRenamed(row, "origin")
    return long.select("origin", "destination", F.coalesce(F.expr("try_cast(raw AS DOUBLE)"), F.lit(fault).cast("double")).alias("value"))


def whitespace_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Rows of origin, destination, trips; comments (``*``, ``-``, ``$``), short and non-numeric rows are skipped."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").rlike(r"^[*$-]") & (F.trim("value") != "")).select(part.alias("p")).where("size(p) >= 3")
    cast = lambda i, kind: F.get("p", F.lit(i)).try_cast(kind)
    out = rows.select(cast(0, "int").alias("origin_zone"), cast(1, "int").alias("destination_zone"), cast(2, "double").alias("trips"))
    return out.na.drop()


#: Fixed layout of a stored path.
PATH = "struct<dep_min:int,arr_min:int,num_transfers:int,line_names:array<string>,daily_demand_allocated:double,daily_demand_share:double>"
CELL = f"struct<same_station:boolean,path_count:int,daily_demand_total:double,paths:array<{PATH}>>"


def row_states(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stored rows (JSON whose cells are JSON texts, plain or gzip) as one row per path.

    One row a file, or one a line; the codec follows the name; a cell without
    paths is left out.
    """
    rows = spark.read.schema("row_idx INT, origin STRING, year STRING, cells ARRAY<STRING>").json(path, multiLine=not lines)
    cells = rows.select("row_idx", "origin", "year", F.posexplode("cells").alias("col_idx", "cell")).withColumn("c", F.from_json("cell", CELL))
    return cells.select("row_idx", "origin", "year", "col_idx", "c.daily_demand_total", F.posexplode("c.paths").alias("path_idx", "p")).select("row_idx", "origin", "year", "col_idx", "path_idx", "daily_demand_total", "p.*")


def statistics_cube(df: DataFrame, value: str, sizes: Sequence[int], names: Sequence[str], labels: Sequence[Sequence[str]]) -> DataFrame:
    """A flat array of values to rows, its position read as digits of mixed radix."""
    out, stride = df.select(F.posexplode(value).alias("pos", "value")), 1
    for size, name, label in reversed(list(zip(sizes, names, labels, strict=True))):
        digit = F.pmod(F.floor(F.col("pos") / stride), F.lit(size)).cast("int")
        out = out.withColumn(name, F.element_at(F.array(*[F.lit(x) for x in label]), digit + 1))
        stride *= size
    return out.select(*names, "value")


def last_records(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """A log of JSON lines: the last record of each key."""
    best = Window.partitionBy(key).orderBy(F.col(order).desc())
    return spark.read.schema(schema).json(path).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def assigned_json(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The object of ``var name = {...};`` in a script."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?s)\b{name}\s*=\s*(\{{.*\}})\s*;", 1)
    return text.select(F.from_json(body, schema).alias("o")).select("o.*")


def latex_rows(spark: SparkSession, path: str, label: str, columns: int) -> DataFrame:
    """Cells of the rows of a labelled table."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", rf"(?s)\\label\{{{label}\}}(.*?)\\end\{{table", 1).alias("t"))
    rows = text.select(F.posexplode(F.split("t", r"\\\\")).alias("n", "row")).where(F.contains("row", F.lit("&")))
    clean = F.transform(F.split(F.regexp_replace("row", r"\\(hline|toprule|midrule|bottomrule)", ""), "&"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return rows.select("n", *[F.get(clean, F.lit(i)).alias(f"c{i}") for i in range(columns)])


def polygons(df: DataFrame, wkt: str) -> DataFrame:
    """The outer ring of WKT polygons as arrays ``xs`` and ``ys``."""
    pairs = F.split(F.regexp_extract(wkt, r"\(\(([^()]*)\)", 1), ",")
    part = lambda i: F.transform(pairs, lambda p: F.get(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double"))
    return df.withColumns({"xs": part(0), "ys": part(1)})


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A hash of the path, length and time of change of every file below ``paths``; no content is read."""
    import hashlib

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "modificationTime")
    one = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "path", "length", "modificationTime"))), ";"), 256).alias("h")).first()["h"]
    return hashlib.sha256((one or "").encode()).hexdigest()


def fingerprinted(spark: SparkSession, folder: str, build, content: str) -> DataFrame:
    """A table kept below ``folder`` by the hash of what it was made from (``fingerprint`` of its files, say); built where it is missing."""
    import hashlib

    path = f"{folder}/{hashlib.sha256(content.encode()).hexdigest()[:16]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``writers.replaced`` wrote last at ``path``."""
    from .writers import pointer

    version = pointer(spark, path)
    return spark.read.parquet(f"{path}/{version}") if version else None


def vector_layer(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A layer of polygons from GeoJSON (one collection, or many files of them): the named properties and all ``rings`` (``operators.polygons``).

    ``xs`` and ``ys`` are the first ring.  Polygons and multipolygons are read
    whole, with their holes; a geometry of another kind fails.
    """
    shape = f"features ARRAY<STRUCT<properties: STRUCT<{properties}>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    f = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind, text, polygon = F.col("f.geometry.type"), F.col("f.geometry.coordinates"), "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, polygon))).when(kind == "MultiPolygon", F.from_json(text, f"ARRAY<{polygon}>"))
    parts = F.when(kind.isNull() | kind.isin("Polygon", "MultiPolygon"), parts).otherwise(F.raise_error(F.concat(F.lit("a geometry that is no polygon: "), kind)))
    out = f.select("f.properties.*", polygons_of.rings(parts).alias("rings"))
    return out.withColumns({c: F.get("rings", F.lit(0))[c] for c in ("xs", "ys")})
