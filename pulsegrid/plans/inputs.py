"""The driver's tables seen as a transport network, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; without that, only a local session has a place that all tasks see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        n.cast("long").alias("id"), F.col("n_name").alias("station"), F.col("r_name").alias("region"),
        (45.8 + (n * 7 % 25) * 0.08).alias("lat"), (6.0 + (n * 11 % 25) * 0.17).alias("lon"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: a path between the supplier's and the customer's nation with its components and weight."""
    t = {n: read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier")}
    s = stations(spark, sf_dir)
    o = s.select(F.col("id").alias("s_nationkey"), F.col("station").alias("origin"), F.col("region"))
    d = s.select(F.col("id").alias("c_nationkey"), F.col("station").alias("destination"))
    return (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(o, "s_nationkey").join(d, "c_nationkey")
        .select("origin", "destination", "region", F.year("o_orderdate").alias("year"), F.col("l_extendedprice").alias("rolling"), F.col("l_discount").alias("dwell"), F.col("l_tax").alias("transfer"), F.col("l_quantity").alias("weight"))
    )


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).where("origin <> destination").groupBy("origin", "destination", "region", "year").agg(F.sum("weight").alias("weight"), F.sum("rolling").alias("rolling"))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stops of trips: a trip per user, a station per value, views arrive and purchases depart."""
    kind = F.when(F.col("event_type") == "view", "an").when(F.col("event_type") == "purchase", "ab").otherwise("pass")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("trip"), (F.col("event_id") % 11).alias("station"), (F.col("user_id") % 7).alias("line"), kind.alias("kind"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), F.col("ts"), F.col("event_type").alias("service"), F.col("value").alias("pax"),
    )


#: What the stand-in timetable writes behind its minutes.
SUFFIXES = ["", "i", "n", "P", "q", "I", "PQ", " n "]


def timetable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a wide timetable: four events of a user in a row are a segment; each arrives at a station and departs from it, with a token for each of two years."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.minute("ts").alias("m"), (F.row_number().over(by) - 1).alias("k"))
    stop = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.lit(kind).alias("kind")) for i, kind in enumerate(("an", "ab"))]))
    r = e.withColumn("s", stop).select("*", "s.*")
    number = (F.col("id") + F.col("side") * F.floor(F.col("id") / 8)) % 8
    mark = F.coalesce(*[F.when(number == i, F.lit(x)) for i, x in enumerate(SUFFIXES)])
    cell = lambda shift: F.concat(((F.col("m") + F.col("side") * (F.col("id") % 19) + shift) % 60).cast("string"), mark)
    return r.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.floor(F.col("k") / 4).cast("string")).alias("segment"), (F.col("k") % 4 * 2 + F.col("side")).cast("int").alias("seq"), F.concat(F.lit("S"), (F.col("id") % 11).cast("string")).alias("station"),
        "kind", F.when(F.col("id") % 29 == 0, "–").otherwise(cell(F.lit(0))).alias("2026"), F.when(F.col("id") % 31 == 0, "").otherwise(cell(F.col("id") % 3)).alias("2035"),
    )


STATIONS = """stations AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS station, r_name AS region, 45.8 + (n_nationkey * 7 % 25) * 0.08::DOUBLE AS lat, 6.0 + (n_nationkey * 11 % 25) * 0.17::DOUBLE AS lon
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
PATHS = """paths AS (
  SELECT o.n_name AS origin, d.n_name AS destination, r_name AS region, year(o_orderdate) AS year, l_extendedprice AS rolling, l_discount AS dwell, l_tax AS transfer, l_quantity AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation o ON s_nationkey = o.n_nationkey JOIN nation d ON c_nationkey = d.n_nationkey JOIN region ON o.n_regionkey = r_regionkey)"""
DEMAND = PATHS + """, demand AS (
  SELECT origin, destination, region, year, sum(weight) AS weight, sum(rolling) AS rolling FROM paths WHERE origin <> destination GROUP BY ALL)"""
BOARD = """board AS (
  SELECT event_id AS id, user_id AS trip, event_id % 11 AS station, user_id % 7 AS line, CASE event_type WHEN 'view' THEN 'an' WHEN 'purchase' THEN 'ab' ELSE 'pass' END AS kind,
    hour(ts) * 60 + minute(ts) AS minute, ts, event_type AS service, value AS pax FROM events)"""
CELL = "CAST((m + side * (id % 19) + {0}) % 60 AS VARCHAR) || (['', 'i', 'n', 'P', 'q', 'I', 'PQ', ' n '])[(id + side * (id // 8)) % 8 + 1]"
TIMETABLE = f"""timetable AS (
  SELECT user_id || '/' || (k // 4) AS segment, CAST(k % 4 * 2 + side AS INT) AS seq, 'S' || (id % 11) AS station, CASE side WHEN 0 THEN 'an' ELSE 'ab' END AS kind,
    CASE WHEN id % 29 = 0 THEN '–' ELSE {CELL.format(0)} END AS y2026, CASE WHEN id % 31 = 0 THEN '' ELSE {CELL.format('id % 3')} END AS y2035
  FROM (SELECT user_id, event_id AS id, minute(ts) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) CROSS JOIN (VALUES (0), (1)) AS s(side))"""
