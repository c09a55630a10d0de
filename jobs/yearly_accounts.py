"""Yearly accounts of a network: passenger-weighted minutes by component for pairs, origins, regions and the whole.

Reads the tables that ``inputs.paths`` joins and writes ``<output>/accounts``,
partitioned by year and level: weight, weighted means of rolling, dwell and
transfer, their shares, the change of the total on the year before, the rank by
weight within year and level, the running share of the weight, and whether a
row is among the heaviest that make up ``coverage`` of it.

``years`` of the configuration, if any, are the years to refresh: only those
and the ones after them, whose changes depend on them, are read from the tables
and written over; the other years stay as they are.  A run with the same tables
leaves the same rows.

    python -m jobs.yearly_accounts TABLES OUTPUT --config jobs/yearly_accounts.json
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.operators import aggregates
from pulsegrid.plans import inputs

from .common import command, log, replace_partitions

DEFAULTS = {"years": [], "coverage": 0.5, "digits": 6}
PARTS = ["rolling", "dwell", "transfer"]
LEVELS = ["network", "region", "origin", "pair"]
NAMES = ["region", "origin", "destination"]


def levels(pairs: DataFrame) -> DataFrame:
    """The pairs and their sums up to the whole network, all from the pairs' own rows."""
    rolled = aggregates.component_rollup(pairs, [["year"], ["year", "region"], ["year", "region", "origin"]], PARTS, "weight")
    name = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("level") + 1)
    upper = rolled.withColumn("level", name).withColumn("destination", F.lit(None).cast("string"))
    return upper.unionByName(pairs.withColumn("level", F.lit("pair")))


def accounts(paths: DataFrame, coverage: float, digits: int) -> DataFrame:
    """One row for each year, level and name; ``paths`` needs origin, destination, region, year, the parts and weight."""
    between = paths.where("origin <> destination")
    pairs = aggregates.component_means(between, ["year", "region", "origin", "destination"], PARTS, "weight")
    out = levels(pairs)
    before = out.select((F.col("year") + 1).alias("year"), "level", *NAMES, F.col("total").alias("total_before"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("year", "level", *NAMES)]
    out = out.alias("a").join(before.alias("b"), reduce(Column.__and__, same), "left").select("a.*", "b.total_before")
    # A year's and a level's rows: at most the pairs of stations.
    within = Window.partitionBy("year", "level")
    heaviest = within.orderBy(F.col("weight").desc(), *[F.col(c).asc_nulls_first() for c in NAMES])
    run = F.sum("weight").over(heaviest.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(within)
    out = out.withColumns({"rank": F.row_number().over(heaviest), "cum_share": run, "total_change": F.col("total") - F.col("total_before")})
    out = out.withColumn("heavy", F.col("cum_share") - F.col("weight") / F.sum("weight").over(within) < coverage)
    measures = ["weight", *PARTS, "total", *[f"{p}_share" for p in PARTS], "total_change", "cum_share"]
    return out.select("year", "level", *NAMES, F.col("n").alias("members"), *[F.round(F.col(m).cast("double"), digits).alias(m) for m in measures], F.col("rank").cast("long").alias("rank"), "heavy")


def run(spark: SparkSession, tables: str, output: str, config: dict) -> str:
    """Writes the accounts and returns their folder."""
    target = f"{output.rstrip('/')}/accounts"
    paths = inputs.paths(spark, tables)
    chosen = sorted({int(y) for y in config["years"]})
    if chosen:
        written = sorted({*chosen, *[y + 1 for y in chosen]})
        # The year before a written one is read too, for its change.
        paths = paths.where(F.col("year").isin(sorted({*written, *[y - 1 for y in written]})))
    seen, left = Observation("paths read"), Observation("rows written")
    out = accounts(paths.observe(seen, F.count(F.lit(1)).alias("rows"), F.min("year").alias("first"), F.max("year").alias("last")), config["coverage"], config["digits"])
    if chosen:
        out = out.where(F.col("year").isin(written))
    replace_partitions(out.repartition("year", "level").observe(left, F.count(F.lit(1)).alias("rows")), target, ["year", "level"])
    log.info("read from %s: %s", tables, seen.get)
    log.info("wrote to %s, years %s: %s", target, chosen and written or "all", left.get)
    return target


if __name__ == "__main__":
    command("yearly_accounts", __doc__, {"tables": "folder of the tables", "output": "folder of the accounts"}, DEFAULTS, run)
