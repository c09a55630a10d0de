"""Operators on ordered rows: shares, gaps, dominance, waits, runs, trimming, turnbacks, non-dominated departures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = Sequence[str]


def coverage(df: DataFrame, keys: Keys, weight: str, ties: Keys, share: float) -> DataFrame:
    """The heaviest rows of each group up to the one that reaches ``share``, with running totals."""
    by = Window.partitionBy(*keys)
    order = by.orderBy(F.col(weight).desc(), *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"cum": F.sum(weight).over(order), "all": F.sum(weight).over(by)})
    return out.where(F.col("cum") - F.col(weight) < share * F.col("all")).withColumn("cum_share", F.col("cum") / F.col("all")).drop("all")


def leg_gaps(df: DataFrame, path: str, order: Keys, trip: str, arrive: str, depart: str) -> DataFrame:
    """For each leg the gap to the next of its path: dwell on the same trip, else transfer."""
    by = Window.partitionBy(path).orderBy(*order)
    out = df.withColumns({"next_trip": F.lead(trip).over(by), "gap": F.lead(depart).over(by) - F.col(arrive)})
    return out.withColumn("gap_kind", F.when(F.col("next_trip").isNull(), None).when(F.col("next_trip") == F.col(trip), "dwell").otherwise("transfer"))


def adjacent(df: DataFrame, keys: Keys, order: Keys, columns: Keys) -> DataFrame:
    """Each row with the next one's ``columns`` as ``next_*``; the last of each group is left out."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(by) for c in columns} | {"__last": F.lead(F.lit(1)).over(by)}).where("__last IS NOT NULL").drop("__last")


def neighbours(df: DataFrame, trip: str, order: Keys, station: str) -> DataFrame:
    """The nearest different station before and after each event of a trip."""
    by = Window.partitionBy(trip).orderBy(*order)
    changed = F.coalesce((F.col(station) != F.lag(station).over(by)).cast("int"), F.lit(0))
    run = df.withColumn("__run", F.sum(changed).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    stops = run.groupBy(trip, "__run").agg(F.first(station).alias("__s"))
    between = Window.partitionBy(trip).orderBy("__run")
    stops = stops.withColumns({"previous": F.lag("__s").over(between), "following": F.lead("__s").over(between)}).drop("__s")
    return run.join(stops, [trip, "__run"]).drop("__run")


def dominance(df: DataFrame, keys: Keys, path: str, departure: str, cost: str | None = None, start: int = 300, end: int = 1440) -> DataFrame:
    """Minutes of the day that each path owns: since the departure before its own; of one minute, the first path takes them.

    Only departures from ``start`` on count, and with ``cost`` (the path's
    minutes, positive) only those that arrive before ``end``.
    """
    by = Window.partitionBy(*keys).orderBy(departure, path)
    fine = (F.col(departure) >= start) & (F.col(departure) < end)
    if cost:
        fine = fine & (F.col(cost) > 0) & (F.col(departure) + F.col(cost) < end)
    own = df.where(fine).withColumn("__own", F.col(departure) - F.coalesce(F.lag(departure).over(by), F.lit(start)))
    return own.groupBy(*keys, path).agg(F.sum("__own").alias("dominance"), F.count("*").alias("instances"))


def demand_shares(df: DataFrame, keys: Keys, owned: str, demand: str) -> DataFrame:
    """Demand by owned minutes, equally where no path owns any."""
    by = Window.partitionBy(*keys)
    total = F.sum(owned).over(by)
    share = F.when(total > 0, F.col(owned) / total).otherwise(1.0 / F.count("*").over(by))
    return df.withColumn("share", share).withColumn("allocated", F.col("share") * F.col(demand))


def minute_best(df: DataFrame, keys: Keys, departure: str, arrival: str, index: str, start: int, end: int, cycle: int = 120) -> DataFrame:
    """For each minute the connection of least arrival, then departure, then index, that leaves at it or later (also a cycle later).

    The best of each departure minute is kept first; then the running least from
    the end of the cycle needs one row per group and minute, and no range join.
    """
    both = df.unionByName(df.withColumns({departure: F.col(departure) + cycle, arrival: F.col(arrival) + cycle}))
    best = both.where((F.col(departure) >= start) & (F.col(departure) < end + cycle)).groupBy(*keys, F.col(departure).alias("minute")).agg(
        F.min(F.struct(F.col(arrival).alias("arr"), F.col(departure).alias("dep"), F.col(index).alias("idx"))).alias("own")
    )
    minutes = df.select(*keys).distinct().withColumn("minute", F.explode(F.sequence(F.lit(start), F.lit(end + cycle - 1))))
    after = Window.partitionBy(*keys).orderBy(F.col("minute").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = minutes.join(best, [*keys, "minute"], "left").withColumn("best", F.min("own").over(after)).where(F.col("minute") < end)
    return out.where("best IS NOT NULL").select(*keys, "minute", "best.arr", "best.dep", "best.idx", (F.col("best.dep") - F.col("minute")).alias("wait"))


def headway_wait(dominance: Column, instances: Column) -> Column:
    return F.when(instances > 0, dominance / instances / 2)


def skyline(df: DataFrame, keys: Keys, departure: str, arrival: str) -> DataFrame:
    """Departures that no later one reaches as early: the Pareto set of (late departure, early arrival)."""
    per = df.groupBy(*keys, departure).agg(F.min(arrival).alias(arrival))
    later = Window.partitionBy(*keys).orderBy(F.col(departure).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("__later", F.min(arrival).over(later)).where(F.col("__later").isNull() | (F.col(arrival) < F.col("__later"))).drop("__later")


def without_false_ends(df: DataFrame, keys: Keys, previous: str, following: str) -> DataFrame:
    """Rows without a previous (next) station go where any row of the group has one."""
    by = Window.partitionBy(*keys)
    some = lambda c: F.bool_or(F.col(c).isNotNull() & (F.col(c) != "")).over(by)
    none = lambda c: F.col(c).isNull() | (F.col(c) == "")
    out = df.withColumns({"__p": some(previous), "__f": some(following)})
    return out.where(~((none(previous) & F.col("__p")) | (none(following) & F.col("__f")))).drop("__p", "__f")


def runs(df: DataFrame, keys: Keys, order: Keys, starts: Column, name: str) -> DataFrame:
    """Numbers the runs of rows that begin where ``starts`` holds."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(by))


def trimmed(df: DataFrame, keys: Keys, order: str, kind: str, first: str = "ab", last: str = "an") -> DataFrame:
    """Rows from the group's first departure to its last arrival."""
    by = Window.partitionBy(*keys)
    out = df.withColumns({"__a": F.min(F.when(F.col(kind) == first, F.col(order))).over(by), "__b": F.max(F.when(F.col(kind) == last, F.col(order))).over(by)})
    return out.where((F.col(order) >= F.col("__a")) & (F.col(order) <= F.col("__b"))).drop("__a", "__b")


def period_change(df: DataFrame, keys: Keys, period: str, values: Keys) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(period)
    return df.withColumns({f"{v}_change": F.col(v) - F.lag(v).over(by) for v in values} | {"since": F.lag(period).over(by)}).where("since IS NOT NULL")


def turnbacks(df: DataFrame, trip: str, order: Keys, station: str, kind: str, arrive: str = "an", depart: str = "ab") -> DataFrame:
    """Arrivals where a trip stands at one station and leaves to where it came from: ``before`` is that place."""
    by = Window.partitionBy(trip).orderBy(*order)
    named = df.withColumns({"before": F.lag(station).over(by), "__same": F.lead(station).over(by), "__after": F.lead(station, 2).over(by), "__kinds": F.concat_ws(" ", F.lag(kind).over(by), kind, F.lead(kind).over(by), F.lead(kind, 2).over(by))})
    out = named.where((F.col("__same") == F.col(station)) & (F.col("before") == F.col("__after")) & (F.col("__kinds") == f"{depart} {arrive} {depart} {arrive}"))
    return out.drop("__same", "__after", "__kinds")


def periodic(df: DataFrame, minute: str, start: int, end: int, cycle: int = 120) -> DataFrame:
    """Each clockface minute at all its times from ``start`` to before ``end``."""
    first = F.lit(start) + F.pmod(F.col(minute) - start, F.lit(cycle))
    return df.withColumn("at", F.explode(F.when(first < end, F.sequence(first, F.lit(end - 1), F.lit(cycle)))))


def label_order(label: str | Column) -> Column:
    """Years and half years as numbers: ``2014 Q3/4`` is 2014.5."""
    c = F.col(label) if isinstance(label, str) else label
    year = F.regexp_extract(c, r"(\d{4})", 1).try_cast("double")
    return year + F.when(c.contains("Q3/4"), 0.5).otherwise(0.0)
