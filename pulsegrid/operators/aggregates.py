"""Weighted aggregates, shares, quantiles, histograms, apportionment, loads and reachability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import running

Keys = Sequence[str]


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Σ(w·x)/Σw; a null or NaN value adds nothing above, while its weight still counts below."""
    x = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.sum(w * F.when(~F.isnan(x), x)) / F.nullif(F.sum(w), F.lit(0.0))


def correlation(x, y) -> Column:
    """Pearson's r of columns without nulls on either side alone; null where one does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def component_means(df: DataFrame, keys: Keys, parts: Sequence[str], weight: str) -> DataFrame:
    """Weighted means of the parts, their sum as ``total``, and each part's share (ratio of sums)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), *[weighted_mean(p, weight).alias(p) for p in parts])
    out = out.withColumn("total", sum((F.col(p) for p in parts[1:]), F.col(parts[0])))
    return out.withColumns({f"{p}_share": F.col(p) / F.nullif(F.col("total"), F.lit(0.0)) for p in parts})


def component_rollup(df: DataFrame, levels: Sequence[Sequence[str]], parts: Sequence[str], weight: str) -> DataFrame:
    """``component_means`` at several levels in one pass, by grouping sets; ``level`` numbers them."""
    names = list(dict.fromkeys(k for level in levels for k in level))
    sets = [[F.col(k) for k in level] for level in levels]
    out = df.groupingSets(sets, *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.sum(weight).alias("weight"), *[weighted_mean(p, weight).alias(p) for p in parts]
    )
    code = {}
    for i, level in enumerate(levels):
        code[sum(1 << (len(names) - 1 - j) for j, n in enumerate(names) if n not in level)] = i
    number = F.lit(None).cast("int")
    for gid, i in code.items():
        number = F.when(F.col("gid") == gid, F.lit(i)).otherwise(number)
    out = out.withColumn("level", number).drop("gid").withColumn("total", sum((F.col(p) for p in parts[1:]), F.col(parts[0])))
    return out.withColumns({f"{p}_share": F.col(p) / F.nullif(F.col("total"), F.lit(0.0)) for p in parts})


def mean_of_shares(df: DataFrame, keys: Keys, part: str, total: str, weight: str) -> DataFrame:
    """The other definition of a share: the weighted mean of each path's own ratio."""
    return df.groupBy(*keys).agg(weighted_mean(F.col(part) / F.nullif(F.col(total), F.lit(0.0)), weight).alias("share"))


def change_counts(df: DataFrame, keys: Keys, delta: str, weight: str, eps: float = 1e-9) -> DataFrame:
    d = F.col(delta)
    return df.groupBy(*keys).agg(
        F.count_if(d < -eps).alias("improved"), F.count_if(d > eps).alias("worsened"), F.count_if(F.abs(d) <= eps).alias("unchanged"),
        F.sum(F.when(d < -eps, -d * F.col(weight)).otherwise(0.0)).alias("saved"), F.sum(F.when(d > eps, d * F.col(weight)).otherwise(0.0)).alias("lost"),
        F.min(d).alias("least"), F.max(d).alias("most"),
    )


def weighted_quantiles(df: DataFrame, keys: Keys, value: str, weight: str, levels: Sequence[float]) -> DataFrame:
    """Step quantiles without interpolation: the least value whose cumulative weight reaches the level.

    Rows of one value are added up first; the sums run over ranges of values, so
    a group may have any number of them.
    """
    steps = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)) & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    run = running(steps, keys, [value], "w", "cum", "all")
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("cum") >= q * F.col("all") - 1e-9 * F.col("all"), F.col(value))).alias(f"q{round(q * 1000):04d}") for q in levels])


def exact_percentiles(df: DataFrame, keys: Keys, value: str, levels: Sequence[float]) -> DataFrame:
    """Percentiles with linear interpolation; null values do not count, and a group of nothing else has null.

    The values that stand at a percentile's two places are found by counts of
    equal values that run over ranges, so a group may have any number of rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    run = running(counts.where(F.col(value).isNotNull()), keys, [value], "n", "cum", "all")

    def percentile(q: float) -> Column:
        at = (F.col("all") - 1) * q
        place = lambda i: F.min(F.when(F.col("cum") > i, F.col(value))).cast("double")
        low, high, share = place(F.floor(at)), place(F.ceil(at)), F.max(at - F.floor(at))
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(f"p{round(q * 1000):04d}")

    found = run.groupBy(*keys).agg(*[percentile(q) for q in levels])
    groups = counts.select(*keys).distinct()
    if not keys:
        return found
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]
    return groups.alias("g").join(found.alias("f"), reduce(Column.__and__, same), "left").select("g.*", *[F.col(f"f.{c}") for c in found.columns if c not in keys])


def best_rows(df: DataFrame, keys: Keys, score: str, ties: Sequence[str], most: int = 1, descending: bool = True) -> DataFrame:
    """The ``most`` best rows of each group, with ``rank``; all ties are told apart by ``ties``."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties))).where(F.col("rank") <= most)


def merged_duplicates(df: DataFrame, keys: Keys, score: str, ties: Sequence[str], text: str) -> DataFrame:
    """One row per key: the best numbers, and the distinct texts of all."""
    rest = [c for c in df.columns if c not in keys and c != text]
    rank = F.struct(F.col(score), *[-F.col(t) for t in ties])
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("best"), F.array_join(F.array_sort(F.collect_set(text)), "; ").alias(text))
    return out.select(*keys, "best.*", text)


def histogram(df: DataFrame, keys: Keys, value: str, width: float, low: float, high: float, centre: float = 0.0) -> DataFrame:
    """Counts by bin; values within ``centre`` of zero are left out, those outside go to the bins -1 and n."""
    bins = round((high - low) / width)
    x = F.col(value)
    number = F.when(x < low, -1).when(x >= high, bins).otherwise(F.floor((x - low) / width)).cast("int")
    return df.where(F.abs(x) > centre).groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"))


def shares_within(df: DataFrame, group: str, flow: str, service: str) -> DataFrame:
    """Each row's share of its group: by flow, else by service, else equal, and which it was."""
    by = Window.partitionBy(group)
    flows, services, n = F.sum(flow).over(by), F.sum(service).over(by), F.count("*").over(by)
    return df.withColumns({
        "share": F.when(flows > 0, F.col(flow) / flows).when(services > 0, F.col(service) / services).otherwise(1.0 / n),
        "method": F.when(flows > 0, "flow").when(services > 0, "service").otherwise("equal"),
    })


def largest_remainder(df: DataFrame, group: str, total: str, weight: str, name: str) -> DataFrame:
    """Whole units of ``total`` by weight; what is left goes to the largest fraction, then weight, then name, descending.

    Negative weights count as none; a group without weight is split equally.
    """
    by = Window.partitionBy(group)
    own = F.greatest(F.col(weight), F.lit(0))
    some = F.sum(own).over(by)
    exact = F.greatest(F.col(total), F.lit(0)) * F.when(some > 0, own / some).otherwise(1.0 / F.count("*").over(by))
    out = df.withColumn("exact", exact).withColumn("whole", F.floor(F.col("exact") + 1e-12))
    out = out.withColumn("left", F.col(total) - F.sum("whole").over(by))
    place = F.row_number().over(by.orderBy(F.bround(F.col("exact") - F.col("whole"), 9).desc(), F.col(weight).desc(), F.col(name).desc()))
    return out.withColumn("units", (F.col("whole") + F.when(place <= F.col("left"), 1).otherwise(0)).cast("long")).drop("exact", "whole", "left")


def edge_loads(legs: DataFrame, a: str, b: str, weight: str, od: str) -> DataFrame:
    """Load of each undirected edge and the number of pairs on it, each pair once."""
    return legs.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(weight).alias("load"), F.countDistinct(od).alias("pairs"))


def section_frequency(events: DataFrame, keys: Keys, minutes: Sequence[str], weight: str, cycle: int = 120) -> DataFrame:
    """Daily load and departures an hour: events that agree within the cycle count once."""
    face = F.struct(*[F.pmod(F.col(m), F.lit(cycle)).alias(m) for m in minutes])
    return events.groupBy(*keys).agg(F.sum(weight).alias("load"), (F.countDistinct(face) * 60.0 / cycle).alias("per_hour"))


def reachability(delta: DataFrame, origin: str, destination: str, change: str, weight: str, eps: float = 1e-9) -> DataFrame:
    """Per origin: destinations faster and slower, minutes saved and lost, best and worst destination."""
    d, w = F.col(change), F.col(weight)
    return delta.groupBy(origin).agg(
        F.count_if(d < -eps).alias("faster"), F.count_if(d > eps).alias("slower"),
        F.sum(F.when(d < -eps, -d * w).otherwise(0.0)).alias("saved"), F.sum(F.when(d > eps, d * w).otherwise(0.0)).alias("lost"),
        F.min_by(destination, F.struct(d, F.col(destination))).alias("best"), F.min_by(destination, F.struct(-d, F.col(destination))).alias("worst"),
    )


def hub_scores(df: DataFrame, year: str, name: str, transfer: str, near_miss: str, floors: tuple[float, float], always: Sequence[str], rank: int) -> DataFrame:
    """Transfer passengers plus ten times near-miss passengers, and why a hub is chosen."""
    out = df.withColumn("score", F.col(transfer) + 10 * F.col(near_miss))
    place = F.row_number().over(Window.partitionBy(year).orderBy(F.col("score").desc(), name))
    reason = (
        F.when(F.col(transfer) >= floors[0], "transfer").when(F.col(near_miss) >= floors[1], "near miss").when(F.col(name).isin(list(always)), "manual").when(place <= rank, "rank")
    )
    return out.withColumns({"place": place, "reason": reason})


def fit_statistics(df: DataFrame, keys: Keys, observed: str, modelled: str) -> DataFrame:
    """r, r², MAE, RMSE, MAPE, median APE, NRMSE and the least-squares scale through the origin."""
    x, y = F.col(modelled).cast("double"), F.col(observed).cast("double")
    ape = F.when(y != 0, F.abs(x - y) / F.abs(y))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), correlation(x, y).alias("r"), F.avg(F.abs(x - y)).alias("mae"), F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"),
        (100 * F.avg(ape)).alias("mape"), (100 * F.percentile(ape, 0.5)).alias("median_ape"), F.avg(y).alias("mean"), (F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))).alias("scale"),
    )
    return out.withColumns({"r2": F.col("r") * F.col("r"), "nrmse": F.col("rmse") / F.nullif(F.abs("mean"), F.lit(0.0))}).drop("mean")


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho with average ranks of ties.

    Only rows with both values count.  Ranks come from the distinct values,
    whose counts run over ranges; the rows are joined back.
    """
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranked(c: str) -> DataFrame:
        values = df.groupBy(c).agg(F.count("*").alias("n"))
        return running(values, [], [c], "n", "upto").select(c, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    both = df.join(ranked(a), a).join(ranked(b), b)
    return both.agg(F.count("*").alias("n"), correlation(f"rank_{a}", f"rank_{b}").alias("rho"))
