"""Demand: gravity, proportional fitting, calibration by moments and grids, projections, population.

Matrices are long tables.  Fitting keeps two vectors of factors for each key
or, for a fixed number of sweeps, runs as window aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .aggregates import correlation
from .joins import bounded
from .ordering import kept


def sweeps(df: DataFrame, keys: list[str], seed: str, row_target: str, column_target: str, count: int) -> DataFrame:
    """``count`` sweeps of proportional fitting (rows, then columns) as window aggregates, in ``value``."""
    out = df.withColumn("value", F.col(seed).cast("double"))
    for _ in range(count):
        for side, target in (("origin", row_target), ("destination", column_target)):
            total = F.sum("value").over(Window.partitionBy(*keys, side))
            out = out.withColumn("value", F.when(total > 0, F.col("value") * F.col(target) / total).otherwise(0.0))
    return out


#: The three ways of fitting: tolerance, most iterations, whether errors are relative, and after how many iterations they are looked at (fixed values).
FITS = {"absolute": (1e-8, 500, False, 1), "throughput": (1e-8, 8000, True, 5), "shrunk": (1e-8, 350, True, 25)}


#: Errors are looked at after so many iterations at least; they are one plan, so it does not grow further.
LOOK = 5
FACTORS = ("origin", "destination")


def balanced(df: DataFrame, key: str, seed: str, row_target: str, column_target: str, fit: str = "throughput", active: str | None = None) -> DataFrame:
    """Doubly constrained fitting for each ``key`` by one of ``FITS``: ``value``, ``iterations``, ``error``.

    A balanced cell is its seed times a factor of its row and one of its column.
    Only those vectors change: an iteration sums the seeds times the column
    factors by row, which gives the row factors, and the other way round.  No
    task holds a matrix.  The vectors are written after every few iterations,
    when the largest error of any row or column sum is looked at; keys that have
    converged leave.  Cells that ``active`` denies are empty, and so is a side
    without a target.  Targets are met as they are given: those of unequal sums
    leave an error, which is reported.
    """
    tolerance, most, relative, every = FITS[fit]
    step = -(-LOOK // every) * every
    cell = F.col(seed).cast("double")
    cell = F.when(F.col(active), cell).otherwise(0.0) if active else cell
    cells = kept(df.select(F.col(key).alias("key"), *FACTORS, cell.alias("seed"), F.col(row_target).cast("double").alias("row"), F.col(column_target).cast("double").alias("column")))
    targets = [kept(cells.groupBy("key", side).agg(F.max(name).alias("target"))) for side, name in zip(FACTORS, ("row", "column"))]
    seeds = kept(cells.where("seed > 0").groupBy("key", *FACTORS).agg(F.sum("seed").alias("seed")))

    def sums(over: DataFrame, by: int) -> DataFrame:
        """Sums of the seeds times the factors of the other side, for each row or column."""
        return seeds.join(over, ["key", FACTORS[1 - by]]).groupBy("key", FACTORS[by]).agg(F.sum(F.col("seed") * F.col("factor")).alias("total"))

    def factors(over: DataFrame, by: int, keys: DataFrame) -> DataFrame:
        own = targets[by].join(keys, "key", "left_semi").join(sums(over, by), ["key", FACTORS[by]], "left")
        return own.select("key", FACTORS[by], F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0).alias("factor"))

    def error(own: DataFrame, over: DataFrame, by: int) -> DataFrame:
        reached = own.join(sums(over, by), ["key", FACTORS[by]], "left").join(targets[by], ["key", FACTORS[by]])
        scale = F.greatest("target", F.lit(1e-12)) if relative else F.lit(1.0)
        return reached.select("key", (F.abs(F.col("factor") * F.coalesce("total", F.lit(0.0)) - F.col("target")) / scale).alias("error"))

    keys = cells.select("key").distinct()
    columns = targets[1].select("key", FACTORS[1], F.lit(1.0).alias("factor"))
    rows, done, n = None, None, 0
    while n < most:
        for last in reversed(range(min(step, most - n))):
            # Column factors of the iteration before, even if they are of keys that have left, meet no target row.
            rows = factors(columns, 0, keys)
            rows = rows if last else kept(rows)
            columns = factors(rows, 1, keys)
            n += 1
        columns = kept(columns)
        errors = error(rows, columns, 0).unionByName(error(columns, rows, 1)).groupBy("key").agg(F.max("error").alias("error"))
        errors = kept(errors.withColumn("iterations", F.lit(n)))
        ready = errors if n >= most else errors.where(F.col("error") <= tolerance)
        found = [x.join(ready, "key") for x in (rows, columns)]
        done = found if done is None else [a.unionByName(b) for a, b in zip(done, found)]
        keys = errors.join(ready, "key", "left_anti").select("key")
        if not keys.limit(1).count():
            break
    at = lambda x, side: x.select("key", side, F.col("factor").alias(f"{side}_factor"), *(["iterations", "error"] if side == "origin" else []))
    out = cells.join(at(done[0], "origin"), ["key", "origin"]).join(at(done[1], "destination"), ["key", "destination"])
    value = F.greatest("seed", F.lit(0.0)) * F.col("origin_factor") * F.col("destination_factor")
    return out.select(F.col("key").alias(key), *FACTORS, F.coalesce(value, F.lit(0.0)).alias("value"), F.col("iterations").cast("int").alias("iterations"), "error")


def throughput_seeds(df: DataFrame, keys: list[str], seed: str, target_o: str, target_d: str) -> DataFrame:
    """Seeds and targets for fitting to station throughput: half of it out, half in, nothing on the diagonal, and no cell off it empty.

    Fails where a station has more than half of all throughput, which no matrix
    without a diagonal can meet.
    """
    stations = df.select(*keys, F.col("origin").alias("__s"), F.col(target_o).alias("__t")).distinct()
    total = stations.groupBy(*keys).agg(F.sum("__t").alias("__all"))
    out = df.join(total, list(keys)) if keys else df.crossJoin(F.broadcast(total))
    too_much = F.col(target_o) > F.col("__all") - F.col(target_o) + 1e-9
    checked = F.when(too_much, F.raise_error(F.concat(F.lit("more than half of all throughput at "), F.col("origin"))).cast("double")).otherwise(0.5 * F.col(target_o))
    cell = F.when(F.col("origin") == F.col("destination"), 0.0).otherwise(F.greatest(F.col(seed), F.lit(1e-12)))
    return out.withColumns({"seed": cell, "row_target": checked, "column_target": 0.5 * F.col(target_d)}).drop("__all")


def marginals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The table with its row and column sums as ``row_sum`` and ``column_sum``."""
    return df.withColumns({"row_sum": F.sum(value).over(Window.partitionBy(*keys, "origin")), "column_sum": F.sum(value).over(Window.partitionBy(*keys, "destination"))})


def gravity(mass_o: Column, mass_d: Column, cost: Column, beta: float, alpha: float = 1.0, bound: float = 60.0) -> Column:
    """Log-linear gravity with a bounded exponent."""
    log = alpha * (F.ln(F.greatest(mass_o, F.lit(1e-12))) + F.ln(F.greatest(mass_d, F.lit(1e-12)))) - beta * F.ln(F.greatest(cost, F.lit(1e-12)))
    return F.exp(F.greatest(F.lit(-bound), F.least(F.lit(bound), log)))


def log_slope(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted least squares of ln y on ln x in one aggregation: ``beta`` is max(0.01, −slope), ``r2`` at least 0."""
    lx, ly, w = F.ln(x), F.ln(y), F.col(weight)
    s = df.where((F.col(x) > 0) & (F.col(y) > 0) & (w > 0)).groupBy(*keys).agg(
        F.sum(w).alias("w"), F.sum(w * lx).alias("x"), F.sum(w * ly).alias("y"), F.sum(w * lx * lx).alias("xx"), F.sum(w * lx * ly).alias("xy"), F.sum(w * ly * ly).alias("yy"), F.count("*").alias("n")
    )
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("w") for a, b, c in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y")))
    slope = sxy / F.nullif(sxx, F.lit(0.0))
    r2 = sxy * sxy / F.nullif(sxx * syy, F.lit(0.0))
    return s.select(*keys, "n", F.greatest(F.lit(0.01), -slope).alias("beta"), ((F.col("y") - slope * F.col("x")) / F.col("w")).alias("intercept"), F.greatest(F.lit(0.0), r2).alias("r2"))


def cost_sensitivity(df: DataFrame, flow: str, cost: str) -> DataFrame:
    """The fall of flow with cost: the weighted slope of ln(flow / flow expected of independence) on ln(cost)."""
    good = df.where((F.col(flow) > 0) & (F.col(cost) > 0))
    m = marginals(good, [], flow)
    total = good.agg(F.sum(flow).alias("__all"))
    x = m.crossJoin(F.broadcast(total)).withColumns({"residual": F.col(flow) * F.col("__all") / (F.col("row_sum") * F.col("column_sum")), "root": F.sqrt(flow)})
    return log_slope(x, [], cost, "residual", "root")


#: Published coefficients of the log-linear estimate of a station's daily passengers: constant, population, lines, both (fixed values).
VOLUME = (-1.795817, 0.691244, 3.936396, -0.197348)


def estimated_volume(population: Column, lines: Column) -> Column:
    a, b = F.log1p(population), F.log1p(lines)
    return F.expm1(VOLUME[0] + VOLUME[1] * a + VOLUME[2] * b + VOLUME[3] * a * b)


def imputed_volume(observed: Column, exact: Column, population: Column, lines: Column) -> Column:
    """The observed volume of an exactly matched station, else the rounded estimate."""
    return F.when(exact & observed.isNotNull(), observed).otherwise(F.bround(estimated_volume(population, lines), 0))


def grid_search(pairs: DataFrame, grid: DataFrame, model: Column, observed: str, keys: list[str]) -> DataFrame:
    """The best parameters of a bounded grid: least median APE, then share beyond 30 %, then MAPE, then greatest r².

    ``model`` is an expression over pairs and grid columns.  One pass over the
    pairs, each row meeting each candidate.
    """
    ape = F.when(F.col(observed) != 0, F.abs(F.col("__m") - F.col(observed)) / F.abs(F.col(observed)))
    fits = pairs.crossJoin(F.broadcast(bounded(grid))).withColumn("__m", model).groupBy(*grid.columns).agg(
        F.percentile(ape, 0.5).alias("median_ape"), F.avg(F.when(ape <= 0.3, 1.0).otherwise(0.0)).alias("within30"), F.avg(ape).alias("mape"), correlation("__m", observed).alias("r")
    )
    order = F.struct("median_ape", (-F.col("within30")).alias("a"), "mape", (-F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))).alias("b"), *keys)
    return fits.agg(F.min_by(F.struct(*fits.columns), order).alias("best")).select("best.*")


def random_candidates(spark, count: int, bounds: dict[str, tuple[float, float]], seed: int = 20260413) -> DataFrame:
    """Uniform draws of parameters by the PCG64 generator, the same at every run."""
    rng = np.random.Generator(np.random.PCG64(seed))
    draws = {k: rng.uniform(a, b, count).tolist() for k, (a, b) in bounds.items()}
    return spark.createDataFrame(pd.DataFrame({"candidate": range(count), **draws}))


#: Bounds of the gravity model's parameters (fixed values).
GRAVITY = {
    "origin_pop_exp": (0.20, 1.80), "dest_pop_exp": (0.20, 1.80), "origin_lines_exp": (0.00, 1.20), "dest_lines_exp": (0.00, 1.20), "freq_coef": (0.00, 1.40), "dist_log_coef": (0.20, 2.50),
    "fastest_coef": (0.000, 0.060), "wait_coef": (0.000, 0.120), "rolling_coef": (0.000, 0.050), "dwell_coef": (0.000, 0.040), "transfer_coef": (0.000, 0.180), "hub_transfer_bonus": (0.00, 0.80),
}
LOG_BOUND = 60.0


def gravity_throughput(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Throughput of each station under each candidate's parameters: ``candidate``, ``station``, ``hub``, ``observed``, ``modelled``.

    ``pairs``: ``origin``, ``destination``, and for either end (``o_``, ``d_``)
    ``pop``, ``lines``, ``hub`` (0 to 1) and ``observed``; ``freq``, ``km``,
    ``fastest``, ``wait``, ``rolling``, ``dwell``, ``transfer``.  Candidates are
    a bounded table; a pair meets each of them and goes to both its stations,
    summed before anything is shuffled.
    """
    term = lambda name, c: F.col(name) * c
    log = (
        term("freq_coef", F.log1p(F.greatest("freq", F.lit(0.0)))) - term("dist_log_coef", F.log1p(F.greatest("km", F.lit(0.0)))) - term("fastest_coef", F.col("fastest")) - term("wait_coef", F.col("wait"))
        - term("rolling_coef", F.col("rolling")) - term("dwell_coef", F.col("dwell")) - term("transfer_coef", F.col("transfer"))
        + term("origin_pop_exp", F.log1p("o_pop")) + term("origin_lines_exp", F.log1p("o_lines")) + term("dest_pop_exp", F.log1p("d_pop")) + term("dest_lines_exp", F.log1p("d_lines"))
    )
    flow = F.exp(F.greatest(F.lit(-LOG_BOUND), F.least(F.lit(LOG_BOUND), log)))
    met = pairs.where("origin <> destination").crossJoin(F.broadcast(bounded(candidates))).withColumn("flow", flow)
    end = lambda s, p: F.struct(F.col(s).alias("station"), F.col(f"{p}_hub").alias("hub"), F.col(f"{p}_observed").alias("observed"))
    each = met.select("candidate", "hub_transfer_bonus", "flow", F.explode(F.array(end("origin", "o"), end("destination", "d"))).alias("s")).select("candidate", "hub_transfer_bonus", "flow", "s.*")
    out = each.groupBy("candidate", "hub_transfer_bonus", "station", "hub", "observed").agg(F.sum("flow").alias("flow"))
    return out.select("candidate", "station", "hub", "observed", (F.col("flow") * (1 + F.col("hub_transfer_bonus") * F.col("hub"))).alias("modelled"))


def candidate_metrics(throughput: DataFrame) -> DataFrame:
    """By candidate, against observed stations: the least-squares ``scale``, then errors of the scaled model, r² and the ``score`` (relative RMSE and half the MAPE)."""
    good = throughput.where("observed IS NOT NULL")
    eps = F.lit(1e-12)
    scaled = good.groupBy("candidate").agg(F.greatest(F.sum(F.col("observed") * F.col("modelled")) / (F.sum(F.col("modelled") * F.col("modelled")) + eps), eps).alias("scale"), F.avg("observed").alias("mean"))
    wrong = F.col("modelled") * F.col("scale") - F.col("observed")
    rows = good.join(F.broadcast(scaled), "candidate").withColumns({"wrong": wrong, "off": F.col("observed") - F.col("mean")})
    out = rows.groupBy("candidate", "scale", "mean").agg(
        F.avg(F.abs("wrong")).alias("mae"), F.sqrt(F.avg(F.col("wrong") * F.col("wrong"))).alias("rmse"), (100 * F.avg(F.abs("wrong") / F.greatest("observed", eps))).alias("mape"),
        F.sum(F.col("wrong") * F.col("wrong")).alias("__res"), F.sum(F.col("off") * F.col("off")).alias("__tot"),
    )
    out = out.withColumns({"nrmse": F.col("rmse") / F.greatest("mean", eps), "r2": F.when(F.col("__tot") > eps, 1 - F.col("__res") / F.col("__tot"))})
    return out.withColumn("score", F.col("nrmse") + 0.5 * F.col("mape") / 100).drop("mean", "__res", "__tot")


def year_targets(stations: DataFrame) -> DataFrame:
    """Origin and destination targets of a year: the base year's sums by population growth, nothing where inactive, both scaled to their mean total.

    ``stations``: ``station``, ``outbound``, ``inbound``, ``pop_base``, ``pop_year``, ``active``.
    """
    growth = F.when(F.col("active"), F.col("pop_year") / F.greatest("pop_base", F.lit(1))).otherwise(0.0)
    raw = stations.withColumns({"__o": F.coalesce("outbound", F.lit(0.0)) * growth, "__d": F.coalesce("inbound", F.lit(0.0)) * growth})
    total = raw.agg(F.sum("__o").alias("__so"), F.sum("__d").alias("__sd"))
    mean = F.when((F.col("__so") > 0) & (F.col("__sd") > 0), (F.col("__so") + F.col("__sd")) / 2).otherwise(F.greatest("__so", "__sd"))
    scaled = lambda v, s: F.when(F.col(s) > 0, F.col(v) * mean / F.col(s)).otherwise(0.0)
    return raw.crossJoin(F.broadcast(total)).withColumns({"origin_target": scaled("__o", "__so"), "destination_target": scaled("__d", "__sd")}).drop("__o", "__d", "__so", "__sd")


def historical_seed(base: Column, cost_then: Column, cost_now: Column, beta: float) -> Column:
    """Another year's seed: the base flow by the ratio of costs to the power of the sensitivity, never nothing."""
    return F.greatest(F.lit(1e-12), base * F.pow(cost_then / cost_now, F.lit(beta)))


#: Fixed bounds of ratios in the projection: paths, waits, population.
RATIOS = {"paths": (0.5, 2.5), "wait": (0.5, 2.5), "population": (0.5, 3.0)}


def projected(pairs: DataFrame, service: float = 0.5, wait: float = 0.0, smoothing: float = 1.0, bounds: dict = RATIOS) -> DataFrame:
    """Seeds of a later year: demand by growth of both ends, by the ratio of path counts and by that of waits, each bounded.

    ``pairs`` (off the diagonal): ``w``, ``growth_o``, ``growth_d``, ``paths``
    (the ratio of path counts), ``wait_then``, ``wait_now`` (null: the median of
    pairs that have both).  Adds ``path_ratio``, ``wait_ratio`` and ``seed``, at
    least a billionth of the median positive seed.
    """
    known = F.col("wait_then").isNotNull() & F.col("wait_now").isNotNull()
    median = lambda c: F.percentile(F.when(known, F.col(c)), 0.5)
    filled = pairs.agg(F.coalesce(median("wait_then"), F.lit(10.0)).alias("__then"), F.coalesce(median("wait_now"), F.lit(10.0)).alias("__now"))
    at = lambda c, m: F.greatest(F.coalesce(c, m), F.lit(0.0)) + smoothing
    bound = lambda c, k: F.greatest(F.lit(bounds[k][0]), F.least(F.lit(bounds[k][1]), c))
    out = pairs.crossJoin(F.broadcast(filled)).withColumns({
        "path_ratio": bound(F.col("paths"), "paths"), "wait_ratio": bound(at("wait_now", "__now") / F.greatest(at("wait_then", "__then"), F.lit(1e-12)), "wait"),
        "growth_o": bound(F.col("growth_o"), "population"), "growth_d": bound(F.col("growth_d"), "population"),
    }).drop("__then", "__now")
    raw = F.greatest("w", F.lit(0.0)) * F.sqrt(F.col("growth_o") * F.col("growth_d")) * F.pow("path_ratio", F.lit(service)) * F.pow("wait_ratio", F.lit(wait))
    out = out.withColumn("seed", raw)
    least = out.agg(F.greatest(F.coalesce(F.percentile(F.when(F.col("seed") > 0, F.col("seed")), 0.5), F.lit(1.0)) * 1e-9, F.lit(1e-12)).alias("__least"))
    return out.crossJoin(F.broadcast(least)).withColumn("seed", F.greatest("seed", "__least")).drop("__least")


def projected_targets(pairs: DataFrame, volume: DataFrame, service: float = 0.5, wait: float = 0.0, bounds: dict = RATIOS) -> DataFrame:
    """Station targets of a later year: throughput by growth, and by the geometric mean of the flow-weighted ratios out and in.

    ``pairs``: as ``projected`` gives them; ``volume``: ``station``, ``volume``,
    which stands in for the throughput of a station without flow, whose ratios
    are then the medians of its pairs.
    """
    side = lambda s, g, n: pairs.groupBy(F.col(s).alias("station")).agg(
        F.sum("w").alias(f"{n}_w"), F.max(g).alias(f"{n}_g"),
        *[F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col(r)) / F.sum("w")).otherwise(F.percentile(r, 0.5)).alias(f"{n}_{r}") for r in ("path_ratio", "wait_ratio")],
    )
    both = side("origin", "growth_o", "o").join(side("destination", "growth_d", "d"), "station").join(volume, "station", "left")
    ratio = lambda r, k: F.greatest(F.lit(bounds[k][0]), F.least(F.lit(bounds[k][1]), F.sqrt(F.greatest(f"o_{r}", F.lit(1e-12)) * F.greatest(f"d_{r}", F.lit(1e-12)))))
    flow = F.col("o_w") + F.col("d_w")
    out = both.withColumns({"throughput": F.when(flow > 0, flow).otherwise(F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0))), "path_ratio": ratio("path_ratio", "paths"), "wait_ratio": ratio("wait_ratio", "wait")})
    return out.select("station", "throughput", "path_ratio", "wait_ratio", (F.col("throughput") * F.col("o_g") * F.pow("path_ratio", F.lit(service)) * F.pow("wait_ratio", F.lit(wait))).alias("target"))


def induced(stations: DataFrame, origin: float, destination: float, low: float = 0.7, high: float = 1.8, keep_total: bool = True) -> DataFrame:
    """Station targets after a change of access: a bounded factor by either elasticity, their geometric mean, and the old total again if it is kept.

    ``stations``: ``before``, ``after`` (access), ``target``.
    """
    change = F.ln(F.greatest("after", F.lit(1e-12))) - F.ln(F.greatest("before", F.lit(1e-12)))
    one = lambda e: F.greatest(F.lit(low), F.least(F.lit(high), F.exp(e * change)))
    out = stations.withColumn("factor", F.sqrt(one(origin) * one(destination))).withColumn("adjusted", F.greatest(F.col("target") * F.col("factor"), F.lit(0.0)))
    if not keep_total:
        return out
    total = out.agg((F.sum("target") / F.nullif(F.sum("adjusted"), F.lit(0.0))).alias("__by"))
    return out.crossJoin(F.broadcast(total)).withColumn("adjusted", F.col("adjusted") * F.coalesce("__by", F.lit(1.0))).drop("__by")


def corrected_targets(stations: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Targets of two years without overconfident estimates: ``now`` and ``later``.

    Exactly observed stations keep theirs.  Others take the geometric blend with
    the raw model now, and later keep their rise on the corrected target; a
    station that is new later takes its blend then.  ``stations``: ``exact_now``,
    ``target_now``, ``model_now``, ``exact_later``, ``target_later``, ``model_later``; null now: new later.
    """
    blend = lambda t, m: F.when((t > 0) & (m > 0), F.exp(alpha * F.ln(t) + (1 - alpha) * F.ln(m))).otherwise(F.greatest(t, m, F.lit(0.0)))
    now = F.when(F.col("exact_now"), F.col("target_now")).otherwise(blend(F.col("target_now"), F.col("model_now")))
    rise = F.col("target_later") / F.greatest("target_now", F.lit(1e-12))
    later = F.when(F.col("exact_later"), F.col("target_later")).when(F.col("target_now") > 0, now * rise).otherwise(blend(F.col("target_later"), F.col("model_later")))
    return stations.withColumns({"now": now, "later": later})


def cluster_flows(master: DataFrame, stations: DataFrame, selected: DataFrame, scale: float) -> DataFrame:
    """Weights of selected station pairs from flows between clusters.

    ``master``: ``origin``, ``destination``, ``trips``; ``stations``: ``station``,
    ``cluster`` (others are a cluster of their own); ``selected``: ``station``,
    ``cluster``, ``out_share``, ``in_share``, ``x``, ``y``.  Between clusters the
    flow of all their stations is dealt out by shares; within one, the pair's own
    flow stays, less by ``min(1, distance / scale)``.
    """
    side = lambda s: stations.select(F.col("station").alias(s), F.col("cluster").alias(f"{s}_cluster"))
    own = lambda s: F.coalesce(f"{s}_cluster", F.concat(F.lit("station:"), s))
    named = master.join(side("origin"), "origin", "left").join(side("destination"), "destination", "left").select("origin", "destination", "trips", own("origin").alias("oc"), own("destination").alias("dc"))
    between = named.where("oc <> dc").groupBy("oc", "dc").agg(F.sum("trips").alias("flow"))
    o, d = (bounded(selected).select(F.col("station").alias(n), F.col("cluster").alias(c), F.col(share).alias(f"__{n}"), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y")) for n, c, share in (("origin", "oc", "out_share"), ("destination", "dc", "in_share")))
    far = between.join(o, "oc").join(d, "dc").select("origin", "destination", F.lit("between").alias("method"), (F.col("flow") * F.col("__origin") * F.col("__destination")).alias("weight"))
    km = F.sqrt(F.pow(F.col("origin_x") - F.col("destination_x"), 2) + F.pow(F.col("origin_y") - F.col("destination_y"), 2))
    near = named.where("oc = dc AND origin <> destination").groupBy("origin", "destination").agg(F.sum("trips").alias("trips"))
    near = near.join(o, "origin").join(d, "destination").select("origin", "destination", F.lit("within").alias("method"), (F.col("trips") * S.attenuation(km, scale)).alias("weight"))
    return far.unionByName(near)


def growth(population: DataFrame, region: str, year: str, value: str, reference: int) -> DataFrame:
    """Each region and year's population over that of the reference year."""
    ref = population.where(F.col(year) == reference).select(region, F.col(value).alias("__ref"))
    return population.join(ref, region).withColumn("growth", F.col(value) / F.nullif(F.col("__ref"), F.lit(0))).drop("__ref")


def tiered_choice(df: DataFrame, keys: list[str], tiers: Column, order: list) -> DataFrame:
    """One row per key: of the least tier, then in order (a municipality by preference)."""
    by = Window.partitionBy(*keys).orderBy(tiers, *order)
    return df.withColumn("tier", tiers).withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
