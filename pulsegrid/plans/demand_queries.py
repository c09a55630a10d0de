"""Queries of the demand model: fitting, gravity, calibration, projection, targets, population."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import demand as D
from . import inputs as I
from .registry import add

FIT = f"{I.DEMAND}, m AS (SELECT origin, destination, sum(weight) AS w, 1.0 + abs(hash_o - hash_d) AS seed FROM (SELECT *, length(origin) AS hash_o, length(destination) AS hash_d FROM demand) GROUP BY ALL), t AS (SELECT *, sum(w) OVER (PARTITION BY origin) AS tr, sum(w) OVER (PARTITION BY destination) AS tc FROM m)"


def _fit(spark, sf):
    m = I.demand(spark, sf).groupBy("origin", "destination").agg(F.sum("weight").alias("w")).withColumns({"seed": 1.0 + F.abs(F.length("origin") - F.length("destination")), "all": F.lit(1)})
    return D.marginals(m, [], "w")


def _sweeps(count: int, source: str, seed: str, rows: str, columns: str) -> str:
    """So many sweeps of fitting, unrolled; the last table is ``f``."""
    steps, last, value = [], source, seed
    for i in range(count):
        a, b = f"a{i}", "f" if i == count - 1 else f"b{i}"
        kept = "* EXCLUDE (v)" if value == "v" else "*"
        steps.append(f"{a} AS (SELECT {kept}, {value} * {rows} / sum({value}) OVER (PARTITION BY origin) AS u FROM {last})")
        steps.append(f"{b} AS (SELECT * EXCLUDE (u), u * {columns} / sum(u) OVER (PARTITION BY destination) AS v FROM {a})")
        last, value = b, "v"
    return ", ".join(steps)


@add("D02", f"WITH {FIT}, {_sweeps(2, 't', 'seed', 'tr', 'tc')} SELECT origin, destination, v AS value FROM f", "value", "", 4)
def fitting_sweeps(spark, sf):
    return D.sweeps(_fit(spark, sf), [], "seed", "row_sum", "column_sum", 2).select("origin", "destination", "value")


@add("D02", f"WITH {FIT}, {_sweeps(40, 't', 'seed', 'tr', 'tc')} SELECT origin, destination, v AS value FROM f", "value", "", 3)
def balanced_matrix(spark, sf):
    """Fitting to convergence with relative errors of both sides: the matrix, not only its sums."""
    return D.balanced(_fit(spark, sf), "all", "seed", "row_sum", "column_sum").select("origin", "destination", "value")


ACTIVE = f"""{FIT}, n AS (SELECT * REPLACE (CASE WHEN origin IN ('NATION_7', 'NATION_12') AND length(destination) = 9 THEN 0 ELSE seed END AS seed) FROM t)"""


@add("D02", f"WITH {ACTIVE}, z AS (SELECT origin, destination, w, seed, sum(CASE WHEN seed > 0 THEN w ELSE 0 END) OVER (PARTITION BY origin) AS tr, sum(CASE WHEN seed > 0 THEN w ELSE 0 END) OVER (PARTITION BY destination) AS tc FROM n), {_sweeps(60, 'z', 'seed', 'tr', 'tc')} SELECT origin, destination, coalesce(v, 0) AS value FROM f", "value", "", 2)
def balanced_active_cells(spark, sf):
    """Fitting with absolute errors where some cells are not active; the targets are those of a matrix without them."""
    m = _fit(spark, sf).drop("row_sum", "column_sum").withColumn("active", ~(F.col("origin").isin("NATION_7", "NATION_12") & (F.length("destination") == 9)))
    t = D.marginals(m.withColumn("kept", F.when(F.col("active"), F.col("w")).otherwise(0.0)), [], "kept")
    return D.balanced(t, "all", "seed", "row_sum", "column_sum", "absolute", "active").select("origin", "destination", "value")


THROUGH = f"""{I.DEMAND}, w AS (SELECT origin, destination, sum(weight) AS w FROM demand GROUP BY ALL), s AS (SELECT station, sum(w) AS t FROM (SELECT origin AS station, w FROM w UNION ALL SELECT destination, w FROM w) GROUP BY station),
  g AS (SELECT o.station AS origin, d.station AS destination, o.t / 2 AS tr, d.t / 2 AS tc, CASE WHEN o.station = d.station THEN 0 ELSE greatest(1e-12, coalesce(w, 0)) END AS seed FROM s o CROSS JOIN s d LEFT JOIN w ON w.origin = o.station AND w.destination = d.station)"""


@add("D02 D16", f"WITH {THROUGH}, {_sweeps(40, 'g', 'seed', 'tr', 'tc')} SELECT origin, destination, v AS value FROM f", "value", "", 3)
def balanced_throughput(spark, sf):
    """Fitting to station throughput, half of it out and half in, with an empty diagonal."""
    w = I.demand(spark, sf).groupBy("origin", "destination").agg(F.sum("weight").alias("w"))
    t = w.select(F.explode(F.array("origin", "destination")).alias("station"), "w").groupBy("station").agg(F.sum("w").alias("t"))
    grid = t.toDF("origin", "o_t").crossJoin(F.broadcast(t.toDF("destination", "d_t"))).join(w, ["origin", "destination"], "left").na.fill(0.0, ["w"]).withColumn("all", F.lit(1))
    seeds = D.throughput_seeds(grid, [], "w", "o_t", "d_t")
    return D.balanced(seeds, "all", "seed", "row_target", "column_target").select("origin", "destination", "value")


PAIRS = f"""{I.STATIONS}, {I.DEMAND}, x AS (SELECT o.station AS origin, d.station AS destination, any_value(o.id) AS oi, any_value(d.id) AS di, sum(m.weight) AS w, any_value(abs(o.lat - d.lat) * 111 + abs(o.lon - d.lon) * 76 + 1) AS km FROM demand m JOIN stations o ON m.origin = o.station JOIN stations d ON m.destination = d.station GROUP BY ALL)"""


def _pairs(spark, sf):
    s = I.stations(spark, sf)
    o, d = (s.select(F.col("station").alias(n), F.col("id").alias(i), F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon")) for n, i in (("origin", "oi"), ("destination", "di")))
    m = I.demand(spark, sf).groupBy("origin", "destination").agg(F.sum("weight").alias("w"))
    km = F.abs(F.col("origin_lat") - F.col("destination_lat")) * 111 + F.abs(F.col("origin_lon") - F.col("destination_lon")) * 76 + 1
    return m.join(o, "origin").join(d, "destination").select("origin", "destination", "oi", "di", "w", km.alias("km"))


@add("D03", f"WITH {PAIRS} SELECT origin, destination, exp(greatest(-60, least(60, ln(so) + ln(sd) - 1.5 * ln(km)))) AS flow FROM (SELECT *, sum(w) OVER (PARTITION BY origin) AS so, sum(w) OVER (PARTITION BY destination) AS sd FROM x)", "flow", "", 3)
def gravity_flows(spark, sf):
    m = D.marginals(_pairs(spark, sf), [], "w")
    return m.select("origin", "destination", D.gravity(F.col("row_sum"), F.col("column_sum"), F.col("km"), 1.5).alias("flow"))


@add("D05", f"""WITH {PAIRS}, e AS (SELECT sqrt(w) AS g, ln(km) AS lx, ln(w * sum(w) OVER () / (sum(w) OVER (PARTITION BY origin) * sum(w) OVER (PARTITION BY destination))) AS ly FROM x),
  m AS (SELECT sum(g * lx) / sum(g) AS mx, sum(g * ly) / sum(g) AS my FROM e), s AS (SELECT count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(g * (lx - mx) * (ly - my)) AS xy, sum(g * (lx - mx) * (lx - mx)) AS xx, sum(g * (ly - my) * (ly - my)) AS yy FROM e, m)
  SELECT n, greatest(0.01, -xy / xx) AS beta, my - xy / xx * mx AS intercept, greatest(0, xy * xy / (xx * yy)) AS r2 FROM s""", "beta intercept r2", "n", 5)
def cost_sensitivity(spark, sf):
    return D.cost_sensitivity(_pairs(spark, sf), "w", "km")


@add("D06 P07", """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_mktsegment = 'BUILDING' THEN c_acctbal ELSE round_even(exp(-1.795817 + 0.691244 * ln(1 + c_custkey) + 3.936396 * ln(1 + c_nationkey) - 0.197348 * ln(1 + c_custkey) * ln(1 + c_nationkey)) - 1, 0) END AS volume FROM customer""", "volume", "", 0)
def imputed_volumes(spark, sf):
    c = I.read(spark, sf, "customer")
    return c.select("c_custkey", D.imputed_volume(F.col("c_acctbal"), (F.col("c_acctbal") > 0) & (F.col("c_mktsegment") == "BUILDING"), F.col("c_custkey"), F.col("c_nationkey")).alias("volume"))


@add("D09", f"""WITH {PAIRS}, g AS (SELECT unnest([5.0, 20.0, 80.0, 320.0]) AS scale), m AS (SELECT scale, w, km, least(1, km / scale) * 2000 AS v FROM x CROSS JOIN g),
  f AS (SELECT scale, quantile_cont(abs(v - w) / w, 0.5) AS median_ape, avg(CASE WHEN abs(v - w) / w <= 0.3 THEN 1.0 ELSE 0 END) AS within30, avg(abs(v - w) / w) AS mape FROM m GROUP BY scale)
  SELECT CAST(scale AS DOUBLE) AS scale, median_ape, within30, mape FROM f ORDER BY median_ape, -within30, mape, scale LIMIT 1""", "median_ape within30 mape")
def attenuation_grid(spark, sf):
    grid = spark.createDataFrame([(5.0,), (20.0,), (80.0,), (320.0,)], "scale double")
    return D.grid_search(_pairs(spark, sf), grid, F.least(F.lit(1.0), F.col("km") / F.col("scale")) * 2000, "w", ["scale"]).select("scale", "median_ape", "within30", "mape")


DRAWS = 120


def _draws() -> str:
    rng = np.random.Generator(np.random.PCG64(20260413))
    columns = [rng.uniform(a, b, DRAWS) for a, b in D.GRAVITY.values()]
    rows = ", ".join("(" + ", ".join([str(i), *(repr(float(c[i])) + "::DOUBLE" for c in columns)]) + ")" for i in range(DRAWS))
    return f"draws AS (SELECT * FROM (VALUES {rows}) AS t(candidate, {', '.join(D.GRAVITY)}))"


#: Features of pairs of stations and, every fifth station apart, an observed throughput.
FEATURES = f"""{PAIRS}, y AS (SELECT *, di % 5 + 1.0 AS freq, km / 90 AS fastest, (oi * di) % 17 AS wait, km / 2 AS rolling, (oi + di) % 9 AS dwell, oi % 4 AS transfer,
    oi * 100.0 + 50 AS o_pop, di * 100.0 + 50 AS d_pop, oi % 7 + 1.0 AS o_lines, di % 7 + 1.0 AS d_lines, oi % 7 / 6.0 AS o_hub, di % 7 / 6.0 AS d_hub FROM x),
  o AS (SELECT oi AS id, sum(w) AS observed FROM x GROUP BY oi HAVING oi % 5 <> 0)"""
METRICS = f"""WITH {FEATURES}, {_draws()}, e AS (SELECT candidate, hub_transfer_bonus AS bonus, oi, di, exp(greatest(-60, least(60, freq_coef * ln(1 + freq) - dist_log_coef * ln(1 + km) - fastest_coef * fastest - wait_coef * wait - rolling_coef * rolling - dwell_coef * dwell - transfer_coef * transfer
    + origin_pop_exp * ln(1 + o_pop) + origin_lines_exp * ln(1 + o_lines) + dest_pop_exp * ln(1 + d_pop) + dest_lines_exp * ln(1 + d_lines)))) AS flow FROM y CROSS JOIN draws),
  s AS (SELECT candidate, id, sum(flow) * (1 + any_value(bonus) * (id % 7) / 6.0) AS q FROM (SELECT candidate, bonus, oi AS id, flow FROM e UNION ALL SELECT candidate, bonus, di, flow FROM e) GROUP BY candidate, id),
  j AS (SELECT candidate, q, observed AS t, sum(q * observed) OVER c / sum(q * q) OVER c AS scale, avg(observed) OVER c AS mean FROM s JOIN o USING (id) WINDOW c AS (PARTITION BY candidate)),
  fits AS (SELECT candidate, any_value(scale) AS scale, sqrt(avg(pow(q * scale - t, 2))) / any_value(mean) AS nrmse, 100 * avg(abs(q * scale - t) / t) AS mape, 1 - sum(pow(q * scale - t, 2)) / sum(pow(t - mean, 2)) AS r2 FROM j GROUP BY candidate)"""


def _metrics(spark, sf):
    x = _pairs(spark, sf)
    o, d = F.col("oi"), F.col("di")
    seen = x.groupBy("oi").agg(F.sum("w").alias("o_observed")).where("oi % 5 <> 0")
    y = x.withColumns({
        "freq": d % 5 + 1.0, "fastest": F.col("km") / 90, "wait": (o * d) % 17, "rolling": F.col("km") / 2, "dwell": (o + d) % 9, "transfer": o % 4,
        "o_pop": o * 100.0 + 50, "d_pop": d * 100.0 + 50, "o_lines": o % 7 + 1.0, "d_lines": d % 7 + 1.0, "o_hub": o % 7 / 6.0, "d_hub": d % 7 / 6.0,
    }).join(seen, "oi", "left").join(seen.toDF("di", "d_observed"), "di", "left")
    draws = D.random_candidates(spark, DRAWS, D.GRAVITY)
    return D.candidate_metrics(D.gravity_throughput(y, draws)), draws


@add("D04 M02", f"{METRICS} SELECT candidate, scale, nrmse, mape, r2, nrmse + 0.5 * mape / 100 AS score FROM fits ORDER BY score, candidate LIMIT 10", "scale nrmse mape r2 score", "candidate")
def random_calibration(spark, sf):
    """The ten best of all random draws of the twelve gravity parameters."""
    return _metrics(spark, sf)[0].orderBy("score", "candidate").limit(10).select("candidate", "scale", "nrmse", "mape", "r2", "score")


@add("M03 A12 W03", f"""{METRICS}, c AS (SELECT *, nrmse + 0.5 * mape / 100 AS score FROM fits JOIN draws USING (candidate)), l AS (UNPIVOT (SELECT score, {', '.join(D.GRAVITY)} FROM c) ON {', '.join(D.GRAVITY)} INTO NAME parameter VALUE value),
  k AS (SELECT *, rank() OVER (PARTITION BY parameter ORDER BY value) + (count(*) OVER (PARTITION BY parameter, value) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY parameter ORDER BY score) + (count(*) OVER (PARTITION BY parameter, score) - 1) / 2.0 AS rs, row_number() OVER (PARTITION BY parameter ORDER BY score) AS place FROM l)
  SELECT parameter, corr(value, score) AS pearson, corr(rv, rs) AS spearman, quantile_cont(CASE WHEN place <= {DRAWS // 10} THEN value END, 0.5) AS top_median, quantile_cont(score, 0.1) AS score_p10 FROM k GROUP BY parameter""", "pearson spearman top_median score_p10")
def candidate_diagnostics(spark, sf):
    """How each parameter goes with the score over all draws, and its median in the best tenth."""
    from ..operators.aggregates import correlation

    metrics, draws = _metrics(spark, sf)
    c = metrics.select("candidate", "score").join(draws, "candidate")
    long = c.select("candidate", "score", F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value")) for p in D.GRAVITY])).alias("p")).select("candidate", "score", "p.*")
    by = Window.partitionBy("parameter")
    mean_rank = lambda x: F.rank().over(by.orderBy(x)) + (F.count("*").over(Window.partitionBy("parameter", x)) - 1) / 2
    ranked = long.withColumns({"rv": mean_rank("value"), "rs": mean_rank("score"), "place": F.row_number().over(by.orderBy("score"))})
    return ranked.groupBy("parameter").agg(
        correlation("value", "score").alias("pearson"), correlation("rv", "rs").alias("spearman"), F.percentile(F.when(F.col("place") <= DRAWS // 10, F.col("value")), 0.5).alias("top_median"), F.percentile("score", 0.1).alias("score_p10")
    )


TARGETS = f"""{I.STATIONS}, {I.DEMAND}, o AS (SELECT origin AS station, sum(weight) AS w FROM demand WHERE year = 1995 GROUP BY origin), i AS (SELECT destination AS station, sum(weight) AS w FROM demand WHERE year = 1995 GROUP BY destination),
  r AS (SELECT station, CASE WHEN id % 6 <> 0 THEN coalesce(o.w, 0) * (1 + id / 50.0) ELSE 0 END AS a, CASE WHEN id % 6 <> 0 THEN coalesce(i.w, 0) * (1 + id / 50.0) ELSE 0 END AS b FROM stations LEFT JOIN o USING (station) LEFT JOIN i USING (station))"""


@add("D07", f"WITH {TARGETS} SELECT station, a * (sum(a) OVER () + sum(b) OVER ()) / 2 / sum(a) OVER () AS origin_target, b * (sum(a) OVER () + sum(b) OVER ()) / 2 / sum(b) OVER () AS destination_target FROM r", "origin_target destination_target", "", 4)
def year_targets(spark, sf):
    d = I.demand(spark, sf).where("year = 1995")
    s = I.stations(spark, sf).join(d.groupBy(F.col("origin").alias("station")).agg(F.sum("weight").alias("outbound")), "station", "left").join(d.groupBy(F.col("destination").alias("station")).agg(F.sum("weight").alias("inbound")), "station", "left")
    return D.year_targets(s.withColumns({"pop_base": F.lit(1000.0), "pop_year": 1000.0 + F.col("id") * 20, "active": F.col("id") % 6 != 0})).select("station", "origin_target", "destination_target")


@add("D07", f"WITH {PAIRS} SELECT origin, destination, greatest(1e-12, w * pow(km / (km + 5), 1.7)) AS seed FROM x", "seed", "", 5)
def historical_seeds(spark, sf):
    return _pairs(spark, sf).select("origin", "destination", D.historical_seed(F.col("w"), F.col("km"), F.col("km") + 5, 1.7).alias("seed"))


PROJECTION = f"""{PAIRS}, p AS (SELECT origin, destination, w, 0.4 + oi / 6.0 AS go, 0.4 + di / 6.0 AS gd, greatest(0.5, least(2.5, 0.3 + (oi * di) % 13 / 4.0)) AS path_ratio, CASE WHEN (oi + di) % 5 = 0 THEN NULL ELSE oi % 8 + 1.0 END AS a, di % 11 + 0.5 AS b FROM x),
  med AS (SELECT quantile_cont(a, 0.5) FILTER (a IS NOT NULL) AS ma, quantile_cont(b, 0.5) FILTER (a IS NOT NULL) AS mb FROM p),
  q AS (SELECT *, greatest(0.5, least(3, go)) AS g1, greatest(0.5, least(3, gd)) AS g2, greatest(0.5, least(2.5, (b + 1) / (coalesce(a, ma) + 1))) AS wait_ratio FROM p, med)"""


def _projection(spark, sf):
    o, d = F.col("oi"), F.col("di")
    p = _pairs(spark, sf).withColumns({"growth_o": 0.4 + o / 6.0, "growth_d": 0.4 + d / 6.0, "paths": 0.3 + (o * d) % 13 / 4.0, "wait_then": F.when((o + d) % 5 != 0, o % 8 + 1.0), "wait_now": d % 11 + 0.5})
    return D.projected(p, 0.5, -0.3)


@add("D10", f"WITH {PROJECTION}, s AS (SELECT *, w * sqrt(g1 * g2) * pow(path_ratio, 0.5) * pow(wait_ratio, -0.3) AS raw FROM q) SELECT origin, destination, greatest(raw, (SELECT quantile_cont(raw, 0.5) FROM s WHERE raw > 0) * 1e-9) AS seed FROM s", "seed", "", 4)
def projected_seeds(spark, sf):
    return _projection(spark, sf).select("origin", "destination", "seed")


@add("D10", f"""WITH {PROJECTION}, o AS (SELECT origin AS station, sum(w) AS w, any_value(g1) AS g, sum(w * path_ratio) / sum(w) AS pr, sum(w * wait_ratio) / sum(w) AS wr FROM q GROUP BY origin), i AS (SELECT destination AS station, sum(w) AS w, sum(w * path_ratio) / sum(w) AS pr, sum(w * wait_ratio) / sum(w) AS wr FROM q GROUP BY destination)
  SELECT station, o.w + i.w AS throughput, (o.w + i.w) * o.g * pow(greatest(0.5, least(2.5, sqrt(o.pr * i.pr))), 0.5) * pow(greatest(0.5, least(2.5, sqrt(o.wr * i.wr))), -0.3) AS target FROM o JOIN i USING (station)""", "throughput target", "", 3)
def projected_targets(spark, sf):
    volume = I.stations(spark, sf).select("station", F.lit(100.0).alias("volume"))
    return D.projected_targets(_projection(spark, sf), volume, 0.5, -0.3).select("station", "throughput", "target")


ACCESS = f"{I.STATIONS}, {I.DEMAND}, s AS (SELECT station, 10.0 + id AS before, 25.0 + id * id / 20.0 AS after, w AS target FROM stations JOIN (SELECT origin AS station, sum(weight) AS w FROM demand GROUP BY origin) USING (station))"


@add("D11 F13", f"WITH {ACCESS}, f AS (SELECT *, sqrt(greatest(0.7, least(1.8, exp(0.4 * ln(after / before)))) * greatest(0.7, least(1.8, exp(0.9 * ln(after / before))))) AS factor FROM s) SELECT station, factor, target * factor * sum(target) OVER () / sum(target * factor) OVER () AS adjusted FROM f", "factor adjusted", "", 4)
def induced_demand(spark, sf):
    w = I.demand(spark, sf).groupBy(F.col("origin").alias("station")).agg(F.sum("weight").alias("target"))
    s = I.stations(spark, sf).join(w, "station").select("station", (10.0 + F.col("id")).alias("before"), (25.0 + F.col("id") * F.col("id") / 20.0).alias("after"), "target")
    return D.induced(s, 0.4, 0.9).select("station", "factor", "adjusted")


@add("D12", """WITH s AS (SELECT c_custkey AS station, c_nationkey % 2 = 0 AS exact, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE greatest(c_acctbal, 0) END AS t, c_custkey % 900 + 1.0 AS m, c_nationkey % 3 = 0 AS exact_later, greatest(c_acctbal, 0) * 1.2 + 50 AS t2, c_custkey % 800 + 2.0 AS m2 FROM customer),
  n AS (SELECT *, CASE WHEN exact THEN t WHEN t > 0 THEN sqrt(t * m) ELSE m END AS now FROM s)
  SELECT station, CASE WHEN t IS NOT NULL THEN now END AS now, CASE WHEN exact_later THEN t2 WHEN t > 0 THEN now * t2 / t ELSE sqrt(t2 * m2) END AS later FROM n""", "now later", "", 4)
def corrected_targets(spark, sf):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    bal = F.greatest("c_acctbal", F.lit(0.0))
    s = I.read(spark, sf, "customer").select(
        c.alias("station"), (n % 2 == 0).alias("exact_now"), F.when(c % 7 != 0, bal).alias("target_now"), (c % 900 + 1.0).alias("model_now"), (n % 3 == 0).alias("exact_later"), (bal * 1.2 + 50).alias("target_later"), (c % 800 + 2.0).alias("model_later")
    )
    out = D.corrected_targets(s)
    return out.select("station", F.when(F.col("target_now").isNotNull(), F.col("now")).alias("now"), "later")


@add("D12 F12 F14", f"""WITH {PAIRS}, t AS (SELECT origin AS station, sum(w) AS old FROM x GROUP BY origin), f AS (SELECT *, CASE WHEN greatest(oi % 12, di % 12) >= 8 AND km < 12 THEN 0.55 + 0.45 * pow(km / 12, 1.5) ELSE 1 END AS factor FROM x)
  SELECT origin, destination, w * factor AS seed, greatest(old * 0.3, old * (1 - least(0.7, 0.4 * 2 * (oi * 40) / old))) AS target FROM f JOIN t ON t.station = f.origin""", "seed target", "", 4)
def discounted_targets(spark, sf):
    """Seeds damped over short distances between places of many lines, and origin targets less their transfers."""
    x = D.marginals(_pairs(spark, sf), [], "w")
    damped = F.when(F.greatest(F.col("oi") % 12, F.col("di") % 12) >= 8, S.near_damping("km", 0.55, 12.0, 1.5)).otherwise(1.0)
    return x.select("origin", "destination", (F.col("w") * damped).alias("seed"), S.transfer_discount("row_sum", F.col("oi") * 40.0).alias("target"))


CLUSTERS = f"""{I.STATIONS}, {I.DEMAND}, m AS (SELECT origin, destination, sum(weight) AS trips FROM demand GROUP BY ALL), c AS (SELECT station, 'C' || id % 6 AS cluster, (lon - 6) * 76 AS x, (lat - 45.8) * 111 AS y, 1.0 / count(*) OVER (PARTITION BY id % 6) AS a, (id + 1.0) / sum(id + 1) OVER (PARTITION BY id % 6) AS b FROM stations),
  k AS (SELECT *, coalesce(o.cluster, 'station:' || origin) AS oc, coalesce(d.cluster, 'station:' || destination) AS dc FROM m LEFT JOIN (SELECT station AS origin, cluster FROM c WHERE station <> 'NATION_4') o USING (origin) LEFT JOIN (SELECT station AS destination, cluster FROM c WHERE station <> 'NATION_4') d USING (destination)),
  g AS (SELECT oc, dc, sum(trips) AS flow FROM k WHERE oc <> dc GROUP BY ALL)"""


@add("D08 A17", f"""WITH {CLUSTERS} SELECT o.station AS origin, d.station AS destination, 'between' AS method, flow * o.a * d.b AS weight FROM g JOIN c o ON g.oc = o.cluster JOIN c d ON g.dc = d.cluster
  UNION ALL SELECT k.origin, k.destination, 'within', trips * least(1, sqrt(pow(o.x - d.x, 2) + pow(o.y - d.y, 2)) / 60) FROM k JOIN c o ON o.station = k.origin JOIN c d ON d.station = k.destination WHERE oc = dc AND k.origin <> k.destination""", "weight", "", 4)
def cluster_redistribution(spark, sf):
    s = I.stations(spark, sf)
    by = Window.partitionBy("cluster")
    c = s.select("station", F.concat(F.lit("C"), (F.col("id") % 6).cast("string")).alias("cluster"), "id", ((F.col("lon") - 6) * 76).alias("x"), ((F.col("lat") - 45.8) * 111).alias("y"))
    c = c.withColumns({"out_share": 1.0 / F.count("*").over(by), "in_share": (F.col("id") + 1.0) / F.sum(F.col("id") + 1).over(by)})
    m = I.demand(spark, sf).groupBy("origin", "destination").agg(F.sum("weight").alias("trips"))
    return D.cluster_flows(m, c.where("station <> 'NATION_4'").select("station", "cluster"), c, 60.0)


@add("D14", "SELECT c_nationkey, c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS tier FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END, c_acctbal DESC, c_custkey) = 1", "", "tier")
def preferred_rows(spark, sf):
    tier = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(3)
    return D.tiered_choice(I.read(spark, sf, "customer"), ["c_nationkey"], tier, [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey", "tier")


@add("D14 D15", f"WITH {I.DEMAND}, p AS (SELECT region, year, sum(weight) AS population FROM demand GROUP BY ALL) SELECT p.region, p.year, p.population, p.population / r.population AS growth FROM p JOIN p r ON p.region = r.region AND r.year = 1996", "population growth", "year")
def regional_growth(spark, sf):
    p = I.demand(spark, sf).groupBy("region", "year").agg(F.sum("weight").alias("population"))
    return D.growth(p, "region", "year", "population", 1996)
