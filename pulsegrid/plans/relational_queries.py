"""Queries of the relational and ordered-sequence operators on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sequences as Q
from ..operators.ordering import numbered
from . import inputs as I
from .registry import add

PARTS = ["rolling", "dwell", "transfer"]
MEANS = "count(*) AS n, sum(weight) AS weight, sum(weight * rolling) / sum(weight) AS rolling, sum(weight * dwell) / sum(weight) AS dwell, sum(weight * transfer) / sum(weight) AS transfer"
SHARES = "rolling + dwell + transfer AS total, rolling / (rolling + dwell + transfer) AS rolling_share, dwell / (rolling + dwell + transfer) AS dwell_share, transfer / (rolling + dwell + transfer) AS transfer_share"


@add("A02 A03 A04 A05 J01", f"""WITH {I.PATHS} SELECT *, {SHARES} FROM (
  SELECT year, region, origin, CAST(CASE grouping_id(year, region, origin) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS level, {MEANS}
  FROM paths GROUP BY GROUPING SETS ((year), (year, region), (year, region, origin)))""",
     "weight rolling dwell transfer total rolling_share dwell_share transfer_share", "n", 4)
def weighted_component_rollup(spark, sf):
    """The flagship: weighted component means and shares at national, regional and station level."""
    return A.component_rollup(I.paths(spark, sf), [["year"], ["year", "region"], ["year", "region", "origin"]], PARTS, "weight")


@add("A02 A01 P05 P06", f"WITH {I.PATHS} SELECT *, {SHARES} FROM (SELECT origin, {MEANS} FROM paths WHERE year BETWEEN 1995 AND 1997 GROUP BY origin)",
     "weight rolling dwell transfer total rolling_share dwell_share transfer_share", "n", 4)
def component_means_by_origin(spark, sf):
    return A.component_means(I.paths(spark, sf).where(F.col("year").between(1995, 1997)), ["origin"], PARTS, "weight")


@add("A04", f"WITH {I.PATHS} SELECT region, sum(weight * (dwell / (dwell + transfer + 1))) / sum(weight) AS share FROM paths GROUP BY region", "share")
def mean_of_path_shares(spark, sf):
    p = I.paths(spark, sf).withColumn("all", F.col("dwell") + F.col("transfer") + 1)
    return A.mean_of_shares(p, ["region"], "dwell", "all", "weight")


@add("A06", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1", "", "parts suppliers")
def distinct_counts(spark, sf):
    return I.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


CHANGES = f"""WITH {I.DEMAND}, cells AS (
  SELECT b.origin, b.destination, b.weight, o.rolling / o.weight - b.rolling / b.weight AS d
  FROM demand b JOIN demand o USING (origin, destination) WHERE b.year = 1996 AND o.year = 1997)"""


def _cells(spark, sf):
    d = I.demand(spark, sf).withColumn("mean", F.col("rolling") / F.col("weight"))
    both = J.zipped(d.where("year = 1996"), d.where("year = 1997"), ["origin", "destination"], ["mean", "weight"])
    return both.select("origin", "destination", F.col("base_weight").alias("weight"), F.col("mean_change").alias("d"))


@add("A07 J02 J13", CHANGES + """ SELECT origin, count(*) FILTER (d < -1e-9) AS improved, count(*) FILTER (d > 1e-9) AS worsened, count(*) FILTER (abs(d) <= 1e-9) AS unchanged,
  sum(CASE WHEN d < -1e-9 THEN -d * weight ELSE 0 END) AS saved, sum(CASE WHEN d > 1e-9 THEN d * weight ELSE 0 END) AS lost, min(d) AS least, max(d) AS most FROM cells GROUP BY origin""",
     "saved lost least most", "improved worsened unchanged", 3)
def scenario_change_counts(spark, sf):
    return A.change_counts(_cells(spark, sf), ["origin"], "d", "weight")


@add("A22 A09", CHANGES + """ SELECT origin, count(*) FILTER (d < -1e-9) AS faster, count(*) FILTER (d > 1e-9) AS slower,
  sum(CASE WHEN d < -1e-9 THEN -d * weight ELSE 0 END) AS saved, sum(CASE WHEN d > 1e-9 THEN d * weight ELSE 0 END) AS lost,
  arg_min(destination, (d, destination)) AS best, arg_min(destination, (-d, destination)) AS worst FROM cells GROUP BY origin""", "saved lost", "faster slower", 3)
def reachability_by_origin(spark, sf):
    return A.reachability(_cells(spark, sf), "origin", "destination", "d", "weight")


@add("A08", "SELECT o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus))[1:2], '; ') AS states FROM orders GROUP BY 1")
def listed_states(spark, sf):
    return I.read(spark, sf, "orders").groupBy("o_orderpriority").agg(S.listed("o_orderstatus", 2).alias("states"))


@add("A10", """SELECT c_nationkey, max(c_acctbal) AS c_acctbal, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS c_custkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '; ') AS c_mktsegment
  FROM customer GROUP BY 1""", "c_acctbal")
def merged_duplicate_rows(spark, sf):
    c = I.read(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal", "c_mktsegment")
    return A.merged_duplicates(c, ["c_nationkey"], "c_acctbal", ["c_custkey"], "c_mktsegment").select("c_nationkey", "c_acctbal", "c_custkey", "c_mktsegment")


@add("A11 A14", "SELECT event_type, min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_pop(value) AS spread, quantile_cont(value, 0.5) AS middle FROM events GROUP BY 1", "low high mean spread middle")
def diagnostics(spark, sf):
    return I.read(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.percentile("value", 0.5).alias("middle"))


@add("A12", f"WITH {I.PATHS} SELECT region, quantile_cont(rolling, 0.05) AS p0050, quantile_cont(rolling, 0.5) AS p0500, quantile_cont(rolling, 0.95) AS p0950 FROM paths GROUP BY region", "p0050 p0500 p0950", "", 4)
def exact_percentiles(spark, sf):
    return A.exact_percentiles(I.paths(spark, sf), ["region"], "rolling", [0.05, 0.5, 0.95])


@add("A13", f"""WITH {I.PATHS}, s AS (SELECT region, rolling, sum(weight) AS w FROM paths WHERE weight > 0 GROUP BY ALL),
  c AS (SELECT *, sum(w) OVER (PARTITION BY region ORDER BY rolling ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY region) AS al FROM s)
  SELECT region, min(rolling) FILTER (cum >= 0.25 * al - 1e-9 * al) AS q0250, min(rolling) FILTER (cum >= 0.5 * al - 1e-9 * al) AS q0500, min(rolling) FILTER (cum >= 0.9 * al - 1e-9 * al) AS q0900 FROM c GROUP BY region""", "q0250 q0500 q0900")
def weighted_step_quantiles(spark, sf):
    return A.weighted_quantiles(I.paths(spark, sf), ["region"], "rolling", "weight", [0.25, 0.5, 0.9])


@add("A15 O03", """SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 5""", "l_extendedprice", "rank")
def top_rows_per_group(spark, sf):
    t = I.read(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return A.best_rows(t, ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5).drop("l_partkey", "l_suppkey")


@add("A16", CHANGES + """ SELECT CAST(CASE WHEN d < -5000 THEN -1 WHEN d >= 5000 THEN 20 ELSE floor((d + 5000) / 500) END AS INTEGER) AS bin, count(*) AS n FROM cells WHERE abs(d) > 5 GROUP BY 1""", "", "n")
def change_histogram(spark, sf):
    return A.histogram(_cells(spark, sf), [], "d", 500.0, -5000.0, 5000.0, 5.0)


@add("A17 D08", f"""WITH {I.DEMAND} SELECT region, origin, weight, CASE WHEN sum(weight) OVER w > 0 THEN weight / sum(weight) OVER w WHEN sum(rolling) OVER w > 0 THEN rolling / sum(rolling) OVER w ELSE 1.0 / count(*) OVER w END AS share,
  CASE WHEN sum(weight) OVER w > 0 THEN 'flow' WHEN sum(rolling) OVER w > 0 THEN 'service' ELSE 'equal' END AS method
  FROM (SELECT region, origin, sum(CASE WHEN region = 'ASIA' THEN 0 ELSE weight END) AS weight, sum(CASE WHEN region = 'ASIA' THEN rolling ELSE 0 END) AS rolling FROM demand GROUP BY ALL) WINDOW w AS (PARTITION BY region)""", "weight share")
def shares_with_fallback(spark, sf):
    asia = F.col("region") == "ASIA"
    d = I.demand(spark, sf).groupBy("region", "origin").agg(F.sum(F.when(asia, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum(F.when(asia, F.col("rolling")).otherwise(0.0)).alias("rolling"))
    return A.shares_within(d, "region", "weight", "rolling").drop("rolling")


@add("A18", """WITH t AS (SELECT r_name AS region, n_name AS name, count(c_custkey) AS w, 1000 AS total FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
  e AS (SELECT *, total * w / nullif(sum(w) OVER (PARTITION BY region), 0)::DOUBLE AS x FROM t), f AS (SELECT *, floor(x) AS whole FROM e),
  g AS (SELECT *, total - sum(whole) OVER (PARTITION BY region) AS rest, row_number() OVER (PARTITION BY region ORDER BY round(x - whole, 9) DESC, w DESC, name DESC) AS place FROM f)
  SELECT region, name, whole + CASE WHEN place <= rest THEN 1 ELSE 0 END AS units FROM g""", "", "units")
def apportioned_units(spark, sf):
    s = I.stations(spark, sf)
    n = s.join(I.read(spark, sf, "customer"), F.col("id") == F.col("c_nationkey"), "left").groupBy("region", F.col("station").alias("name")).agg(F.count("c_custkey").alias("w")).withColumn("total", F.lit(1000))
    return A.largest_remainder(n, "region", "total", "w", "name").select("region", "name", "units")


@add("A19 J18", f"WITH {I.DEMAND} SELECT least(origin, destination) AS a, greatest(origin, destination) AS b, sum(weight) AS load, count(DISTINCT origin || '>' || destination) AS pairs FROM demand GROUP BY 1, 2", "load", "pairs")
def undirected_edge_loads(spark, sf):
    d = I.demand(spark, sf).withColumn("od", F.concat_ws(">", "origin", "destination"))
    return A.edge_loads(d, "origin", "destination", "weight", "od")


@add("A20 D17", f"WITH {I.BOARD} SELECT line, station, sum(pax) AS load, count(DISTINCT minute % 120) * 0.5 AS per_hour FROM board WHERE kind <> 'pass' GROUP BY ALL", "load per_hour", "", 4)
def section_load_and_frequency(spark, sf):
    return A.section_frequency(I.board(spark, sf).where("kind <> 'pass'"), ["line", "station"], ["minute"], "pax")


@add("A21 P07", f"""WITH {I.BOARD}, s AS (SELECT line AS year, station AS name, coalesce(sum(pax) FILTER (kind = 'an'), 0) AS t, coalesce(sum(pax) FILTER (kind = 'ab'), 0) AS m FROM board GROUP BY ALL),
  p AS (SELECT *, t + 10 * m AS score, row_number() OVER (PARTITION BY year ORDER BY t + 10 * m DESC, name) AS place FROM s)
  SELECT *, CASE WHEN t >= 30000 THEN 'transfer' WHEN m >= 20000 THEN 'near miss' WHEN name IN (3) THEN 'manual' WHEN place <= 4 THEN 'rank' END AS reason FROM p""", "t m score", "place", 4)
def hub_selection(spark, sf):
    b = I.board(spark, sf).groupBy(F.col("line").alias("year"), F.col("station").alias("name")).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "an", F.col("pax"))), F.lit(0.0)).alias("t"), F.coalesce(F.sum(F.when(F.col("kind") == "ab", F.col("pax"))), F.lit(0.0)).alias("m"))
    return A.hub_scores(b, "year", "name", "t", "m", (30000, 20000), [3], 4)


@add("M01 M02 M03", f"""WITH {I.DEMAND}, c AS (SELECT region, sum(weight) AS y, sum(rolling) / 1500 AS x FROM demand GROUP BY region, origin)
  SELECT region, count(*) AS n, corr(x, y) AS r, avg(abs(x - y)) AS mae, sqrt(avg((x - y) * (x - y))) AS rmse, 100 * avg(abs(x - y) / y) AS mape, 100 * quantile_cont(abs(x - y) / y, 0.5) AS median_ape,
  sum(x * y) / sum(x * x) AS scale, corr(x, y) * corr(x, y) AS r2, sqrt(avg((x - y) * (x - y))) / abs(avg(y)) AS nrmse FROM c GROUP BY region""", "r mae rmse mape median_ape scale r2 nrmse", "n", 4)
def fit_statistics(spark, sf):
    d = I.demand(spark, sf).groupBy("region", "origin").agg(F.sum("weight").alias("y"), (F.sum("rolling") / 1500).alias("x"))
    return A.fit_statistics(d, ["region"], "y", "x")


@add("P11 J01", "SELECT o_orderkey, c_custkey, c_mktsegment, c_acctbal FROM orders JOIN (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer) ON o_custkey = c_custkey", "c_acctbal")
def checked_enrichment(spark, sf):
    """Every order with its customer, who has to be there, once."""
    o = I.read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return J.one_to_one(o, I.read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_custkey"], complete=True).select("o_orderkey", "c_custkey", "c_mktsegment", "c_acctbal")


@add("W03 M03", f"""WITH {I.DEMAND}, v AS (SELECT origin, destination, sum(weight) AS a, count(*) AS b FROM demand GROUP BY ALL),
  k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM v)
  SELECT count(*) AS n, corr(ra, rb) AS rho FROM k""", "rho", "n")
def spearman_average_ranks(spark, sf):
    d = I.demand(spark, sf).groupBy("origin", "destination").agg(F.sum("weight").alias("a"), F.count("*").alias("b"))
    return A.rank_correlation(d, "a", "b")


@add("W01 O01", f"""WITH {I.DEMAND}, d AS (SELECT origin, destination, sum(weight) AS weight FROM demand GROUP BY ALL),
  c AS (SELECT *, sum(weight) OVER (PARTITION BY origin ORDER BY weight DESC, destination ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER (PARTITION BY origin) AS al FROM d)
  SELECT origin, destination, weight, cum, cum / al AS cum_share FROM c WHERE cum - weight < 0.8 * al""", "weight cum cum_share")
def heaviest_pairs_to_coverage(spark, sf):
    d = I.demand(spark, sf).groupBy("origin", "destination").agg(F.sum("weight").alias("weight"))
    return Q.coverage(d, ["origin"], "weight", ["destination"], 0.8)


@add("W02 O02", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50", "c_acctbal", "place")
def ranked_top(spark, sf):
    """A global top list: the rank is given to the bounded result only."""
    top = I.read(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")))


@add("W04", f"""WITH {I.BOARD} SELECT trip, id, gap, CASE WHEN next_trip IS NULL THEN NULL WHEN next_trip = service THEN 'dwell' ELSE 'transfer' END AS gap_kind
  FROM (SELECT trip, id, service, lead(service) OVER w AS next_trip, lead(minute) OVER w - minute AS gap FROM board WINDOW w AS (PARTITION BY trip ORDER BY ts, id))""", "", "gap")
def leg_gap_kinds(spark, sf):
    return Q.leg_gaps(I.board(spark, sf), "trip", ["ts", "id"], "service", "minute", "minute").select("trip", "id", "gap", "gap_kind")


@add("W05", f"""WITH {I.BOARD}, r AS (SELECT *, sum(c) OVER (PARTITION BY trip ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce(CAST(station <> lag(station) OVER (PARTITION BY trip ORDER BY ts, id) AS INT), 0) AS c FROM board)),
  s AS (SELECT trip, run, any_value(station) AS st FROM r GROUP BY ALL), n AS (SELECT trip, run, lag(st) OVER (PARTITION BY trip ORDER BY run) AS previous, lead(st) OVER (PARTITION BY trip ORDER BY run) AS following FROM s)
  SELECT r.id, r.trip, previous, following FROM r JOIN n USING (trip, run)""")
def neighbour_stations(spark, sf):
    return Q.neighbours(I.board(spark, sf).select("id", "trip", "ts", "station"), "trip", ["ts", "id"], "station").select("id", "trip", "previous", "following")


@add("W06", f"WITH {I.BOARD} SELECT trip, id, station, next_station FROM (SELECT *, lead(station) OVER w AS next_station, lead(1) OVER w AS l FROM board WINDOW w AS (PARTITION BY trip ORDER BY ts, id)) WHERE l IS NOT NULL")
def adjacent_events(spark, sf):
    return Q.adjacent(I.board(spark, sf), ["trip"], ["ts", "id"], ["station"]).select("trip", "id", "station", "next_station")


@add("W07 W09 D13 T05", f"""WITH {I.BOARD}, d AS (SELECT station, line, id, unnest(range(300 + (minute % 120 + 60) % 120, 1440, 120)) AS u, 5 + CAST(id % 45 AS INT) AS cost FROM board WHERE kind = 'ab'),
  o AS (SELECT station, id, line, u - coalesce(lag(u) OVER (PARTITION BY station ORDER BY u, id), 300) AS own FROM d WHERE u + cost < 1440), p AS (SELECT station, id, sum(own) AS dominance, count(*) AS instances FROM o GROUP BY ALL)
  SELECT *, dominance / instances / 2 AS wait, dominance / sum(dominance) OVER (PARTITION BY station) AS share, dominance / sum(dominance) OVER (PARTITION BY station) * 1000.0 AS allocated FROM p""", "wait share allocated", "dominance instances")
def dominance_shares(spark, sf):
    """Every departure's share of its station's day, over all its repeats that arrive before midnight, and the demand it gets."""
    b = I.board(spark, sf).where("kind = 'ab'").select("station", "id", "minute", (5 + (F.col("id") % 45).cast("int")).alias("cost"))
    s = Q.dominance(Q.periodic(b, "minute", 300, 1440), ["station"], "id", "at", "cost").withColumn("demand", F.lit(1000.0))
    return Q.demand_shares(s.withColumn("wait", Q.headway_wait(F.col("dominance"), F.col("instances"))), ["station"], "dominance", "demand").drop("demand")


@add("W08", f"""WITH {I.BOARD}, c AS (SELECT station, minute % 120 + 300 AS dep, minute % 120 + 300 + 10 + CAST(id % 40 AS INT) AS arr, id AS idx FROM board WHERE kind = 'ab'),
  b AS (SELECT * FROM c UNION ALL SELECT station, dep + 120, arr + 120, idx FROM c), p AS (SELECT station, dep, min((arr, dep, idx)) AS best FROM b GROUP BY ALL)
  SELECT station, minute, best[1] AS arr, best[2] AS dep, best[3] AS idx, best[2] - minute AS wait FROM (
    SELECT s.station, m.minute, min(p.best) AS best FROM (SELECT DISTINCT station FROM c) s CROSS JOIN (SELECT unnest(range(300, 420)) AS minute) m JOIN p ON p.station = s.station AND p.dep >= m.minute GROUP BY ALL)""", "", "minute arr dep idx wait")
def best_departure_all_lines(spark, sf):
    b = I.board(spark, sf).where("kind = 'ab'")
    c = b.select("station", (F.col("minute") % 120 + 300).alias("dep"), (F.col("minute") % 120 + 310 + (F.col("id") % 40).cast("int")).alias("arr"), F.col("id").alias("idx"))
    return Q.minute_best(c, ["station"], "dep", "arr", "idx", 300, 420)


@add("R03", f"""WITH {I.BOARD}, p AS (SELECT station, minute AS dep, min(minute + 10 + CAST(id % 90 AS INT)) AS arr FROM board WHERE kind = 'ab' GROUP BY ALL)
  SELECT station, dep, arr FROM (SELECT *, min(arr) OVER (PARTITION BY station ORDER BY dep DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM p) WHERE later IS NULL OR arr < later""", "", "dep arr")
def departure_skyline(spark, sf):
    b = I.board(spark, sf).where("kind = 'ab'").select("station", F.col("minute").alias("dep"), (F.col("minute") + 10 + (F.col("id") % 90).cast("int")).alias("arr"))
    return Q.skyline(b, ["station"], "dep", "arr")


@add("W10", f"""WITH {I.BOARD}, n AS (SELECT id, trip, station, lag(line) OVER w AS previous, lead(line) OVER w AS following FROM board WINDOW w AS (PARTITION BY trip, station ORDER BY ts, id))
  SELECT * FROM (SELECT *, bool_or(previous IS NOT NULL) OVER (PARTITION BY trip, station) AS p, bool_or(following IS NOT NULL) OVER (PARTITION BY trip, station) AS f FROM n)
  WHERE NOT ((previous IS NULL AND p) OR (following IS NULL AND f))""")
def without_false_terminals(spark, sf):
    w = Window.partitionBy("trip", "station").orderBy("ts", "id")
    n = I.board(spark, sf).withColumns({"previous": F.lag("line").over(w).cast("string"), "following": F.lead("line").over(w).cast("string")})
    out = Q.without_false_ends(n, ["trip", "station"], "previous", "following").select("id", "trip", "station", F.col("previous").cast("long"), F.col("following").cast("long"))
    by = Window.partitionBy("trip", "station")
    flagged = n.withColumns({"p": F.bool_or(F.col("previous").isNotNull()).over(by), "f": F.bool_or(F.col("following").isNotNull()).over(by)}).select("id", "p", "f")
    return out.join(flagged, "id")


@add("W11", f"""WITH {I.BOARD} SELECT id, trip, sum(CASE WHEN kind = 'ab' THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS block FROM board""", "", "block")
def numbered_runs(spark, sf):
    return Q.runs(I.board(spark, sf), ["trip"], ["ts", "id"], F.col("kind") == "ab", "block").select("id", "trip", "block")


@add("W12", f"""WITH {I.BOARD} SELECT id, trip, kind FROM (SELECT *, min(id) FILTER (kind = 'ab') OVER (PARTITION BY trip) AS a, max(id) FILTER (kind = 'an') OVER (PARTITION BY trip) AS b FROM board) WHERE id BETWEEN a AND b""")
def trimmed_segments(spark, sf):
    return Q.trimmed(I.board(spark, sf), ["trip"], "id", "kind").select("id", "trip", "kind")


@add("W13 O06", f"""WITH {I.DEMAND}, y AS (SELECT origin, year, sum(weight) AS weight FROM demand GROUP BY ALL)
  SELECT * FROM (SELECT origin, year, weight, weight - lag(weight) OVER w AS weight_change, lag(year) OVER w AS since FROM y WINDOW w AS (PARTITION BY origin ORDER BY year)) WHERE since IS NOT NULL""", "weight weight_change")
def yearly_change(spark, sf):
    return Q.period_change(I.demand(spark, sf).groupBy("origin", "year").agg(F.sum("weight").alias("weight")), ["origin"], "year", ["weight"])


@add("W14", f"""WITH {I.TIMETABLE} SELECT segment, seq, station, before FROM (SELECT *, lag(station) OVER w AS before, lead(station) OVER w AS same, lead(station, 2) OVER w AS after, lag(kind) OVER w || kind || lead(kind) OVER w || lead(kind, 2) OVER w AS kinds FROM timetable WINDOW w AS (PARTITION BY segment ORDER BY seq))
  WHERE same = station AND before = after AND kinds = 'abanaban'""", "", "seq")
def turnback_events(spark, sf):
    return Q.turnbacks(I.timetable(spark, sf), "segment", ["seq"], "station", "kind").select("segment", "seq", "station", "before")


@add("T05", f"WITH {I.BOARD} SELECT id, unnest(range(300 + (minute % 120 - 300 % 120 + 120) % 120, 1440, 120)) AS t FROM board WHERE kind = 'ab'", "", "t")
def periodic_projection(spark, sf):
    b = I.board(spark, sf).where("kind = 'ab'").select("id", (F.col("minute") % 120).alias("m"))
    return Q.periodic(b, "m", 300, 1440).select("id", F.col("at").alias("t"))


@add("J03 D15", f"""WITH {I.DEMAND}, y AS (SELECT origin, year, sum(weight) AS v FROM demand WHERE origin < 'NATION_2' OR year = 1996 GROUP BY ALL), y2 AS (SELECT * FROM y WHERE origin <> 'NATION_3')
  SELECT d.origin, d.year, coalesce(o.v, r.v, d.n * 1.5) AS v, CASE WHEN o.v IS NOT NULL THEN 'own' WHEN r.v IS NOT NULL THEN 'reference' ELSE 'fallback' END AS source
  FROM (SELECT origin, year, count(*) AS n FROM demand GROUP BY ALL) d LEFT JOIN y2 o USING (origin, year) LEFT JOIN (SELECT origin, v FROM y2 WHERE year = 1996) r USING (origin)""", "v")
def tiered_population_lookup(spark, sf):
    d = I.demand(spark, sf)
    y = d.where("origin < 'NATION_2' OR year = 1996").where("origin <> 'NATION_3'").groupBy("origin", "year").agg(F.sum("weight").alias("v"))
    n = d.groupBy("origin", "year").agg(F.count("*").alias("n"))
    return J.tiered_lookup(n, y, "origin", "year", 1996, "v", F.col("n") * 1.5).drop("n")


@add("J04", f"""WITH {I.BOARD}, c AS (SELECT id AS candidate, station AS from_station, minute % 120 AS from_mod, (station + 1) % 11 AS to_station, (minute + 7) % 120 AS to_mod FROM board WHERE kind = 'pass'),
  e AS (SELECT trip AS effect, station, minute % 120 AS mod, kind AS side, sum(pax) AS pax FROM board WHERE kind IN ('an', 'ab') GROUP BY ALL),
  p AS (SELECT candidate, from_station AS station, from_mod AS mod, 'ab' AS side, 0 AS probe FROM c UNION ALL SELECT candidate, to_station, to_mod, 'an', 1 FROM c)
  SELECT candidate, effect, station, mod, side, pax FROM (SELECT *, row_number() OVER (PARTITION BY candidate, effect ORDER BY probe DESC) AS k FROM p JOIN e USING (station, mod, side)) WHERE k = 1""", "pax", "mod")
def clockface_effect_probes(spark, sf):
    b = I.board(spark, sf)
    c = b.where("kind = 'pass'").select(F.col("id").alias("candidate"), F.col("station").alias("from_station"), (F.col("minute") % 120).alias("from_mod"), ((F.col("station") + 1) % 11).alias("to_station"), ((F.col("minute") + 7) % 120).alias("to_mod"))
    e = b.where("kind <> 'pass'").groupBy(F.col("trip").alias("effect"), "station", (F.col("minute") % 120).alias("mod"), F.col("kind").alias("side")).agg(F.sum("pax").alias("pax"))
    return J.clockface_probes(c, e, ["station", "mod"], "effect", "candidate").select("candidate", "effect", "station", "mod", "side", "pax")


@add("J06", f"""WITH {I.BOARD} SELECT a.id AS arrival, d.id AS departure, d.minute - a.minute AS gap FROM board a JOIN board d ON a.station = d.station AND a.line <> d.line AND a.kind = 'an' AND d.kind = 'ab'
  AND d.minute - a.minute BETWEEN -5 AND 3 + a.station % 4 + 10""", "", "gap")
def near_miss_all_trips(spark, sf):
    """Near misses of all trips of a station."""
    b = I.board(spark, sf)
    a = b.where("kind = 'an'").select("station", F.col("line").alias("a_line"), F.col("id").alias("arrival"), F.col("minute").alias("arr"), (3 + F.col("station") % 4).alias("least"))
    d = b.where("kind = 'ab'").select("station", F.col("line").alias("d_line"), F.col("id").alias("departure"), F.col("minute").alias("dep"))
    return J.band(a, d, ["station"], 5, 10, "least").where("a_line <> d_line").select("arrival", "departure", "gap")


@add("J07", f"""WITH {I.BOARD}, a AS (SELECT id, station, line, minute + 4 AS t FROM board WHERE kind = 'an'), d AS (SELECT station, line AS of, minute AS dep, id AS dep_id FROM board WHERE kind = 'ab'), l AS (SELECT DISTINCT line FROM board),
  n AS (SELECT l.line, station, dep, min((dep_id, of)) AS first FROM d JOIN l ON d.of <> l.line GROUP BY ALL)
  SELECT a.id, a.station, n.dep, n.first[1] AS dep_id, n.first[2] AS dep_line FROM a ASOF LEFT JOIN n ON a.station = n.station AND a.line = n.line AND a.t <= n.dep""", "", "dep")
def first_departure_after(spark, sf):
    """Each arrival's first departure of another line, four minutes later or more."""
    b = I.board(spark, sf)
    a = b.where("kind = 'an'").select("id", "station", "line", "minute").withColumn("slack", F.lit(4))
    d = b.where("kind = 'ab'").select("station", F.col("minute").alias("dep"), F.col("id").alias("dep_id"), "line")
    return J.as_of(a, d, ["station"], "minute", "dep", "slack", ["dep_id"], "line").select("id", "station", "next.dep", "next.dep_id", F.col("next.line").alias("dep_line"))


@add("J08 F06 J12 R13", f"""WITH {I.STATIONS}, {I.DEMAND}, s AS (SELECT origin, destination, sum(weight) AS weight FROM demand WHERE year = 1995 GROUP BY ALL)
  SELECT o.station AS o_station, d.station AS d_station, coalesce(s.weight, 0) AS weight,
   2 * 6371.0 * atan2(sqrt(pow(sin(radians(d.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lon - o.lon) / 2), 2)),
     sqrt(1 - (pow(sin(radians(d.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lon - o.lon) / 2), 2)))) AS km
  FROM stations o JOIN stations d ON o.station <> d.station LEFT JOIN s ON s.origin = o.station AND s.destination = d.station""", "km weight")
def pair_grid_with_distance(spark, sf):
    pairs = J.ordered_pairs(I.stations(spark, sf).select("station", "lat", "lon"), "station")
    d = I.demand(spark, sf).where("year = 1995").groupBy(F.col("origin").alias("o_station"), F.col("destination").alias("d_station")).agg(F.sum("weight").alias("weight"))
    return J.aligned(pairs, d, ["o_station", "d_station"], "weight", 0.0).select("o_station", "d_station", "weight", S.haversine("o_lat", "o_lon", "d_lat", "d_lon").alias("km"))


@add("J11 D01", f"""WITH {I.STATIONS}, k AS (SELECT z.id AS zone, s.station, z.region = s.region AS own, 2 * 6371.0 * asin(sqrt(pow(sin(radians(s.lat - z.lat - 0.03) / 2), 2) + cos(radians(z.lat + 0.03)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - z.lon - 0.05) / 2), 2))) AS km FROM stations z CROSS JOIN stations s),
  n AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY round(km, 9), station) AS rank FROM k), w AS (SELECT *, CASE WHEN own THEN 1.75 ELSE 1 END / pow(km + 3, 2) AS w FROM n WHERE rank <= 4 OR (own AND rank <= 6))
  SELECT zone, station, km, w / sum(w) OVER (PARTITION BY zone) AS share FROM w""", "km share")
def zone_allocation(spark, sf):
    """Zones to stations: the nearest ones and near ones of the own region, by a decay with a bonus at home."""
    z = I.stations(spark, sf).select(F.col("id").alias("zone"), F.col("region").alias("z_region"), (F.col("lat") + 0.03).alias("z_lat"), (F.col("lon") + 0.05).alias("z_lon"))
    own = (F.col("z_region") == F.col("region")) & (F.col("rank") <= 6)
    near = J.nearest(z, I.stations(spark, sf), F.round(S.haversine("z_lat", "z_lon", "lat", "lon"), 9), "zone", "station", 6, ["z_lon", "z_lat"], ["lon", "lat"], J.degrees_beyond(60))
    w = near.where((F.col("rank") <= 4) | own).withColumn("w", F.when(F.col("z_region") == F.col("region"), 1.75).otherwise(1.0) * S.power_decay("km", 3, 2))
    return w.select("zone", "station", "km", (F.col("w") / F.sum("w").over(Window.partitionBy("zone"))).alias("share"))


@add("J14", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey IN (SELECT o_custkey FROM orders)")
def semi_and_anti_membership(spark, sf):
    o = I.read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    c = I.read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti").join(o, "c_custkey", "left_semi")


@add("J15 U03", f"""WITH {I.DEMAND} SELECT origin, destination, coalesce(a.w, 0) AS base, coalesce(b.w, 0) AS other, coalesce(b.w, 0) - coalesce(a.w, 0) AS change
  FROM (SELECT origin, destination, sum(weight) AS w FROM demand WHERE year = 1996 GROUP BY ALL) a FULL JOIN (SELECT origin, destination, sum(weight) AS w FROM demand WHERE year = 1997 GROUP BY ALL) b USING (origin, destination)""", "base other change")
def outer_key_union(spark, sf):
    d = I.demand(spark, sf).groupBy("year", "origin", "destination").agg(F.sum("weight").alias("w"))
    return J.outer_changes(d.where("year = 1996"), d.where("year = 1997"), ["origin", "destination"], "w")


@add("J16", f"""WITH {I.BOARD}, s AS (SELECT trip, station, row_number() OVER (PARTITION BY trip ORDER BY ts, id) AS seq FROM board), m AS (SELECT trip, seq, station AS from_station, lead(station) OVER (PARTITION BY trip ORDER BY seq) AS to_station FROM s),
  l AS (SELECT trip, min(seq) + 1 AS first, max(seq) - 1 AS last FROM s GROUP BY trip) SELECT trip, seq, from_station, to_station FROM l JOIN m USING (trip) WHERE to_station IS NOT NULL AND seq >= first AND seq < last""", "", "seq")
def leg_movement_expansion(spark, sf):
    s = I.board(spark, sf).select("trip", "station", F.row_number().over(Window.partitionBy("trip").orderBy("ts", "id")).alias("seq"))
    legs = s.groupBy("trip").agg((F.min("seq") + 1).alias("first"), (F.max("seq") - 1).alias("last"))
    return J.leg_movements(legs, s, "trip", "first", "last", "seq", "station").select("trip", "seq", "from_station", "to_station")


@add("J17", f"""WITH {I.DEMAND}, f AS (SELECT origin AS o_zone, destination AS d_zone, sum(weight) AS trips FROM demand GROUP BY ALL),
  a AS (SELECT n_name AS zone, r_name AS place, 0.75 AS share FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, r_name, 0.25 FROM nation JOIN region ON (n_regionkey + 1) % 5 = r_regionkey)
  SELECT o.place AS origin, d.place AS destination, sum(trips * o.share * d.share) AS trips, o.place = d.place AS internal FROM f JOIN a o ON o.zone = o_zone JOIN a d ON d.zone = d_zone GROUP BY ALL""", "trips")
def zone_flows_to_places(spark, sf):
    f = I.demand(spark, sf).groupBy(F.col("origin").alias("o_zone"), F.col("destination").alias("d_zone")).agg(F.sum("weight").alias("trips"))
    n, r = I.read(spark, sf, "nation"), I.read(spark, sf, "region")
    part = lambda k, share: n.join(r, (F.col("n_regionkey") + k) % 5 == F.col("r_regionkey")).select(F.col("n_name").alias("zone"), F.col("r_name").alias("place"), F.lit(share).alias("share"))
    return J.spread_flows(f, part(0, 0.75).unionByName(part(1, 0.25)), "zone", "place", "share")


@add("O04 S10", f"WITH {I.BOARD} SELECT trip, id, station FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY ts, id) AS k FROM board) WHERE k = 1")
def first_event_of_trip(spark, sf):
    return J.first_of(I.board(spark, sf), ["trip"], ["ts", "id"]).select("trip", "id", "station")


@add("O05", f"WITH {I.BOARD}, p AS (SELECT trip, station, min(k) AS k FROM (SELECT trip, station, row_number() OVER (PARTITION BY trip ORDER BY ts, id) AS k FROM board) GROUP BY ALL) SELECT trip, array_to_string(list(CAST(station AS VARCHAR) ORDER BY k), '>') AS stations FROM p GROUP BY trip")
def stations_in_order(spark, sf):
    k = I.board(spark, sf).select("trip", "station", F.row_number().over(Window.partitionBy("trip").orderBy("ts", "id")).alias("k"))
    one = k.groupBy("trip", "station").agg(F.min("k").alias("k"))
    return one.groupBy("trip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "station"))), lambda s: s["station"].cast("string")), ">").alias("stations"))


@add("O07", "SELECT n_name, CASE n_name WHEN 'NATION_7' THEN 0 WHEN 'NATION_3' THEN 1 END AS anchor, row_number() OVER (ORDER BY CASE n_name WHEN 'NATION_7' THEN 0 WHEN 'NATION_3' THEN 1 ELSE 2 END, coalesce(c, 0) DESC, n_name) AS place FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey", "", "anchor place")
def anchors_then_size(spark, sf):
    n = I.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = I.read(spark, sf, "nation").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("anchor", F.when(F.col("n_name") == "NATION_7", 0).when(F.col("n_name") == "NATION_3", 1))
    return numbered(s, [], [F.coalesce("anchor", F.lit(2)), F.coalesce("c", F.lit(0)).desc(), "n_name"], "place").select("n_name", "anchor", "place")


@add("U01 U02", f"WITH {I.DEMAND} SELECT origin, destination, year, weight, NULL AS note FROM demand WHERE year NOT IN (1996) UNION ALL SELECT origin, destination, year, weight * 2, 'new' FROM demand WHERE year = 1996", "weight")
def refreshed_partition(spark, sf):
    d = I.demand(spark, sf).select("origin", "destination", "year", "weight")
    new = d.where("year = 1996").withColumns({"weight": F.col("weight") * 2, "note": F.lit("new")})
    return J.replaced(d, new, ["year"])


@add("U03", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_keys(spark, sf):
    return I.read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(I.read(spark, sf, "supplier").select("s_nationkey"))


@add("X01 X02 K03 S04", f"WITH {I.DEMAND} SELECT origin, sum(weight) FILTER (region = 'ASIA' AND year = 1995) AS y1995, sum(weight) FILTER (region = 'ASIA' AND year = 1996) AS y1996 FROM demand WHERE region = 'ASIA' GROUP BY origin", "y1995 y1996")
def years_as_columns(spark, sf):
    d = I.demand(spark, sf).where("region = 'ASIA'").groupBy("origin", F.concat(F.lit("y"), F.col("year")).alias("y")).agg(F.sum("weight").alias("w"))
    return J.wide_matrix(d, "origin", "y", "w", ["y1995", "y1996"])


@add("X02", "SELECT c_nationkey AS origin, name AS destination, value FROM (UNPIVOT (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS customers, sum(c_acctbal) AS balance FROM customer GROUP BY 1) ON customers, balance INTO NAME name VALUE value)", "value", "", 4)
def columns_as_rows(spark, sf):
    w = I.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("customers"), F.sum("c_acctbal").alias("balance"))
    return J.long_matrix(w, "c_nationkey")


@add("P11 J01", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", "", "n")
def repeated_key_check(spark, sf):
    return J.repeated_keys(I.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@add("D16", f"WITH {I.DEMAND} SELECT station, sum(w) AS throughput FROM (SELECT origin AS station, weight AS w FROM demand UNION ALL SELECT destination, weight FROM demand) GROUP BY 1", "throughput")
def station_throughput(spark, sf):
    """Row sums and column sums in one aggregation: each pair is one row for either end."""
    d = I.demand(spark, sf).select(F.explode(F.array("origin", "destination")).alias("station"), "weight")
    return d.groupBy("station").agg(F.sum("weight").alias("throughput"))
