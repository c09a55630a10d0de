"""Queries of the network operators: expansion, routing, demand, selection, surfaces, incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins as J
from ..operators import loads as L
from ..operators import path_scores as X
from ..operators import profiles as P
from ..operators import routing as R
from ..operators import selection as Z
from ..operators import spatial as G
from ..operators import timetable as T
from ..operators.ordering import kept, numbered
from ..sources import readers
from ..streaming import incremental
from . import inputs as I
from .registry import add

@add("T06", f"""WITH {I.BOARD}, s AS (SELECT trip, id, minute AS arr, minute + id % 6 AS dep FROM board)
  SELECT trip, id, CASE WHEN lag(1) OVER w IS NOT NULL THEN dep - arr END AS earlier, CASE WHEN lead(1, 2) OVER w IS NOT NULL THEN lead(dep) OVER w - lead(arr) OVER w END AS later FROM s WINDOW w AS (PARTITION BY trip ORDER BY id) QUALIFY lead(1) OVER w IS NOT NULL""", "", "earlier later")
def section_slack(spark, sf):
    s = I.board(spark, sf).select("trip", "id", F.col("minute").alias("arr"), (F.col("minute") + F.col("id") % 6).alias("dep"))
    return T.slack(s, "trip", ["id"]).select("trip", "id", "earlier", "later")


@add("X03 Z01", f"""WITH {I.BOARD}, s AS (SELECT trip, id, minute AS arr, minute + id % 6 AS dep FROM board),
  k AS (SELECT trip, id, CASE WHEN lag(1) OVER w IS NOT NULL THEN dep - arr END AS earlier, CASE WHEN lead(1, 2) OVER w IS NOT NULL THEN lead(dep) OVER w - lead(arr) OVER w END AS later FROM s WINDOW w AS (PARTITION BY trip ORDER BY id) QUALIFY lead(1) OVER w IS NOT NULL)
  SELECT trip, id, delta FROM k CROSS JOIN (SELECT unnest(range(-10, 11)) AS delta) WHERE delta <> 0 AND delta BETWEEN -greatest(0, coalesce(earlier, 10)) AND greatest(0, coalesce(later, 10))""", "", "delta")
def shift_candidates(spark, sf):
    """Every shift of up to ten minutes that the slack of a section allows."""
    return Z.shift_grid(section_slack(spark, sf)).select("trip", "id", "delta")


def _connections(spark, sf):
    """Every move of the board from a station to another, ``seq`` numbering those of a trip."""
    by = Window.partitionBy("trip").orderBy("minute", "id")
    b = I.board(spark, sf)
    nxt = b.withColumns({"to_station": F.lead("station").over(by), "arr": F.lead("minute").over(by), "seq": F.row_number().over(by)})
    return nxt.where("to_station <> station").select("trip", "seq", F.col("station").alias("from_station"), "to_station", F.col("minute").alias("dep"), "arr")


def _stations(spark, sf):
    return I.board(spark, sf).select(F.col("station").cast("string").alias("station")).distinct()


def _routes(spark, sf):
    s = _stations(spark, sf)
    asked = s.select(F.col("station").alias("origin"), F.explode(F.array(*[F.lit(m) for m in (360, 420, 480)])).alias("ready"))
    return R.one_to_all(_connections(spark, sf), asked, s.withColumn("minutes", F.lit(4))), s


#: Least arrivals by rides: a ride is a trip from one stop to a later one, ``quick`` the first arrival of a ride that departs at a minute or later.
#: ``ea`` has the least arrival at each place by a departure at minute t or later; a recursion over changes keeps the least arrival at each station.
#: Stations 8, 9 and 10 are one place: 7 minutes across it, 4 within station 10; elsewhere a change takes 4.
EARLIEST = """RECURSIVE {board}, moves AS MATERIALIZED (
    SELECT trip, row_number() OVER w AS seq, station AS a, lead(station) OVER w AS b, minute AS dep, lead(minute) OVER w AS arr FROM board WINDOW w AS (PARTITION BY trip ORDER BY minute, id)),
  place AS MATERIALIZED (SELECT DISTINCT station AS s, CASE WHEN station IN (8, 9, 10) THEN 'complex' ELSE CAST(station AS VARCHAR) END AS p FROM board),
  edges AS MATERIALIZED (SELECT x.s AS a, y.s AS b, CASE WHEN x.p <> 'complex' THEN 4 WHEN x.s = 10 AND y.s = 10 THEN 4 ELSE 7 END AS m FROM place x JOIN place y USING (p)),
  rides AS MATERIALIZED (SELECT x.a, y.b, x.dep, min(y.arr) AS arr FROM moves x JOIN moves y ON x.trip = y.trip AND y.seq >= x.seq WHERE x.a <> x.b AND y.a <> y.b AND x.a <> y.b AND x.dep >= 300 GROUP BY ALL),
  minutes AS (SELECT a, b, unnest(range(300, 1441)) AS t FROM (SELECT DISTINCT a, b FROM rides)),
  quick AS MATERIALIZED (SELECT m.a, m.b, m.t, min(r.arr) OVER (PARTITION BY m.a, m.b ORDER BY m.t DESC) AS arr FROM minutes m LEFT JOIN rides r ON r.a = m.a AND r.b = m.b AND r.dep = m.t),
  reach(o, t, s, arr) USING KEY (o, t, s) AS (
    SELECT p, t, b, min(arr) FROM quick JOIN place ON a = place.s WHERE t BETWEEN 300 AND {last} AND arr IS NOT NULL GROUP BY ALL
    UNION
    SELECT r.o, r.t, q.b, min(q.arr) FROM reach r JOIN edges e ON e.a = r.s JOIN quick q ON q.a = e.b AND q.t = r.arr + e.m LEFT JOIN recurring.reach x ON x.o = r.o AND x.t = r.t AND x.s = q.b
    WHERE q.arr IS NOT NULL AND (x.arr IS NULL OR q.arr < x.arr) GROUP BY ALL),
  ea AS (SELECT o AS origin, p AS destination, t, min(arr) AS arr FROM reach JOIN place USING (s) WHERE o <> p GROUP BY ALL),
  profile AS MATERIALIZED (SELECT x.origin, x.destination, CAST(x.t AS INT) AS dep, CAST(x.arr AS INT) AS arr FROM ea x LEFT JOIN ea y ON y.origin = x.origin AND y.destination = x.destination AND y.t = x.t + 1 WHERE x.t < {last} AND (y.arr IS NULL OR x.arr < y.arr))"""


@add("R01 R04 R06 R07")
def earliest_routes(spark, sf):
    routes, _ = _routes(spark, sf)
    return routes.select("origin", "ready", "destination", "arrival", "departure", "transfers", "movements", F.size("legs").alias("legs"))


#: The same recursion with 4 minutes for every change and stations for places.
STATIONS = EARLIEST.replace("CASE WHEN station IN (8, 9, 10) THEN 'complex' ELSE CAST(station AS VARCHAR) END AS p", "CAST(station AS VARCHAR) AS p")
READY = "asked AS (SELECT unnest([360, 420, 480]) AS ready)"


@add("R01 R06", f"""WITH {STATIONS.format(board=I.BOARD, last=1440)}, {READY}, first AS (SELECT origin, destination, ready, min(arr) AS arrival FROM profile JOIN asked ON dep >= ready GROUP BY ALL)
  SELECT origin, ready, destination, arrival, max(dep) AS departure FROM first JOIN profile USING (origin, destination) WHERE dep >= ready AND arr = arrival GROUP BY ALL""", "", "ready arrival departure")
def earliest_arrivals(spark, sf):
    """The first arrival at every station after each ready time, and the latest departure for it."""
    return _routes(spark, sf)[0].select("origin", "ready", "destination", "arrival", "departure")


@add("R02 R13", f"""WITH {STATIONS.format(board=I.BOARD, last=1440)}, {READY}, first AS (SELECT origin, destination, ready, min(arr) - ready AS took FROM profile JOIN asked ON dep >= ready GROUP BY origin, destination, ready),
  per AS (SELECT origin, destination, sum(took) AS total, max(took) AS worst, count(*) AS n FROM first GROUP BY origin, destination)
  SELECT o.p AS origin, d.p AS destination, coalesce(n, 0) AS reachable, 3 - coalesce(n, 0) AS missing, CASE WHEN o.p = d.p THEN 0 ELSE (coalesce(total, 0) + (3 - coalesce(n, 0)) * greatest(1.5 * coalesce(worst, 0), 960)) / 3 END AS minutes
  FROM place o CROSS JOIN place d LEFT JOIN per ON per.origin = o.p AND per.destination = d.p""", "minutes", "reachable missing")
def skim_minutes(spark, sf):
    """``ready_time_skim`` without its mean number of changes, which no SQL gives."""
    return ready_time_skim(spark, sf).select("origin", "destination", "reachable", "missing", "minutes")


@add("R02 R13")
def ready_time_skim(spark, sf):
    routes, s = _routes(spark, sf)
    pairs = s.select(F.col("station").alias("origin")).crossJoin(s.select(F.col("station").alias("destination")))
    return R.skim(routes, pairs, 3)


def _places(spark, sf):
    s = _stations(spark, sf)
    return s.withColumn("place", F.when(F.col("station").isin("8", "9", "10"), "complex").otherwise(F.col("station")))


def _profile(spark, sf, end):
    s = _places(spark, sf)
    within = F.when((F.col("from_station") == "10") & (F.col("to_station") == "10"), 4).otherwise(7)
    return P.profiles(_connections(spark, sf), s, P.complex_transfers(s, F.lit(4), within), 300, end)


@add("R03 R04 R05", f"WITH {EARLIEST.format(board=I.BOARD, last=420)} SELECT * FROM profile", "", "dep arr")
def departure_profiles(spark, sf):
    """The departures of each pair from 05:00 to 07:00 that no later one reaches as early."""
    return _profile(spark, sf, 420).select("origin", "destination", "dep", "arr")


def _metrics(spark, sf):
    found = P.service_metrics(P.with_times(_profile(spark, sf, 420)), ["origin", "destination"])
    return P.all_pairs(found, _places(spark, sf).select("place").distinct())


@add("R09 R13 W08 W09", f"""WITH {EARLIEST.format(board=I.BOARD, last=420)},
  options AS (SELECT origin, destination, dep + k AS dep, arr + k AS arr FROM profile CROSS JOIN (VALUES (0), (120)) AS v(k)),
  best AS (SELECT origin, destination, m, min((arr, dep)) AS x FROM options JOIN (SELECT unnest(range(300, 420)) AS m) ON dep >= m GROUP BY ALL),
  means AS (SELECT origin, destination, sum(x[2] - m) / 120 AS wait, sum(x[1] - x[2]) / 120 AS minutes FROM best GROUP BY ALL),
  per AS (SELECT origin, destination, sum((SELECT count(*) FROM range(0, 20) AS k(k) WHERE dep + 120 * k < 1440 AND dep + 120 * k + arr - dep <= 1440)) AS frequency, min(arr - dep) AS fastest FROM profile GROUP BY ALL),
  names AS (SELECT DISTINCT p FROM place)
  SELECT o.p AS origin, d.p AS destination, CASE WHEN o.p = d.p THEN 0 ELSE coalesce(frequency, 0) END AS frequency, CASE WHEN o.p = d.p THEN 0 ELSE fastest END AS fastest, CASE WHEN o.p = d.p THEN 0 ELSE wait END AS wait, CASE WHEN o.p = d.p THEN 0 ELSE minutes END AS minutes
  FROM names o CROSS JOIN names d LEFT JOIN per ON per.origin = o.p AND per.destination = d.p LEFT JOIN means ON means.origin = o.p AND means.destination = d.p""", "frequency fastest wait minutes")
def od_service_metrics(spark, sf):
    """Frequency, fastest time, mean wait and mean minutes on the way of every pair."""
    return _metrics(spark, sf).select("origin", "destination", "frequency", "fastest", "wait", (F.col("rolling") + F.col("dwell") + F.col("transfer")).alias("minutes"))


@add("R08 R09", None, "rolling dwell transfer")
def od_time_components(spark, sf):
    """The mean rolling, dwell and transfer minutes of every pair."""
    return _metrics(spark, sf).select("origin", "destination", "rolling", "dwell", "transfer")


@add("R11", f"""WITH {EARLIEST.format(board=I.BOARD, last=1440)}
  SELECT origin, destination, dep, arr FROM profile QUALIFY row_number() OVER (PARTITION BY origin, destination ORDER BY arr - dep, dep) = 1""", "", "dep arr")
def best_route_of_day(spark, sf):
    """The shortest route of each pair on the whole day."""
    return P.best_of_day(_profile(spark, sf, 1440), ["origin", "destination"]).select("origin", "destination", "dep", "arr")


LEGS = f"{I.BOARD}, l AS (SELECT trip AS path, id, service AS trip, minute AS dep, minute + id % 4 AS arr FROM board), g AS (SELECT *, lead(dep) OVER w - arr AS gap, lead(trip) OVER w = trip AS same FROM l WINDOW w AS (PARTITION BY path ORDER BY dep, id))"


def _legs(spark, sf):
    b = I.board(spark, sf).select(F.col("trip").alias("path"), "minute", "id", F.struct(F.col("station").cast("string").alias("from_station"), F.lit("").alias("to_station"), F.col("minute").alias("dep"), (F.col("minute") + F.col("id") % 4).cast("int").alias("arr"), F.col("service").alias("trip")).alias("leg"))
    legs = b.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("minute", "id", "leg"))), lambda x: x["leg"]).alias("legs"))
    return legs


@add("R08 F16", f"""WITH {LEGS}, s AS (SELECT path, sum(arr - dep)::DOUBLE AS r, coalesce(sum(gap) FILTER (same), 0)::DOUBLE AS d, coalesce(sum(gap) FILTER (NOT same), 0)::DOUBLE AS t, count(*) FILTER (arr = dep) AS z, count(*) FILTER (same AND gap = 0) AS k FROM (SELECT * REPLACE (greatest(gap, 0) AS gap) FROM g) GROUP BY path)
  SELECT path, CASE WHEN r + d = 0 THEN z / 3.0 ELSE r + z / 3.0 - (k + z) / 3.0 * r / (r + d) END AS rolling, CASE WHEN r + d = 0 THEN k / 3.0 ELSE d + k / 3.0 - (k + z) / 3.0 * d / (r + d) END AS dwell, CASE WHEN r + d = 0 THEN greatest(0, t - (k + z) / 3.0) ELSE t END AS transfer, r - k / 3.0 AS plain_rolling, d + k / 3.0 AS plain_dwell FROM s""", "rolling dwell transfer plain_rolling plain_dwell")
def leg_time_components(spark, sf):
    legs = _legs(spark, sf).withColumns({"a": R.leg_times(F.col("legs")), "b": R.leg_times(F.col("legs"), rebalance=False)})
    return legs.select("path", "a.rolling", "a.dwell", "a.transfer", F.col("b.rolling").alias("plain_rolling"), F.col("b.dwell").alias("plain_dwell"))


@add("R14", f"WITH {I.BOARD}, p AS (SELECT trip, list('S' || station ORDER BY minute, id) AS s FROM board GROUP BY trip) SELECT trip, array_to_string(list_transform(s, lambda x, i: CASE WHEN (i = 1 OR i = len(s)) AND starts_with(x, 'S1') THEN 'S1*' ELSE x END), '>') AS nodes FROM p")
def terminal_aliases(spark, sf):
    p = I.board(spark, sf).groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("minute", "id", "station"))), lambda x: F.concat(F.lit("S"), x["station"].cast("string"))).alias("s"))
    return p.select("trip", F.array_join(R.terminal_aliases(F.col("s"), "S1", "S1*"), ">").alias("nodes"))


@add("R10 J18", f"""WITH RECURSIVE {I.DEMAND}, e AS (SELECT origin AS a, destination AS b FROM (SELECT origin, destination, sum(weight) AS w FROM demand GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY origin ORDER BY w DESC, destination) = 1),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, r) AS (SELECT n_name, n_name FROM nation UNION SELECT u.b, reach.r FROM reach JOIN u ON u.a = reach.node) SELECT node, min(r) AS component FROM reach GROUP BY node""")
def station_components(spark, sf):
    d = I.demand(spark, sf).groupBy("origin", "destination").agg(F.sum("weight").alias("w"))
    e = J.first_of(d, ["origin"], [F.desc("w"), "destination"]).select(F.col("origin").alias("a"), F.col("destination").alias("b"))
    return R.components(e, I.read(spark, sf, "nation").select(F.col("n_name").alias("node")))


#: Effects of moved events: every event of the board is a transfer or, every third, a near miss, between an arrival and a departure event that it shares with a few others.
EFFECTS = f"""{I.BOARD}, f AS (SELECT id AS effect, trip, CASE WHEN id % 3 = 0 THEN 'near' ELSE 'existing' END AS source, CASE WHEN id % 2 = 0 THEN 'departure' ELSE 'arrival' END AS side, 'a' || (id // 3) AS arr_key, 'd' || (id // 5) AS dep_key,
    CASE WHEN id % 3 = 0 THEN minute % 9 - 6 ELSE 3 + station % 4 + minute % 25 END AS wait, 3 + station % 4 AS least, CAST(id % 13 AS INT) - 6 AS delta, pax FROM board)"""
#: A candidate for every departure event: it moves that event and one arrival event by some minutes.
PROBES = """probes AS (SELECT c AS candidate, unnest(['d' || c, 'a' || (c * 2 + 1)]) AS key, c % 9 - 4 AS delta FROM (SELECT DISTINCT id // 5 AS c FROM board))"""


def _effects(spark, sf):
    n, text = F.col("id"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return I.board(spark, sf).select(
        n.alias("effect"), "trip", F.when(n % 3 == 0, "near").otherwise("existing").alias("source"), F.when(n % 2 == 0, "departure").otherwise("arrival").alias("side"), text("a", F.floor(n / 3)).alias("arr_key"), text("d", F.floor(n / 5)).alias("dep_key"),
        F.when(n % 3 == 0, F.col("minute") % 9 - 6).otherwise(3 + F.col("station") % 4 + F.col("minute") % 25).alias("wait"), (3 + F.col("station") % 4).alias("least"), ((n % 13).cast("int") - 6).alias("delta"), "pax",
    )


def _probes(spark, sf):
    c = I.board(spark, sf).select(F.floor(F.col("id") / 5).cast("long").alias("candidate")).distinct()
    keys = F.array(F.concat(F.lit("d"), F.col("candidate").cast("string")), F.concat(F.lit("a"), (F.col("candidate") * 2 + 1).cast("string")))
    return c.select("candidate", F.explode(keys).alias("key"), (F.col("candidate") % 9 - 4).cast("int").alias("delta"))


@add("Z02 A07", f"""WITH {EFFECTS}, n AS (SELECT *, wait + CASE side WHEN 'departure' THEN delta ELSE -delta END AS neu FROM f), s AS (SELECT *, greatest(0, least - wait) - greatest(0, least - neu) AS closed FROM n),
  g AS (SELECT *, CASE WHEN source = 'near' THEN CASE WHEN closed <= 0 THEN 'unhelped' WHEN neu >= least THEN 'unlocked' ELSE 'partly' END WHEN neu < least THEN 'broken' WHEN neu < wait THEN 'improved' WHEN neu > wait THEN 'worsened' END AS kind,
    pax * CASE WHEN source = 'near' THEN greatest(0, closed) WHEN neu < least THEN -greatest(0, wait - neu) ELSE wait - neu END AS gain FROM s)
  SELECT trip AS candidate, count(*) FILTER (kind = 'improved') AS improved, count(*) FILTER (kind = 'worsened') AS worsened, count(*) FILTER (kind = 'broken') AS broken, count(*) FILTER (kind = 'unlocked') AS unlocked, count(*) FILTER (kind = 'partly') AS partly,
    sum(gain) AS net, sum(greatest(gain, 0)) AS won, sum(least(gain, 0)) AS lost, sum(CASE WHEN kind = 'broken' THEN pax ELSE 0 END) AS broken_pax FROM g GROUP BY trip""", "net won lost broken_pax", "improved worsened broken unlocked partly", 4)
def edit_net_impact(spark, sf):
    return Z.net_impact(_effects(spark, sf).withColumnRenamed("trip", "candidate"), ["candidate"])


CONTRIBUTION = "pax * CASE WHEN source = 'near' THEN greatest(0, least - wait) - greatest(0, least - ({0})) WHEN ({0}) < least THEN -(least - ({0}) + 60) ELSE wait - ({0}) END"


@add("Z03 J04", f"""WITH {EFFECTS}, {PROBES}, shifts AS (SELECT 'd' || c AS key, c % 5 - 2 AS shift FROM (SELECT DISTINCT id // 5 AS c FROM board) WHERE c % 4 = 0),
  state AS (SELECT f.*, coalesce(d.shift, 0) - coalesce(a.shift, 0) AS moved FROM f LEFT JOIN shifts d ON d.key = f.dep_key LEFT JOIN shifts a ON a.key = f.arr_key),
  t AS (SELECT candidate, effect, sum(signed) AS change FROM (SELECT candidate, effect, p.delta AS signed FROM probes p JOIN f ON p.key = f.dep_key UNION ALL SELECT candidate, effect, -p.delta FROM probes p JOIN f ON p.key = f.arr_key) GROUP BY ALL)
  SELECT candidate, sum({CONTRIBUTION.format('wait + moved + change')} - {CONTRIBUTION.format('wait + moved')}) AS marginal, sum(CASE WHEN source = 'existing' AND wait + moved + change < least THEN pax ELSE 0 END) AS broken_pax FROM t JOIN state USING (effect) GROUP BY candidate""", "marginal broken_pax", "", 4)
def marginal_scores(spark, sf):
    """Every candidate's score after every fourth departure event has been moved."""
    probes = _probes(spark, sf)
    made = probes.where("candidate % 4 = 0 AND key LIKE 'd%'").select("key", (F.col("candidate") % 5 - 2).cast("int").alias("shift"))
    return Z.marginal(Z.touched(_effects(spark, sf), probes), made)


def _ranks(spark, sf):
    """Candidates in order of their score on the untouched timetable."""
    effects, probes = _effects(spark, sf), _probes(spark, sf)
    none = spark.createDataFrame([], "key string, shift int")
    scored = Z.marginal(Z.touched(effects, probes), none).where("marginal > 0")
    return effects, probes, scored


def _gathered(spark, sf):
    """The effects, the probes, and each candidate with all that it touches, stored once for scores and selection."""
    effects, probes = _effects(spark, sf), _probes(spark, sf)
    return effects, probes, Z.stored(Z.gathered(effects, probes), I.shared_folder(spark, "candidates"))


def _ranked(rows):
    """Candidates of positive score on the untouched timetable with their ranks."""
    scored = rows.select("candidate", *Z.scores()).where("marginal > 0")
    # Ranks need no total order in one task: score and id tell any two apart.
    return scored.select("candidate", F.struct((-F.round("marginal", 6)).alias("score"), "candidate").alias("rank"))


@add("Z04")
def multi_pass_selection(spark, sf):
    """First-fit selection among all candidates of positive score, rescored as it goes."""
    effects, probes, rows = _gathered(spark, sf)
    return Z.greedy(effects, probes, _ranked(rows), rows=rows).select("candidate", "status", "pass", F.round("marginal", 6).alias("marginal"))


@add("Z04 T07 T08")
def selection_with_trials(spark, sf):
    """The same selection where each candidate also edits a section of the timetable, which must keep its runs."""
    from . import timetable_queries as Y

    effects, probes, made = _gathered(spark, sf)
    ranks = _ranked(made)
    rows, edits = Y._edits(spark, sf)
    edits = edits.where("edit LIKE '%-0'")
    # Candidates and edits are numbered apart and meet by their numbers.
    named = numbered(ranks.select("candidate"), [], ["candidate"], "n").join(numbered(edits.drop("rank"), [], ["edit"], "n"), "n")
    own = kept(named.select(F.col("candidate").alias("edit"), *[c for c in edits.columns if c not in ("edit", "rank")]))
    ranks = ranks.join(own.select(F.col("edit").alias("candidate")), "candidate", "left_semi")
    apart = own.select(F.col("edit").alias("candidate"), F.col("segment").alias("link"))
    out = Z.greedy(effects, probes, ranks, apart=apart, refused=Z.trial(rows, own), rows=made)
    return out.select("candidate", "status", "pass", F.round("marginal", 6).alias("marginal"))


TRANSFERS = f"{I.BOARD}, f AS (SELECT trip AS candidate, station AS section, minute % 30 AS wait, 3 + station % 4 AS least FROM board)"


def _transfers(spark, sf):
    return I.board(spark, sf).select(F.col("trip").alias("candidate"), F.col("station").alias("section"), (F.col("minute") % 30).alias("wait"), (3 + F.col("station") % 4).alias("least"))


@add("Z01 T06", f"""WITH {TRANSFERS}, t AS (SELECT candidate, section, wait, least, CASE WHEN section % 3 = 0 THEN NULL ELSE section % 5 END AS earlier, section % 7 AS later FROM f),
  a AS (SELECT *, unnest(['depart earlier', 'arrive earlier']) AS action FROM t) SELECT candidate, section, action, -least(10, wait - least, coalesce(CASE WHEN action = 'depart earlier' THEN earlier ELSE later END, 10)) AS delta FROM a
  WHERE least(10, wait - least, coalesce(CASE WHEN action = 'depart earlier' THEN earlier ELSE later END, 10)) > 0""", "", "delta")
def improvement_candidates(spark, sf):
    t = _transfers(spark, sf).withColumns({"earlier": F.when(F.col("section") % 3 != 0, F.col("section") % 5), "later": F.col("section") % 7})
    return Z.improvements(t, 10).select("candidate", "section", "action", "delta")


@add("Z01 J06", f"""WITH {TRANSFERS}, t AS (SELECT candidate, section, wait % 5 AS gap, least, section % 5 AS earlier, CASE WHEN section % 3 = 0 THEN NULL ELSE section % 7 END AS later FROM f), a AS (SELECT *, unnest(['depart later', 'arrive earlier']) AS action, least - gap AS need FROM t)
  SELECT candidate, section, action, CASE WHEN action = 'depart later' THEN need ELSE -need END AS delta FROM a WHERE need > 0 AND need <= 10 AND need <= coalesce(CASE WHEN action = 'depart later' THEN later ELSE earlier END, 10)""", "", "delta")
def unlock_candidates(spark, sf):
    t = _transfers(spark, sf).select("candidate", "section", (F.col("wait") % 5).alias("gap"), "least", (F.col("section") % 5).alias("earlier"), F.when(F.col("section") % 3 != 0, F.col("section") % 7).alias("later"))
    return Z.unlocks(t, 10).select("candidate", "section", "action", "delta")


#: Three rounds of scoring, unrolled: the best candidate of each round moves its events for the next.
def _round(n: int) -> str:
    made = " UNION ALL ".join(f"SELECT key, delta FROM probes JOIN b{k} USING (candidate)" for k in range(1, n)) or "SELECT '' AS key, 0 AS delta"
    gone = " UNION ALL ".join(f"SELECT candidate FROM b{k}" for k in range(1, n)) or "SELECT -1 AS candidate"
    return f"""m{n} AS (SELECT key, sum(delta) AS shift FROM ({made}) GROUP BY key), v{n} AS (SELECT f.*, coalesce(d.shift, 0) - coalesce(a.shift, 0) AS moved FROM f LEFT JOIN m{n} d ON d.key = f.dep_key LEFT JOIN m{n} a ON a.key = f.arr_key),
  b{n} AS (SELECT * FROM (SELECT candidate, sum({CONTRIBUTION.format('wait + moved + change')} - {CONTRIBUTION.format('wait + moved')}) AS marginal, sum(CASE WHEN source = 'existing' AND wait + moved + change < least THEN pax ELSE 0 END) AS broken FROM t JOIN v{n} USING (effect) WHERE candidate NOT IN ({gone}) GROUP BY candidate)
    WHERE broken = 0 AND marginal > 0 ORDER BY marginal DESC, candidate LIMIT 1)"""


@add("Z07", f"""WITH {EFFECTS}, {PROBES}, t AS (SELECT candidate, effect, sum(signed) AS change FROM (SELECT candidate, effect, p.delta AS signed FROM probes p JOIN f ON p.key = f.dep_key UNION ALL SELECT candidate, effect, -p.delta FROM probes p JOIN f ON p.key = f.arr_key) GROUP BY ALL),
  {_round(1)}, {_round(2)}, {_round(3)} SELECT 1 AS selection_order, candidate, marginal FROM b1 UNION ALL SELECT 2, candidate, marginal FROM b2 UNION ALL SELECT 3, candidate, marginal FROM b3""", "marginal", "selection_order")
def best_first_edits(spark, sf):
    """Three edits chosen one by one, each scored under those before it."""
    chosen = Z.best_first(_effects(spark, sf), _probes(spark, sf), 3)
    return spark.createDataFrame([(i + 1, c, float(m)) for i, (c, m) in enumerate(chosen)], "selection_order int, candidate long, marginal double")


@add("Z08")
def capped_selection(spark, sf):
    """Forty candidates of the best score whose events are free: at most fifteen of a year and six of a line in it."""
    effects, probes, scored = _ranks(spark, sf)
    named = scored.select("candidate", F.struct((-F.round("marginal", 6)).alias("score"), "candidate").alias("rank"), (F.col("candidate") % 2).alias("year"), (F.col("candidate") % 14).alias("line_of_year"), F.round("marginal", 6).alias("marginal"))
    events = probes.select("candidate", F.col("key").alias("event"))
    return Z.capped(named, events, {"year": 15, "line_of_year": 6}, 40).select("candidate", "year", "line_of_year", "marginal")


@add("R08", f"""WITH {I.BOARD}, l AS (SELECT trip AS path, id, service AS trip, minute AS dep0, minute + id % 4 AS arr0, CASE service WHEN 'view' THEN -1 WHEN 'purchase' THEN 2 ELSE 0 END AS moved FROM board),
  o AS (SELECT *, dep0 + moved AS dep, arr0 + moved AS arr FROM l), g AS (SELECT *, lead(dep) OVER w - arr AS gap, lead(trip) OVER w = trip AS same, row_number() OVER w AS i, count(*) OVER (PARTITION BY path) AS n FROM o WINDOW w AS (PARTITION BY path ORDER BY dep0, id)),
  s AS (SELECT path, bool_and(coalesce(gap, 0) >= 0) AS feasible, max(arr) FILTER (i = n) - max(dep) FILTER (i = 1) - max(arr0) FILTER (i = n) + max(dep0) FILTER (i = 1) AS change, sum(arr - dep)::DOUBLE AS r,
    coalesce(sum(greatest(gap, 0)) FILTER (same), 0)::DOUBLE AS d, coalesce(sum(greatest(gap, 0)) FILTER (NOT same), 0)::DOUBLE AS t, (count(*) FILTER (arr = dep)) / 3.0 AS z, (count(*) FILTER (same AND gap <= 0)) / 3.0 AS k FROM g GROUP BY path)
  SELECT path, feasible, change, CASE WHEN r + d = 0 THEN z ELSE r + z - (z + k) * r / (r + d) END AS rolling, CASE WHEN r + d = 0 THEN k ELSE d + k - (z + k) * d / (r + d) END AS dwell, CASE WHEN r + d = 0 THEN greatest(0, t - z - k) ELSE t END AS transfer FROM s""", "rolling dwell transfer", "change")
def paths_under_shifts(spark, sf):
    """All paths under shifts of two services: whether they still hold, what they take, and its parts."""
    shifts = spark.createDataFrame([("view", -1), ("purchase", 2)], "trip string, shift int")
    return Z.shifted_paths(_legs(spark, sf), shifts).select("path", "feasible", "change", "times.rolling", "times.dwell", "times.transfer")


#: An edit for each line, station and minute at which events of one type stand, derived from every board row of a purchase.
MOVED = f"""{I.BOARD}, legs AS (SELECT id, trip AS path, 'L' || line AS line, 'S' || station AS from_station, 'S' || (station + 1) % 11 AS to_station, minute AS dep, minute + CAST(id % 4 AS INT) AS arr, pax FROM board),
  edits AS (SELECT DISTINCT line || from_station || '@' || dep % 120 || '-' || arr % 120 AS edit, line, from_station, to_station, dep % 120 AS dep, arr % 120 AS arr, CAST(hash_of AS INT) AS delta FROM (SELECT *, dep % 7 - 3 AS hash_of FROM legs WHERE line = 'L2')),
  faces AS (SELECT DISTINCT edit, line, from_station, to_station, (dep + moved + 120) % 120 AS dep, (arr + moved + 120) % 120 AS arr FROM (SELECT *, unnest([0, delta]) AS moved FROM edits)),
  hits AS (SELECT edit, l.* FROM legs l JOIN faces e ON l.line = e.line AND l.from_station = e.from_station AND l.to_station = e.to_station AND l.dep % 120 = e.dep AND l.arr % 120 = e.arr)"""


def _moved(spark, sf):
    station = lambda k: F.concat(F.lit("S"), ((F.col("station") + k) % 11).cast("string"))
    legs = I.board(spark, sf).select(F.col("id"), F.col("trip").alias("path"), F.concat(F.lit("L"), F.col("line").cast("string")).alias("line"), station(0).alias("from_station"), station(1).alias("to_station"), F.col("minute").alias("dep"), (F.col("minute") + (F.col("id") % 4).cast("int")).alias("arr"), "pax")
    face = lambda c: (F.col(c) % 120).cast("string")
    edits = legs.where("line = 'L2'").select(F.concat("line", "from_station", F.lit("@"), face("dep"), F.lit("-"), face("arr")).alias("edit"), "line", "from_station", "to_station", (F.col("dep") % 120).alias("dep"), (F.col("arr") % 120).alias("arr"), (F.col("dep") % 7 - 3).alias("delta")).distinct()
    return legs, edits


@add("Z09 F02", f"WITH {MOVED} SELECT 'undo ' || edit AS edit, line, from_station, to_station, (dep + delta + 120) % 120 AS dep, (arr + delta + 120) % 120 AS arr, -delta AS delta FROM edits", "", "dep arr delta")
def inverse_edits(spark, sf):
    return Z.inverse(_moved(spark, sf)[1])


@add("Z09 J05", f"WITH {MOVED} SELECT path, count(DISTINCT edit) AS edits, count(*) AS legs, min(dep) AS first FROM hits GROUP BY path", "", "edits legs first")
def impacted_paths(spark, sf):
    """Paths that ride a section of an edit, at its old or new minutes."""
    return Z.impacted(*_moved(spark, sf)).groupBy("path").agg(F.countDistinct("edit").alias("edits"), F.count("*").alias("legs"), F.min("dep").alias("first"))


@add("Z10 A02", f"""WITH {MOVED}, cells AS (SELECT path, sum(pax) AS weight, avg(arr - dep) AS total, avg(dep % 10) AS wait FROM legs GROUP BY path)
  SELECT edit, count(*) AS cells, sum(weight) AS pax, sum(total * weight) / sum(weight) AS mean_total, sum(wait * weight) / sum(weight) AS mean_wait FROM (SELECT DISTINCT edit, path FROM hits) JOIN cells USING (path) GROUP BY edit""", "pax mean_total mean_wait", "cells")
def edit_attribution(spark, sf):
    legs, edits = _moved(spark, sf)
    cells = legs.groupBy("path").agg(F.sum("pax").alias("weight"), F.avg(F.col("arr") - F.col("dep")).alias("total"), F.avg(F.col("dep") % 10).alias("wait"))
    return Z.attribution(Z.impacted(legs, edits), cells, "path", ["total", "wait"], "weight")


#: Paths of four legs each from a user's events in a row; a leg runs to where the next one begins, or to a station beside it.
#: A change takes 3 to 6 minutes, from S9 to S10 7, and elsewhere there is none.  Edits are of sections of line L2.
RIDDEN = f"""{I.BOARD}, e AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY minute, id) - 1 AS k FROM board),
  legs AS (SELECT trip || '/' || (k // 4) AS path, k % 4 AS pos, 'L' || line AS line, service AS trip, 'S' || station AS from_station, minute AS dep, minute + id % 4 AS arr,
      CASE WHEN nxt IS NULL THEN 'S' || (station + 1) % 11 WHEN nxt = 10 AND id % 2 = 0 THEN 'S9' ELSE 'S' || nxt END AS to_station
    FROM (SELECT *, lead(station) OVER (PARTITION BY trip, k // 4 ORDER BY k) AS nxt FROM e)),
  weights AS (SELECT trip || '/' || (k // 4) AS path, sum(pax) AS weight FROM e GROUP BY 1),
  edits AS (SELECT DISTINCT concat_ws('-', line, from_station, to_station, dep % 120, arr % 120) AS edit, line, from_station, to_station, dep % 120 AS dep, arr % 120 AS arr, dep % 120 % 7 - 3 AS delta FROM legs WHERE line = 'L2' AND dep % 120 % 7 <> 3),
  made AS (SELECT * FROM edits WHERE (dep + arr) % 3 = 0),
  hits AS (SELECT edit, path, pos, delta FROM legs JOIN edits USING (line, from_station, to_station) WHERE legs.dep % 120 = edits.dep AND legs.arr % 120 = edits.arr)"""


def _valued(name: str, rows: str) -> str:
    """Whether each path of ``rows`` (path, case, legs) holds, its minutes and its share of rolling."""
    return f"""{name} AS (
  SELECT path, c, bool_and(arr >= dep AND coalesce(nd >= arr + CASE WHEN nt = trip THEN 0 ELSE least END, nd IS NULL)) AND last(arr ORDER BY pos) > first(dep ORDER BY pos) AS ok,
    CAST(last(arr ORDER BY pos) - first(dep ORDER BY pos) AS DOUBLE) AS total, CAST(sum(greatest(arr - dep, 0)) AS DOUBLE) AS r, CAST(coalesce(sum(greatest(nd - arr, 0)) FILTER (nt = trip), 0) AS DOUBLE) AS d,
    count(*) FILTER (arr <= dep) / 3.0 AS z, count(*) FILTER (nt = trip AND nd <= arr) / 3.0 AS k
  FROM (SELECT *, lead(dep) OVER w AS nd, lead(trip) OVER w AS nt, CASE WHEN lead(from_station) OVER w = to_station THEN 3 + CAST(substr(to_station, 2) AS INT) % 4 WHEN to_station = 'S9' AND lead(from_station) OVER w = 'S10' THEN 7 END AS least
    FROM ({rows}) WINDOW w AS (PARTITION BY path, c ORDER BY pos)) GROUP BY path, c),
  {name}_share AS (SELECT *, CASE WHEN r + d = 0 THEN z ELSE greatest(0, r + z - (z + k) * r / (r + d)) END / total AS share FROM {name})"""


def _ridden(spark, sf):
    b = I.board(spark, sf)
    by = Window.partitionBy("trip").orderBy("minute", "id")
    e = b.withColumn("k", F.row_number().over(by) - 1).withColumn("path", F.concat_ws("/", F.col("trip").cast("string"), F.floor(F.col("k") / 4).cast("string")))
    s = lambda c: F.concat(F.lit("S"), c.cast("string"))
    nxt = F.lead("station").over(Window.partitionBy("path").orderBy("k"))
    to = F.when(F.col("nxt").isNull(), s((F.col("station") + 1) % 11)).when((F.col("nxt") == 10) & (F.col("id") % 2 == 0), F.lit("S9")).otherwise(s(F.col("nxt")))
    leg = F.struct(F.concat(F.lit("L"), F.col("line").cast("string")).alias("line"), F.col("service").alias("trip"), s(F.col("station")).alias("from_station"), to.alias("to_station"), F.col("minute").cast("int").alias("dep"), (F.col("minute") + F.col("id") % 4).cast("int").alias("arr"))
    paths = e.withColumn("nxt", nxt).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", leg.alias("leg")))), lambda x: x["leg"]).alias("legs"), F.sum("pax").alias("weight"))
    n = spark.range(11).select(F.col("id"), s(F.col("id")).alias("from_station"))
    transfers = n.select("from_station", F.col("from_station").alias("to_station"), (3 + F.col("id") % 4).alias("minutes")).unionByName(n.where("id = 9").select("from_station", F.lit("S10").alias("to_station"), F.lit(7).alias("minutes")))
    ready = X.prepared(paths, transfers)
    index = X.sections(ready)
    edits = index.where("line = 'L2'").select(*X.SECTION, (F.col("dep") % 7 - 3).alias("delta")).where("delta <> 0").distinct()
    edits = edits.select(F.concat_ws("-", *[F.col(c).cast("string") for c in X.SECTION]).alias("edit"), *X.SECTION, "delta")
    return ready, index, edits


SCORES = "paths pax saved won lost invalidated invalidated_paths mean_change rolling_share_change"


@add("Z05 Z03 J05", f"""WITH {RIDDEN},
  base AS (SELECT l.* REPLACE (dep + coalesce(h.delta, 0) AS dep, arr + coalesce(h.delta, 0) AS arr), 0 AS c FROM legs l LEFT JOIN (SELECT * FROM hits WHERE edit IN (SELECT edit FROM made)) h USING (path, pos)),
  tried AS (SELECT DISTINCT edit, path FROM hits WHERE edit NOT IN (SELECT edit FROM made)),
  {_valued("was", "SELECT * FROM base")},
  {_valued("now", "SELECT b.* REPLACE (t.edit AS c, b.dep + coalesce(h.delta, 0) AS dep, b.arr + coalesce(h.delta, 0) AS arr) FROM tried t JOIN base b USING (path) LEFT JOIN hits h ON h.edit = t.edit AND h.path = b.path AND h.pos = b.pos")},
  twice AS (SELECT n.c AS edit, weight, n.ok, (w.total - n.total) * weight AS saved, (n.share - w.share) * weight AS rolling FROM now_share n JOIN was_share w ON w.path = n.path AND w.ok JOIN weights ON weights.path = n.path AND weight > 0),
  sums AS (SELECT edit, count(*) AS paths, sum(weight) AS pax, coalesce(sum(saved) FILTER (ok), 0) AS saved, coalesce(sum(saved) FILTER (ok AND saved > 0), 0) AS won, coalesce(sum(saved) FILTER (ok AND saved < 0), 0) AS lost,
    coalesce(sum(weight) FILTER (NOT ok), 0) AS invalidated, count(*) FILTER (NOT ok) AS invalidated_paths, coalesce(sum(rolling) FILTER (ok), 0) AS rolling FROM twice GROUP BY edit)
  SELECT edit, coalesce(paths, 0) AS paths, coalesce(pax, 0) AS pax, coalesce(saved, 0) AS saved, coalesce(won, 0) AS won, coalesce(lost, 0) AS lost, coalesce(invalidated, 0) AS invalidated, coalesce(invalidated_paths, 0) AS invalidated_paths,
    coalesce(-saved / pax, 0) AS mean_change, coalesce(rolling / pax, 0) AS rolling_share_change FROM (SELECT DISTINCT edit FROM edits WHERE edit NOT IN (SELECT edit FROM made)) LEFT JOIN sums USING (edit)""", "pax saved won lost invalidated mean_change rolling_share_change", "paths invalidated_paths", 4)
def path_scores_of_edits(spark, sf):
    """What each edit does to the paths that ride its section, after a third of all edits has been made."""
    paths, index, edits = _ridden(spark, sf)
    made = (F.col("dep") + F.col("arr")) % 3 == 0
    return X.marginal(paths, index, edits.where(~made), edits.where(made)).select("edit", *SCORES.split())


@add("Z06 Z10", f"""WITH {RIDDEN}, set_hits AS (SELECT * FROM hits WHERE edit IN (SELECT edit FROM made)),
  {_valued("was", "SELECT *, 0 AS c FROM legs")},
  {_valued("now", "SELECT l.* REPLACE (dep + coalesce(h.delta, 0) AS dep, arr + coalesce(h.delta, 0) AS arr), 0 AS c FROM legs l LEFT JOIN set_hits h USING (path, pos) WHERE path IN (SELECT path FROM set_hits)")},
  twice AS (SELECT n.path, weight, n.ok, (w.total - n.total) * weight AS saved FROM now_share n JOIN was_share w ON w.path = n.path AND w.ok JOIN weights ON weights.path = n.path AND weight > 0)
  SELECT 'all' AS edit, count(*) AS paths, sum(weight) AS pax, coalesce(sum(saved) FILTER (ok), 0) AS saved, coalesce(sum(weight) FILTER (NOT ok), 0) AS invalidated FROM twice
  UNION ALL SELECT edit, count(*), sum(weight), NULL, sum(weight) FROM twice JOIN (SELECT DISTINCT edit, path FROM set_hits) USING (path) WHERE NOT ok GROUP BY edit""", "pax saved invalidated", "paths", 4)
def combined_edits(spark, sf):
    """A third of all edits at once: the totals, and for each edit the paths that no longer hold."""
    paths, index, edits = _ridden(spark, sf)
    totals, broken = X.combined(paths, index, edits.where((F.col("dep") + F.col("arr")) % 3 == 0))
    one = totals.select(F.lit("all").alias("edit"), "paths", "pax", "saved", "invalidated")
    return one.unionByName(broken.select("edit", "paths", "pax", F.lit(None).cast("double").alias("saved"), F.col("pax").alias("invalidated")))


def _surface(spark, sf, shift=0.0):
    s = I.stations(spark, sf).select(((F.col("lon") - 6) * 76).alias("px"), ((F.col("lat") - 45.8) * 111).alias("py"), (F.col("id") + shift).alias("v"), (1 + F.col("id") % 3).alias("w"))
    return G.kernel_surface(G.raster(spark, 0.0, 0.0, 20.0, 16, 12), s, "v", "w", 12.0, 25.0)


GRID = f"""{I.STATIONS}, g AS (SELECT CAST(k % 16 AS INT) AS i, CAST(k // 16 AS INT) AS j, k % 16 * 20.0 AS x, k // 16 * 20.0 AS y FROM range(192) t(k)),
  n AS (SELECT i, j, id, 1 + id % 3 AS w, sqrt(pow(x - (lon - 6) * 76, 2) + pow(y - (lat - 45.8) * 111, 2)) AS d FROM g CROSS JOIN stations)"""


@add("G01 G02 S08", f"WITH {GRID}, v AS (SELECT i, j, sum(w * exp(-d * d / 288) * id) / sum(w * exp(-d * d / 288)) AS value, min(d) AS nearest FROM n WHERE d <= 25 GROUP BY ALL) SELECT g.i, g.j, x, y, value, nearest, nearest IS NOT NULL AS covered FROM g LEFT JOIN v USING (i, j)", "x y value nearest")
def kernel_surface(spark, sf):
    return _surface(spark, sf)


@add("G04", f"WITH {GRID}, v AS (SELECT i, j, sum(w * exp(-d * d / 288) * id) / sum(w * exp(-d * d / 288)) AS a FROM n WHERE d <= 25 GROUP BY ALL) SELECT g.i, g.j, a, a + 2.5 AS b, CASE WHEN a IS NULL THEN NULL ELSE 2.0 END AS change FROM g LEFT JOIN v USING (i, j)", "a b change")
def surface_change(spark, sf):
    out = G.raster_change(_surface(spark, sf), _surface(spark, sf, 2.5), 2.0)
    return out.withColumn("change", F.when(F.col("a").isNotNull(), F.col("change")))


@add("G03")
def surface_contours(spark, sf):
    return G.contour_segments(_surface(spark, sf), 12.0)


@add("G05", f"WITH {I.STATIONS} SELECT region, min(lon) - 0.2 AS low_x, max(lon) + 0.2 AS high_x, min(lat) - 0.2 AS low_y, max(lat) + 0.2 AS high_y, count(*) AS n FROM stations GROUP BY region", "low_x high_x low_y high_y", "n")
def region_boxes(spark, sf):
    return G.boxes(I.stations(spark, sf), ["region"], 0.2)


#: A screenline of each corridor and a short link at each event, on a plane in kilometres.
CORRIDORS = """corridors AS (SELECT a.id AS corridor, (a.lon - 6) * 76 AS x1, (a.lat - 45.8) * 111 AS y1, (b.lon - 6) * 76 AS x2, (b.lat - 45.8) * 111 AS y2 FROM stations a JOIN stations b ON b.id = (a.id + 1) % 25),
  lines AS (SELECT corridor, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, (x2 - x1) * h AS hx, (y2 - y1) * h AS hy FROM (SELECT *, greatest(2.5, least(12, 0.35 * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2))) / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS h FROM corridors)),
  s AS (SELECT corridor, mx - hy AS x1, my + hx AS y1, mx + hy AS x2, my - hx AS y2 FROM lines),
  l AS (SELECT event_id AS link, event_id * 7919 % 32000 / 100 AS ax, event_id * 104729 % 21500 / 100 AS ay, event_id * 7919 % 32000 / 100 + (event_id % 13 - 6) AS ex, event_id * 104729 % 21500 / 100 + (event_id % 11 - 5) AS ey FROM events)"""
#: Distance of point (p, q) from the segment from (a, b) to (c, d).
APART = "sqrt(({p} - {a} - t * ({c} - {a})) ** 2 + ({q} - {b} - t * ({d} - {b})) ** 2)"
TO_LINK = "(SELECT " + APART.format(p="s.{x}", q="s.{y}", a="ax", b="ay", c="ex", d="ey") + " FROM (SELECT greatest(0, least(1, coalesce(((s.{x} - ax) * (ex - ax) + (s.{y} - ay) * (ey - ay)) / nullif((ex - ax) ** 2 + (ey - ay) ** 2, 0), 0))) AS t))"
TO_LINE = "(SELECT " + APART.format(p="{x}", q="{y}", a="s.x1", b="s.y1", c="s.x2", d="s.y2") + " FROM (SELECT greatest(0, least(1, (({x} - s.x1) * (s.x2 - s.x1) + ({y} - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2))) AS t))"
NEAREST = ", ".join([TO_LINK.format(x="x1", y="y1"), TO_LINK.format(x="x2", y="y2"), TO_LINE.format(x="ax", y="ay"), TO_LINE.format(x="ex", y="ey")])


@add("J10", f"""WITH {I.STATIONS}, {CORRIDORS} SELECT corridor, link FROM s CROSS JOIN l
  WHERE (((x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1)) * ((x2 - x1) * (ey - y1) - (y2 - y1) * (ex - x1)) <= 0 AND ((ex - ax) * (y1 - ay) - (ey - ay) * (x1 - ax)) * ((ex - ax) * (y2 - ay) - (ey - ay) * (x2 - ax)) <= 0)
    OR least({NEAREST}) <= 0.15""")
def links_at_screenlines(spark, sf):
    """Short links of all events that cross the screenlines of 25 corridors or come near them."""
    s = I.stations(spark, sf).select("id", ((F.col("lon") - 6) * 76).alias("x"), ((F.col("lat") - 45.8) * 111).alias("y"))
    a, b = s.toDF("corridor", "x1", "y1"), s.toDF("b", "x2", "y2")
    e, at = F.col("event_id"), lambda by, most: F.col("event_id") * by % most / 100
    links = I.read(spark, sf, "events").select(e.alias("link"), at(7919, 32000).alias("a_x"), at(104729, 21500).alias("a_y"), (at(7919, 32000) + e % 13 - 6).alias("b_x"), (at(104729, 21500) + e % 11 - 5).alias("b_y"))
    return G.screenline_links(a.join(b, F.col("b") == (F.col("corridor") + 1) % 25), links, 0.15, few=True).select("corridor", "link")


#: Each user's events in order as legs of a path; a train carries it for three legs, then it changes.
CARRIED = """legs AS (SELECT user_id AS path, k AS seq, (user_id + k // 3) % 7 AS line, user_id * 1000 + k // 3 AS train, event_id % 11 AS a, next_id % 11 AS b, k * 10 + event_id % 4 AS dep, k * 10 + 5 + event_id % 3 AS arr, user_id % 17 + 0.5 AS flow, 1 + user_id % 5 AS instances
  FROM (SELECT user_id, event_id, lead(event_id) OVER w AS next_id, row_number() OVER w - 1 AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_id IS NOT NULL)"""


def _carried(spark, sf):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = I.read(spark, sf, "events").select("user_id", "event_id", F.lead("event_id").over(by).alias("next_id"), (F.row_number().over(by) - 1).cast("long").alias("k")).where("next_id IS NOT NULL")
    third = F.floor(F.col("k") / 3)
    return e.select(
        F.col("user_id").alias("path"), F.col("k").alias("seq"), ((F.col("user_id") + third) % 7).alias("line"), (F.col("user_id") * 1000 + third).alias("train"), (F.col("event_id") % 11).alias("a"), (F.col("next_id") % 11).alias("b"),
        (F.col("k") * 10 + F.col("event_id") % 4).alias("dep"), (F.col("k") * 10 + 5 + F.col("event_id") % 3).alias("arr"), (F.col("user_id") % 17 + 0.5).alias("flow"), (1 + F.col("user_id") % 5).alias("instances"),
    )


@add("D17 A19", f"""WITH {CARRIED}, p AS (SELECT path, line, a, b, max(flow) AS flow FROM legs GROUP BY ALL), r AS (SELECT path, line, max(flow) AS flow, count(*) AS n FROM legs GROUP BY ALL),
  t AS (SELECT path, line, train, a, b, max(flow) / max(instances) AS flow FROM legs GROUP BY ALL)
  SELECT 'service' AS kind, line, NULL AS train, a, b, sum(flow) AS load FROM p GROUP BY line, a, b UNION ALL SELECT 'network', NULL, NULL, a, b, sum(flow) FROM p GROUP BY a, b
  UNION ALL SELECT 'riders', line, NULL, NULL, NULL, sum(flow) FROM r GROUP BY line UNION ALL SELECT 'volume', line, NULL, NULL, NULL, sum(flow * n) FROM r GROUP BY line
  UNION ALL SELECT 'train', line, train, a, b, sum(flow) FROM t GROUP BY line, train, a, b""", "load", "line train a b")
def service_loads(spark, sf):
    """Section loads of lines, of the network and of trains, riders of lines and leg volume, from the flows of paths."""
    return L.service_loads(_carried(spark, sf))


#: Changes of train within the paths, each with the line before and the line after.
CHANGES = f"""{CARRIED}, changes AS (SELECT n.path, n.seq, n.a AS station, p.line AS arrival_line, n.dep - p.arr AS wait, n.line AS departure_line, n.flow, p.train AS from_train, n.train AS to_train FROM legs n JOIN legs p ON p.path = n.path AND p.seq = n.seq - 1 AND p.train <> n.train)"""


@add("D18", f"WITH {CHANGES} SELECT station, arrival_line, wait, departure_line, count(DISTINCT path) AS paths, sum(flow) AS flow FROM (SELECT DISTINCT path, station, arrival_line, wait, departure_line, flow FROM changes) GROUP BY ALL", "flow", "station arrival_line wait departure_line paths")
def transfer_kinds(spark, sf):
    """Each kind of transfer with the paths and the flow that make it."""
    return L.transfer_rows(L.path_transfers(_carried(spark, sf)))


@add("D18", f"""WITH {CHANGES}, passed AS (
    SELECT c.*, 'prior' AS side, c.arrival_line AS line, l.a AS other FROM changes c JOIN legs l ON l.path = c.path AND l.train = c.from_train UNION ALL SELECT c.*, 'following', c.departure_line, l.b FROM changes c JOIN legs l ON l.path = c.path AND l.train = c.to_train),
  known AS (SELECT station AS other, arrival_line AS line FROM changes UNION SELECT station, departure_line FROM changes)
  SELECT station, arrival_line, wait, departure_line, side, other, count(*) AS paths, sum(flow) AS flow FROM (SELECT DISTINCT path, station, arrival_line, wait, departure_line, side, other, flow FROM passed SEMI JOIN known USING (other, line) WHERE other <> station) GROUP BY ALL""",
  "flow", "station arrival_line wait departure_line other paths")
def transfer_overlap(spark, sf):
    """The flow of each kind of transfer that also passes other stations of change, before and after, on the same train."""
    return L.transfer_overlap(L.path_transfers(_carried(spark, sf)))


@add("I01 I02 K06 K08", "SELECT event_type, sum(value) AS load, count(*) AS n FROM events GROUP BY 1", "load", "n", 3)
def streamed_running_loads(spark, sf):
    """A file stream run to its end: its state is the batch aggregate."""
    at = I.shared_folder(spark, "loads")
    schema = I.read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = stream.select("event_type", F.col("value").alias("load"), F.lit(1).cast("long").alias("n"))
    incremental.merged(rows, f"{at}/state", f"{at}/cursor", ["event_type"], ["load", "n"], []).awaitTermination()
    return readers.current(spark, f"{at}/state").select("event_type", "load", "n")


def _growing(spark, sf, folder):
    """Writes all events to ``folder`` in three parts, by time: each begins with a repeat of the last hour of the one before, and holds back every tenth row of its last half hour, which comes late with the next."""
    utc = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")  # the table's times have no zone
    e = I.read(spark, sf, "events").where("ts IS NOT NULL").withColumn("ts", utc)
    low, high = e.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    at, begin = F.col("ts").cast("double"), None
    for third in (1, 2, 3):
        end = low + (high - low) * third / 3 if third < 3 else high + 1e9
        part = at < end if begin is None else (at < end) & (at >= begin - 3600)
        held = (F.col("event_id") % 10 == 0) & (at >= end - 1800)
        e.where(part & ~held).write.mode("append").parquet(folder)
        begin = end
        yield e.schema


@add("I02 A05 A02", """SELECT event_type, count(*) AS n, sum(1 + user_id % 5) AS weight, sum((1 + user_id % 5) * value) AS weighted_value, sum((1 + user_id % 5) * value) / sum(1 + user_id % 5) AS mean_value, epoch_us(min(ts)) AS first_us
  FROM events WHERE ts IS NOT NULL GROUP BY 1""", "weight weighted_value mean_value", "n first_us", 4)
def streamed_accounts(spark, sf):
    """Weighted accounts of a growing folder with repeated and late events, by a stream that is started again for each part: equal to the batch."""
    at = I.shared_folder(spark, "accounts")
    for schema in _growing(spark, sf, f"{at}/in"):
        stream = incremental.files(spark, f"{at}/in", schema.simpleString()[7:-1].replace(":", " ")).withColumn("path_weight", 1 + F.col("user_id") % 5)
        incremental.accounts(stream, f"{at}/state", f"{at}/cursor", ["event_type"], ["user_id", "event_id"], "ts", "2 hours", "path_weight", ["value"]).awaitTermination()
    rows = incremental.means(readers.current(spark, f"{at}/state"), ["value"])
    return rows.select("event_type", "n", "weight", "weighted_value", "mean_value", F.unix_micros("first").alias("first_us"))


@add("I02 I01", """SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS start_us, event_type, count(*) AS n, sum(value) AS value FROM events
  GROUP BY 1, 2 HAVING start_us + 21600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 7200000000 FROM events)""", "value", "start_us n", 4)
def closed_windows(spark, sf):
    """Six-hour windows of the same growing folder, each written once when no late event can change it any more."""
    at = I.shared_folder(spark, "windows")
    for schema in _growing(spark, sf, f"{at}/in"):
        stream = incremental.files(spark, f"{at}/in", schema.simpleString()[7:-1].replace(":", " "))
        loads = incremental.windowed(incremental.once(stream, ["user_id", "event_id"], "ts", "2 hours"), "ts", None, "6 hours", ["event_type"], "value")
        incremental.appended(loads, f"{at}/out", f"{at}/cursor").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.unix_micros("start").alias("start_us"), "event_type", "n", "value")
