"""Routing on a timetable: one-to-all earliest arrivals, skims, legs and their times, service metrics, components.

Routes come from the departure profiles of all pairs (``profiles``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profiles

LEG = "struct<from_station:string,to_station:string,dep:int,arr:int,trip:string>"

def train_legs(path: Column) -> Column:
    """The hops of a path joined to one leg for each train."""

    def add(legs: Column, hop: Column) -> Column:
        last = F.element_at(legs, -1)
        longer = F.struct(last["from_station"].alias("from_station"), hop["to_station"].alias("to_station"), last["dep"].alias("dep"), hop["arr"].alias("arr"), last["trip"].alias("trip"))
        goes_on = (F.size(legs) > 0) & (F.get(legs, F.size(legs) - 1)["trip"] == hop["trip"])
        return F.when(goes_on, F.concat(F.slice(legs, F.lit(1), F.size(legs) - 1), F.array(longer))).otherwise(F.concat(legs, F.array(hop)))

    return F.aggregate(path, F.slice(path, 1, 0), add)


def one_to_all(connections: DataFrame, queries: DataFrame, transfers: DataFrame, default_transfer: int = 3) -> DataFrame:
    """Routes from each (``origin``, ``ready``) of ``queries`` to every station reached: of least arrival, then latest departure, then fewest changes and hops.

    ``connections``: ``trip``, ``from_station``, ``to_station``, ``dep``, ``arr``
    (not before ``dep``), and ``seq``, their order in a trip, where some take no
    time; ``transfers``: ``station``, ``minutes``.  The first departure of the
    pair's profile that is not before the ready time is the route.
    """
    moves = connections if "seq" in connections.columns else connections.withColumn("seq", F.lit(0))
    stations = moves.select(F.explode(F.array(*[F.col(c).cast("string") for c in ("from_station", "to_station")])).alias("station")).distinct()
    own = transfers.select(F.col("station").cast("string").alias("station"), "minutes")
    edges = stations.join(own, "station", "left").select(F.col("station").alias("from_station"), F.col("station").alias("to_station"), F.coalesce("minutes", F.lit(default_transfer)).alias("minutes"))
    asked = queries.select(F.col("origin").cast("string").alias("origin"), F.col("ready").cast("int").alias("ready")).distinct()
    found = profiles.profiles(moves, stations.withColumn("place", F.col("station")), edges, start=0, end=profiles.FOREVER, paths=True)
    route = F.struct("arr", "dep", "changes", "hops", "path")
    first = asked.join(found, "origin").where("dep >= ready").groupBy("origin", "ready", "destination").agg(F.min_by(route, "dep").alias("r"))
    return first.select(
        "origin", "ready", "destination", F.col("r.arr").alias("arrival"), F.col("r.dep").alias("departure"), F.col("r.changes").alias("transfers"), F.col("r.hops").alias("movements"), train_legs(F.col("r.path")).alias("legs")
    )


def skim(routes: DataFrame, pairs: DataFrame, periods: int, floor: float = 960.0) -> DataFrame:
    """Mean generalised minutes over the ready times; a missing one counts as the larger of 1.5 times the worst and ``floor``."""
    per = routes.groupBy("origin", "destination").agg(F.sum(F.col("arrival") - F.col("ready")).alias("total"), F.max(F.col("arrival") - F.col("ready")).alias("worst"), F.count("*").alias("reachable"), F.avg("transfers").alias("transfers"))
    out = pairs.join(per, ["origin", "destination"], "left").withColumn("reachable", F.coalesce("reachable", F.lit(0)))
    missing = F.lit(periods) - F.col("reachable")
    penalty = F.greatest(1.5 * F.coalesce("worst", F.lit(0)), F.lit(floor))
    return out.withColumns({"missing": missing, "minutes": F.when(F.col("origin") == F.col("destination"), 0.0).otherwise((F.coalesce("total", F.lit(0)) + missing * penalty) / periods)}).drop("total", "worst")


def leg_times(legs: Column, zero: float = 1 / 3, rebalance: bool = True) -> Column:
    """Rolling, dwell and transfer minutes of a path's legs.

    Between legs of one trip lies dwell, between trips transfer; negative times
    count as none.  A dwell (or a leg) of no length counts ``zero``.  With
    ``rebalance`` what that adds is taken off rolling and dwell in proportion,
    or off the transfers where there is neither, so that the total stays; a path
    of no length has no times.  Without, it is taken off rolling alone.
    """
    nought = lambda c: F.greatest(c, F.lit(0))
    count = F.size(legs)
    rolling = F.aggregate(legs, F.lit(0.0), lambda t, x: t + nought(x["arr"] - x["dep"]))
    still = F.aggregate(legs, F.lit(0), lambda t, x: t + F.when(x["arr"] <= x["dep"], 1).otherwise(0))
    gaps = F.when(count > 1, F.sequence(F.lit(0), count - 2)).otherwise(F.array().cast("array<int>"))
    gap = lambda i: nought(F.get(legs, i + 1)["dep"] - F.get(legs, i)["arr"])
    same = lambda i: F.get(legs, i + 1)["trip"] == F.get(legs, i)["trip"]
    dwell = F.aggregate(gaps, F.lit(0.0), lambda t, i: t + F.when(same(i), gap(i)).otherwise(0))
    none = F.aggregate(gaps, F.lit(0), lambda t, i: t + F.when(same(i) & (gap(i) == 0), 1).otherwise(0))
    transfer = F.aggregate(gaps, F.lit(0.0), lambda t, i: t + F.when(same(i), 0).otherwise(gap(i)))
    if not rebalance:
        return F.struct((rolling - none * zero).alias("rolling"), (dwell + none * zero).alias("dwell"), transfer.alias("transfer"))
    sums = F.struct(rolling.alias("r"), dwell.alias("d"), transfer.alias("t"), (still * zero).alias("z"), (none * zero).alias("k"))

    def balanced(s: Column) -> Column:
        pool, added = s["r"] + s["d"], s["z"] + s["k"]
        part = lambda own, extra: F.when(pool > 0, nought(own + extra - added * own / pool)).otherwise(extra)
        out = F.struct(part(s["r"], s["z"]).alias("rolling"), part(s["d"], s["k"]).alias("dwell"), F.when(pool > 0, s["t"]).otherwise(nought(s["t"] - added)).alias("transfer"))
        nothing = F.struct(F.lit(0.0).alias("rolling"), F.lit(0.0).alias("dwell"), F.lit(0.0).alias("transfer"))
        return F.when(pool + s["t"] > 0, out).otherwise(nothing)

    return F.get(F.transform(F.array(sums), balanced), 0)


def terminal_aliases(nodes: Column, prefix: str, name: str) -> Column:
    """Only the first and last node of a path take the family's name."""
    last = F.size(nodes) - 1
    return F.transform(nodes, lambda x, i: F.when(((i == 0) | (i == last)) & x.startswith(prefix), F.lit(name)).otherwise(x))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``component`` (the least name reachable) of each ``node``, by rounds of least labels and jumps.

    The edges and each round are checkpointed to the shared folder, so no round asks for the edges' tables again.
    """
    held = lambda df: df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b"), F.col("a")).toDF("node", "other")).distinct()
    both = held(both)
    labels = nodes.select("node", F.col("node").alias("component"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other").withColumnRenamed("component", "__c"), "other").groupBy("node").agg(F.min("__c").alias("__near"))
        new = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("__near", "component")).alias("__new"))
        jump = new.select(F.col("node").alias("__new"), F.col("__new").alias("__far"))
        new = new.join(jump, "__new", "left").select("node", F.least("__new", F.coalesce("__far", "__new")).alias("component"), F.col("component").alias("was"))
        new = held(new)
        if not new.where("component <> was").limit(1).count():
            return new.drop("was")
        labels = new.drop("was")
