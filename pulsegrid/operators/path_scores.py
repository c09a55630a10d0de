"""Edits of timetable sections scored on the paths of passengers: each alone, all together, and one after the other.

A path has ``legs`` (structs of ``line``, ``trip``, ``from_station``,
``to_station``, ``dep``, ``arr``) and a ``weight``.  An edit moves every leg of
its section (``line``, ``from_station``, ``to_station``, ``dep`` and ``arr`` as
clockface minutes of 120) by ``delta``.  The index of sections says which legs
of which paths an edit touches; only those paths are evaluated, as rows of
their own.  A path holds if no leg ends before it begins, no train leaves before
it has come, every change has its minutes, and it takes time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import leg_times

SECTION = ("line", "from_station", "to_station", "dep", "arr")
CYCLE = 120


def prepared(paths: DataFrame, transfers: DataFrame) -> DataFrame:
    """``path``, ``weight``, ``legs`` of the paths of positive weight, and ``needs``: the minutes of the change after each leg, null where there is none.

    ``transfers``: ``from_station``, ``to_station``, ``minutes``, also of a station to itself.
    """
    some = paths.where((F.col("weight") > 0) & (F.size("legs") > 0)).select("path", "weight", "legs")
    at = some.select("path", F.posexplode("legs").alias("pos", "leg"), "legs").select("path", "pos", F.col("leg.to_station").alias("from_station"), F.get("legs", F.col("pos") + 1)["from_station"].alias("to_station"))
    need = at.join(transfers.select("from_station", "to_station", "minutes"), ["from_station", "to_station"], "left")
    needs = need.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "minutes"))), lambda x: x["minutes"]).alias("needs"))
    return some.join(needs, "path")


def sections(paths: DataFrame) -> DataFrame:
    """The index: each leg's section, ``path`` and ``pos``."""
    leg = paths.select("path", F.posexplode("legs").alias("pos", "leg"))
    face = lambda c: F.pmod(F.col(f"leg.{c}"), F.lit(CYCLE)).cast("int")
    return leg.select("path", "pos", *[F.col(f"leg.{c}").alias(c) for c in SECTION[:3]], face("dep").alias("dep"), face("arr").alias("arr"))


def measured(legs: Column, needs: Column) -> Column:
    """Whether a path holds (``ok``), its minutes (``total``) and the share of rolling in them."""
    at = lambda i: F.get(legs, i)
    changes = F.when(F.size(legs) > 1, F.sequence(F.lit(0), F.size(legs) - 2)).otherwise(F.array().cast("array<int>"))
    kept = F.forall(changes, lambda i: F.when(at(i)["trip"] == at(i + 1)["trip"], at(i + 1)["dep"] >= at(i)["arr"]).otherwise(F.coalesce(at(i + 1)["dep"] >= at(i)["arr"] + F.get(needs, i), F.lit(False))))
    total = (F.element_at(legs, -1)["arr"] - F.element_at(legs, 1)["dep"]).cast("double")
    ok = F.forall(legs, lambda x: x["arr"] >= x["dep"]) & kept & (total > 0)
    return F.struct(ok.alias("ok"), total.alias("total"), F.when(total > 0, leg_times(legs)["rolling"] / total).alias("rolling_share"))


def moved(legs: Column, by: Column) -> Column:
    """The legs, each moved by the minutes that the map ``by`` has for its place."""
    shift = lambda i: F.coalesce(F.element_at(by, i), F.lit(0))
    return F.transform(legs, lambda x, i: F.struct(*[x[c].alias(c) for c in ("line", "trip", "from_station", "to_station")], (x["dep"] + shift(i)).cast("int").alias("dep"), (x["arr"] + shift(i)).cast("int").alias("arr")))


def _moves(hits: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return hits.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("pos", "delta"))).alias(name))


def _once(edits: DataFrame) -> DataFrame:
    """Of edits of one section the last by name counts."""
    return edits.groupBy(*SECTION).agg(F.max_by(F.struct("edit", "delta"), "edit").alias("e")).select(*SECTION, "e.edit", "e.delta")


def touches(index: DataFrame, edits: DataFrame) -> DataFrame:
    """Every leg that an edit moves: ``edit``, ``path``, ``pos``, ``delta``."""
    return index.join(edits.where("delta <> 0").select("edit", *SECTION, "delta"), list(SECTION)).select("edit", "path", "pos", "delta")


def marginal(paths: DataFrame, index: DataFrame, candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """What each candidate changes once the ``accepted`` edits are made.

    ``saved`` is the sum of ``won`` and ``lost`` passenger minutes on the paths
    that still hold; the passengers of those that no longer do are
    ``invalidated``.  Paths that the accepted edits break already do not count.
    A candidate of an accepted edit's section replaces it.  ``paths`` and
    ``index`` come from ``prepared`` and ``sections``; candidates and accepted
    edits have ``edit``, the section and ``delta``.
    """
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))
    own = _moves(touches(index, candidates), ["edit", "path"], "own")
    base = _moves(touches(index, _once(accepted)), ["path"], "base")
    met = paths.join(own.select("path").distinct(), "path", "left_semi").join(base, "path", "left").withColumn("base", F.coalesce("base", none))
    met = met.withColumn("was", measured(moved(F.col("legs"), F.col("base")), F.col("needs"))).where("was.ok")
    both = own.join(met, "path")
    after = F.map_concat(F.map_filter("base", lambda k, v: ~F.map_contains_key(F.col("own"), k)), F.col("own"))
    scored = both.withColumn("now", measured(moved(F.col("legs"), after), F.col("needs")))
    saved = (F.col("was.total") - F.col("now.total")) * F.col("weight")
    holds = F.col("now.ok")
    zero = F.lit(0.0)
    sums = scored.groupBy("edit").agg(
        F.count("*").alias("paths"), F.sum("weight").alias("pax"), F.sum(F.when(holds, saved).otherwise(zero)).alias("saved"),
        F.sum(F.when(holds & (saved > 0), saved).otherwise(zero)).alias("won"), F.sum(F.when(holds & (saved < 0), saved).otherwise(zero)).alias("lost"),
        F.sum(F.when(holds, zero).otherwise(F.col("weight"))).alias("invalidated"), F.count_if(~holds).alias("invalidated_paths"),
        F.sum(F.when(holds, (F.col("now.rolling_share") - F.col("was.rolling_share")) * F.col("weight")).otherwise(zero)).alias("rolling"),
    )
    out = candidates.select("edit").distinct().join(sums, "edit", "left").na.fill(0)
    some = F.col("pax") > 0
    return out.withColumns({"mean_change": F.when(some, -F.col("saved") / F.col("pax")).otherwise(0.0), "rolling_share_change": F.when(some, F.col("rolling") / F.col("pax")).otherwise(0.0)}).drop("rolling")


def combined(paths: DataFrame, index: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ``accepted`` edits at once: one row of totals, and for each edit the paths that it touches and that no longer hold."""
    hits = touches(index, _once(accepted))
    both = paths.join(_moves(hits, ["path"], "by"), "path").withColumn("was", measured(F.col("legs"), F.col("needs"))).where("was.ok")
    scored = both.withColumn("now", measured(moved(F.col("legs"), F.col("by")), F.col("needs"))).select("path", "weight", "was", "now")
    holds, zero = F.col("now.ok"), F.lit(0.0)
    saved = (F.col("was.total") - F.col("now.total")) * F.col("weight")
    totals = scored.agg(
        F.count("*").alias("paths"), F.coalesce(F.sum("weight"), zero).alias("pax"), F.coalesce(F.sum(F.when(holds, saved)), zero).alias("saved"),
        F.coalesce(F.sum(F.when(~holds, F.col("weight"))), zero).alias("invalidated"), F.count_if(~holds).alias("invalidated_paths"),
        F.coalesce(F.sum(F.when(holds, (F.col("now.rolling_share") - F.col("was.rolling_share")) * F.col("weight"))), zero).alias("rolling"),
    )
    some = F.col("pax") > 0
    totals = totals.withColumns({"mean_change": F.when(some, -F.col("saved") / F.col("pax")).otherwise(0.0), "rolling_share_change": F.when(some, F.col("rolling") / F.col("pax")).otherwise(0.0)}).drop("rolling")
    broken = scored.where(~holds).select("path", "weight").join(hits.select("edit", "path").distinct(), "path")
    return totals, broken.groupBy("edit").agg(F.count("*").alias("paths"), F.sum("weight").alias("pax"))


#: Candidates that are tried from one scoring before more are fetched.
TRIED = 32
CHOSEN = "place int, edit string, saved double, combined_saved double, status string"


def best_first(
    paths: DataFrame, index: DataFrame, candidates: DataFrame, events: DataFrame, most: int,
    least: float = 0.0, least_saved: float = 0.0, most_invalidated: float = 0.0, near_weight: float = 0.0, fits: Callable[[list[str], str], bool] | None = None,
) -> DataFrame:
    """Takes edits one by one, each the best under all those before it, until ``most`` or until none is worth it.

    Every round scores all remaining candidates anew (``marginal``) and goes
    through them in order of score (saved minutes and ``near_weight`` of their
    ``near_gain``), saved minutes, passengers, size of the shift and name.  One
    whose event (``events``: ``edit``, ``event``) is used is refused; so is one
    that ``fits`` refuses, a trial of the timetable's structure with the edits
    taken and the new one; so is one after which all together (``combined``)
    invalidate more than ``most_invalidated`` passengers or add less than
    ``least_saved`` minutes or a score under ``least``.  The first that passes is
    taken.  Scores stay distributed; the best ``TRIED`` rows come to the driver
    at a time.  Returns what was taken or refused by a trial, in order.
    """
    spark, taken, out, gone, total = paths.sparkSession, [], [], set(), 0.0
    of = candidates.select("edit", *SECTION, "delta", F.col("near_gain") if "near_gain" in candidates.columns else F.lit(0.0).alias("near_gain"))
    named = lambda names: spark.createDataFrame([(n,) for n in names], "edit string")
    while len(taken) < most:
        accepted = of.join(F.broadcast(named(taken)), "edit", "left_semi")
        used = events.join(F.broadcast(named(taken)), "edit", "left_semi").select("event").distinct()
        overlapping = events.join(used, "event", "left_semi").select("edit").distinct()
        open_ = of.join(F.broadcast(named(sorted(gone | set(taken)))), "edit", "left_anti").join(overlapping, "edit", "left_anti")
        near = F.lit(near_weight) * F.greatest("near_gain", F.lit(0.0))
        scored = marginal(paths, index, open_, accepted).join(open_.select("edit", "delta", near.alias("near")), "edit").withColumn("score", F.col("saved") + F.col("near"))
        fine = scored.where((F.col("score") >= least) & (F.col("saved") >= least_saved) & (F.col("invalidated") <= most_invalidated) & (F.col("pax") > 0))
        order = [F.desc("score"), F.desc("saved"), F.desc("pax"), F.abs("delta"), F.col("edit")]
        best = fine.orderBy(*order).limit(TRIED).collect()
        found = None
        for r in best:
            status = "taken"
            if fits and not fits(taken, r["edit"]):
                status = "structure"
            else:
                row = combined(paths, index, of.join(F.broadcast(named([*taken, r["edit"]])), "edit", "left_semi"))[0].first()
                if row["invalidated"] > most_invalidated:
                    status = "combined invalidated"
                elif row["saved"] - total < least_saved or row["saved"] - total + r["near"] < least:
                    status = "combined effect"
            if status == "taken":
                found, total = r["edit"], row["saved"]
                out.append((len(taken) + 1, r["edit"], r["saved"], total, status))
                taken.append(found)
                break
            gone.add(r["edit"])
            out.append((None, r["edit"], r["saved"], None, status))
        if not found and len(best) < TRIED:
            break
    return spark.createDataFrame(out, CHOSEN)


def trial(rows: DataFrame, edits: DataFrame) -> Callable[[list[str], str], bool]:
    """A structural trial for ``best_first``: whether a new edit applies after those taken and leaves its segments' runs as they are.

    ``rows`` and ``edits`` are a timetable and its edits as ``timetable.matched``
    takes them; only the segments of the new edit are expanded again.
    """
    from . import timetable

    def fits(taken: list[str], new: str) -> bool:
        here = rows.join(edits.where(F.col("edit") == new).select("segment").distinct(), "segment", "left_semi")
        place = {name: i for i, name in enumerate([*taken, new])}
        order = F.create_map(*[x for k, v in place.items() for x in (F.lit(k), F.lit(v))])
        made = edits.where(F.col("edit").isin(list(place))).withColumn("rank", order[F.col("edit")])
        made = made.join(here.select("segment").distinct(), "segment", "left_semi")
        if not timetable.matched(here, made).where((F.col("edit") == new) & (F.col("status") == "applied")).limit(1).count():
            return False
        return not timetable.compatibility(here, timetable.edited(here, made).drop("edit")).where("reason <> ''").limit(1).count()

    return fits
