"""Timetable edits: candidates, net impact, state-dependent scores, greedy and best-first selection, exact path scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.inputs import shared_folder
from . import timetable
from .joins import bounded
from .ordering import kept
from .routing import leg_times

#: Fixed: minutes lost with a broken transfer, on top of the wait (an hour to the next connection).
BROKEN = 60


def improvements(transfers: DataFrame, most: int) -> DataFrame:
    """Shifts that shorten transfers: δ is the least of the allowed shift, what can be reduced, and the slack.

    ``transfers``: ``wait``, ``least`` (transfer minutes), ``earlier`` (slack of
    the departing section), ``later`` (of the arriving one); null slack is unbounded.
    """
    reducible = F.col("wait") - F.col("least")
    rows = transfers.withColumn("action", F.explode(F.array(F.lit("depart earlier"), F.lit("arrive earlier"))))
    room = F.when(F.col("action") == "depart earlier", F.col("earlier")).otherwise(F.col("later"))
    delta = F.least(F.lit(most), reducible, F.coalesce(room, F.lit(most)))
    return rows.withColumn("delta", -delta).where(delta > 0)


def unlocks(misses: DataFrame, most: int) -> DataFrame:
    """Shifts that make a near miss a transfer: ``gap`` minutes lie between, ``least`` are needed."""
    rows = misses.withColumn("action", F.explode(F.array(F.lit("depart later"), F.lit("arrive earlier"))))
    need = F.col("least") - F.col("gap")
    room = F.when(F.col("action") == "depart later", F.col("later")).otherwise(F.col("earlier"))
    return rows.withColumn("delta", F.when(F.col("action") == "depart later", need).otherwise(-need)).where((need > 0) & (need <= most) & (need <= F.coalesce(room, F.lit(most))))


def shift_grid(sections: DataFrame, most: int = 10) -> DataFrame:
    """A row for every shift ``delta`` of each section, from ``-most`` to ``most`` without 0, that its slack allows.

    ``sections``: ``earlier`` and ``later``, the minutes of slack; null is unbounded, negative is none.
    """
    room = lambda c: F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(c, F.lit(most)))).cast("int")
    grid = F.filter(F.sequence(-room("earlier"), room("later")), lambda d: d != 0)
    return sections.withColumn("delta", F.explode(grid))


def net_impact(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Per candidate: passenger minutes won and lost, counts by outcome, and passengers of broken transfers.

    ``effects``: ``source`` (``existing`` or ``near``), ``side`` that moves
    (``departure`` or ``arrival``), ``wait``, ``least``, ``delta``, ``pax``.  An
    existing transfer wins what its wait loses, and when broken loses what was
    cut; a near miss wins by each minute that its shortfall closes.
    """
    new = F.col("wait") + F.when(F.col("side") == "departure", F.col("delta")).otherwise(-F.col("delta"))
    short = lambda wait: F.greatest(F.lit(0), F.col("least") - wait)
    closed = F.greatest(F.lit(0), short(F.col("wait")) - short(F.col("new")))
    kind = (
        F.when(F.col("source") == "near", F.when(closed == 0, "unhelped").when(short(F.col("new")) == 0, "unlocked").otherwise("partly"))
        .when(F.col("new") < F.col("least"), "broken").when(F.col("new") < F.col("wait"), "improved").when(F.col("new") > F.col("wait"), "worsened").otherwise("unchanged")
    )
    gain = F.col("pax") * F.when(F.col("source") == "near", closed).when(F.col("new") < F.col("least"), -F.greatest(F.lit(0), F.col("wait") - F.col("new"))).otherwise(F.col("wait") - F.col("new"))
    out = effects.withColumn("new", new).withColumns({"kind": kind, "gain": gain})
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("improved", "worsened", "broken", "unlocked", "partly")]
    return out.groupBy(*keys).agg(
        *counts, F.sum("gain").alias("net"), F.sum(F.greatest("gain", F.lit(0.0))).alias("won"), F.sum(F.least("gain", F.lit(0.0))).alias("lost"),
        F.sum(F.when(F.col("kind") == "broken", F.col("pax")).otherwise(0.0)).alias("broken_pax"),
    )


def contribution(now: Column, of: Callable[[str], Column] = F.col) -> Column:
    """What an effect contributes at a wait of ``now`` minutes; a broken transfer costs its shortfall and an hour."""
    short = lambda wait: F.greatest(F.lit(0), of("least") - wait)
    existing = F.when(now < of("least"), -(of("least") - now + BROKEN)).otherwise(of("wait") - now)
    return of("pax") * F.when(of("source") == "near", short(of("wait")) - short(now)).otherwise(existing)


def touched(effects: DataFrame, probes: DataFrame) -> DataFrame:
    """Each candidate with the effects whose arrival or departure event it moves: ``by``, the change of the wait.

    ``effects``: ``effect``, ``source``, ``arr_key``, ``dep_key``, ``wait``,
    ``least``, ``pax``; ``probes``: ``candidate``, ``key``, ``delta`` for the
    events that it moves.
    """
    moved = probes.groupBy("candidate", "key").agg(F.sum("delta").alias("delta"))
    own = ["effect", "source", "arr_key", "dep_key", "wait", "least", "pax"]
    ends = [moved.join(effects.select(own), F.col("key") == F.col(side)).withColumn("by", F.col("delta") * sign) for side, sign in (("dep_key", 1), ("arr_key", -1))]
    # Dealt by candidate alone: what gathers a candidate's effects needs no other exchange.
    return ends[0].unionByName(ends[1]).repartition("candidate").groupBy("candidate", *own).agg(F.sum("by").alias("by"))


def marginal(touch: DataFrame, shifts: DataFrame) -> DataFrame:
    """Each candidate's change of the objective under the shifts made so far (``key``, ``shift``), and passengers of transfers broken after it."""
    side = lambda k: shifts.select(F.col("key").alias(k), F.col("shift").alias(f"__{k}"))
    state = touch.join(side("arr_key"), "arr_key", "left").join(side("dep_key"), "dep_key", "left")
    now = F.col("wait") + F.coalesce("__dep_key", F.lit(0)) - F.coalesce("__arr_key", F.lit(0))
    after = now + F.col("by")
    broken = (F.col("source") == "existing") & (after < F.col("least"))
    return state.groupBy("candidate").agg(F.sum(contribution(after) - contribution(now)).alias("marginal"), F.sum(F.when(broken, F.col("pax")).otherwise(0.0)).alias("broken_pax"))


def gathered(effects: DataFrame, probes: DataFrame) -> DataFrame:
    """A row for each candidate of ``probes``: ``effects``, all that it touches in order, and ``moves``, the ``delta`` of each of its events."""
    touch = touched(effects, probes)
    whole = touch.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct(*[c for c in touch.columns if c != "candidate"]))).alias("effects"))
    moved = probes.groupBy("candidate", "key").agg(F.sum("delta").alias("delta"))
    moves = moved.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("key", "delta"))).alias("moves"))
    return moves.join(whole, "candidate", "left").withColumn("effects", F.coalesce("effects", F.array().cast(whole.schema["effects"].dataType)))


def scores(shifts: Column | None = None) -> list[Column]:
    """``marginal`` and ``broken_pax`` of a row that ``gathered`` gives, under a map from events to their shifts."""
    by = lambda key: F.lit(0) if shifts is None else F.coalesce(F.element_at(shifts, key), F.lit(0))
    total = lambda term: F.aggregate("effects", F.lit(0.0), lambda s, x: s + F.coalesce(term(x, x["wait"] + by(x["dep_key"]) - by(x["arr_key"])).cast("double"), F.lit(0.0)))
    gain = total(lambda x, now: contribution(now + x["by"], x.getField) - contribution(now, x.getField))
    broken = total(lambda x, now: F.when((x["source"] == "existing") & (now + x["by"] < x["least"]), x["pax"]))
    return [gain.alias("marginal"), broken.alias("broken_pax")]


def stored(df: DataFrame, at: str, *by: str) -> DataFrame:
    """``df`` written to the folder ``at``, partitioned by the columns ``by``, and read back."""
    df.write.partitionBy(*by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def levels(links: DataFrame, at: str) -> tuple[DataFrame, int]:
    """``candidate`` and ``level`` of those that wait for another, and the number of levels; the others' level is 0.

    ``links``: ``candidate``, ``rank``, ``link``.  A candidate's level is above
    those of all of lower rank that share a link with it.  As each waits for the
    one before it on a link, a link of many is as many rows, not their pairs.
    """
    before = F.lag("candidate").over(Window.partitionBy("link").orderBy("rank", "candidate"))
    waits = links.where("link IS NOT NULL").withColumn("after", before).where("after <> candidate").select("candidate", "after").distinct()
    waits, found = stored(waits, f"{at}/waits-0"), []
    while not waits.isEmpty():
        held = waits.select("candidate").distinct()
        found.append(held.withColumn("level", F.lit(len(found) + 1)))
        waits = stored(waits.join(held.withColumnRenamed("candidate", "after"), "after", "left_semi").select("candidate", "after"), f"{at}/waits-{len(found)}")
    out = links.sparkSession.createDataFrame([], "candidate long, level int")
    for f in found:
        out = out.unionByName(f)
    return out.groupBy("candidate").agg(F.max("level").alias("level")), len(found) + 1


def greedy(
    effects: DataFrame, probes: DataFrame, ranks: DataFrame, least: float = 0.0, allow_broken: float = 0.0, passes: int = 8, most: int = 0,
    apart: DataFrame | None = None, refused: Callable[[DataFrame, DataFrame], DataFrame] | None = None, rows: DataFrame | None = None,
) -> DataFrame:
    """First-fit selection in order of rank, each candidate scored under all that were accepted before it.

    ``ranks``: ``candidate`` (long), ``rank`` (each once).  A candidate that
    breaks more than ``allow_broken`` passengers' transfers, or one of whose
    events an accepted one has moved, is refused for good; one that gains no more
    than ``least`` is deferred to the next pass; passes end when one accepts
    nothing.  ``refused`` is a trial application: of those about to be accepted
    (``candidate``), after those that are, it gives the ones that the timetable
    does not take; they are refused for good too.  ``apart`` (``candidate``,
    ``link``) names what the trials of two candidates would share, their
    segments say.  ``rows`` is what ``gathered`` gives, if it is there already.
    Returns ``candidate``, ``rank``, ``status``, ``pass``, ``marginal``.

    The order is that of one candidate after the other, the work is not: a
    candidate may be decided as soon as all of lower rank that share an effect,
    event or link with it are, so candidates have levels, which are the same in
    each pass, and those of a level are decided at once.  A candidate is one row
    with all that it touches, and rows are stored by level: a pass reads and
    exchanges each once.  Acceptances never change earlier decisions, hence
    ``most`` keeps the first ones in order of pass and rank.
    """
    spark, at = effects.sparkSession, shared_folder(effects.sparkSession, "selection")
    rows = gathered(effects, probes) if rows is None else rows
    kinds = {c: rows.schema[c].dataType for c in ("effects", "moves")}
    rows = ranks.join(rows, "candidate", "left").select("candidate", "rank", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in kinds.items()])
    rows = stored(rows, f"{at}/whole")
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    named = F.concat(F.transform("effects", lambda x: name("e", x["effect"])), F.transform("moves", lambda m: name("k", m["key"])))
    links = rows.select("candidate", "rank", F.explode(named).alias("link"))
    if apart is not None:
        links = links.unionByName(apart.join(rows.select("candidate", "rank"), "candidate").select("candidate", "rank", name("s", F.col("link")).alias("link")))
    level, depth = levels(links, at)
    rows = stored(rows.join(level, "candidate", "left").na.fill(0, ["level"]), f"{at}/rows", "level")
    keys = F.array_distinct(F.concat(F.transform("effects", lambda x: x["dep_key"]), F.transform("effects", lambda x: x["arr_key"]), F.transform("moves", lambda m: m["key"])))
    stale = F.coalesce(F.exists("moves", lambda m: F.element_at("shifts", m["key"]).isNotNull()), F.lit(False))
    marginal_, broken = scores(F.col("shifts"))
    status = F.when(F.col("broken_pax") > allow_broken, "breaks").when(F.col("marginal") <= least, "deferred").when(F.col("stale"), "stale").otherwise("accepted")
    own = ["candidate", "rank", "status", "marginal", "moves"]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    decision = f"candidate {kind['candidate']}, rank {kind['rank']}, status string, marginal double, moves {kind['moves']}, pass int, level int"
    empty = spark.createDataFrame([], decision)
    decided, open_levels = empty, list(range(depth))
    for turn in range(1, passes + 1):
        open_ = decided.where((F.col("pass") == turn - 1) & (F.col("status") == "deferred"))
        for n in open_levels:
            here = rows.where(F.col("level") == n)
            if turn > 1:
                here = here.join(open_.where(F.col("level") == n).select("candidate"), "candidate", "left_semi")
            taken = decided.where("status = 'accepted'")
            shifts = taken.select(F.explode("moves").alias("m")).groupBy(F.col("m.key").alias("key")).agg(F.sum("m.delta").alias("shift"))
            state = here.select("candidate", F.explode(keys).alias("key")).join(shifts, "key").groupBy("candidate").agg(F.map_from_entries(F.collect_list(F.struct("key", "shift"))).alias("shifts"))
            scored = here.join(state, "candidate", "left").select("candidate", "rank", "moves", marginal_, broken, stale.alias("stale")).na.fill(0.0, ["marginal", "broken_pax"])
            scored = scored.withColumn("status", status).select(own)
            if refused:
                scored = stored(scored, f"{at}/asked/pass={turn}/level={n}")
                bad = refused(taken.select("candidate"), scored.where("status = 'accepted'").select("candidate")).select("candidate").distinct().withColumn("__bad", F.lit(True))
                scored = scored.join(bad, "candidate", "left").withColumn("status", F.when(F.col("__bad"), "structure").otherwise(F.col("status"))).select(own)
            scored.write.parquet(f"{at}/decided/pass={turn}/level={n}")
            decided = spark.read.schema(decision).parquet(f"{at}/decided")
        count = lambda s: F.count_if(F.col("status") == s).alias(s)
        found = decided.where(F.col("pass") == turn).groupBy("level").agg(count("accepted"), count("deferred")).collect()
        open_levels = sorted(r["level"] for r in found if r["deferred"])
        if not sum(r["accepted"] for r in found) or not open_levels:
            break
    # A candidate that was deferred has a row in each pass; the last one counts.
    out = decided.where((F.col("status") != "deferred") | (F.col("pass") == turn))
    if most:
        early = out.where("status = 'accepted'").orderBy("pass", "rank").limit(most).select("candidate", F.lit(True).alias("__early"))
        out = out.join(early, "candidate", "left").withColumn("status", F.when((F.col("status") == "accepted") & F.col("__early").isNull(), "over the cap").otherwise(F.col("status"))).drop("__early")
    return out.select("candidate", "rank", "status", "pass", "marginal")


#: New candidates up to which their segments go to all tasks, which then exchange no rows of others.
BROADCAST_NEW = 200_000


def trial(rows: DataFrame, edits: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A trial application for ``greedy``: of the new candidates, those whose edit finds no section after the ones taken, or changes its segment's runs.

    ``rows`` and ``edits`` are a timetable and its edits as ``timetable.matched``
    takes them, ``edit`` being the candidate.  Only segments with edits are
    stored, and only those of the new candidates are expanded again; ``greedy``
    has to keep candidates of one segment ``apart``.
    """
    at = shared_folder(rows.sparkSession, "trials")
    edits = stored(edits, f"{at}/edits")
    rows = stored(rows.join(edits.select("segment").distinct(), "segment", "left_semi"), f"{at}/rows")
    runs = stored(timetable.structure(rows), f"{at}/runs")

    def refused(taken: DataFrame, new: DataFrame) -> DataFrame:
        some = new.limit(BROADCAST_NEW + 1).count()
        if not some:
            return new
        few = some <= BROADCAST_NEW
        among = lambda df, these, key: df.join(F.broadcast(these) if few else these, key, "left_semi")
        asked = kept(among(edits, new.withColumnRenamed("candidate", "edit"), "edit").withColumn("rank", F.lit(1)))
        here = asked.select("segment").distinct()
        before = among(edits, here, "segment").join(taken.withColumnRenamed("candidate", "edit"), "edit", "left_semi").withColumn("rank", F.lit(0))
        lines = among(rows, here, "segment")
        found = kept(timetable.matched(lines, before.unionByName(asked)))
        status = among(found, asked.select("edit"), "edit")
        idle = status.groupBy("edit").agg(F.max(F.col("status") == "applied").alias("applies")).where("NOT applies").select("edit")
        after = timetable.structure(timetable.applied(lines, found).drop("edit"))
        bad = timetable.judged(among(runs, here, "segment"), after).where("reason <> ''").select("segment")
        broken = asked.join(bad, "segment", "left_semi").select("edit")
        return idle.unionByName(broken).distinct().withColumnRenamed("edit", "candidate")

    return refused


def capped(scored: DataFrame, events: DataFrame, caps: dict[str, int], total: int) -> DataFrame:
    """The candidates taken in order of rank, at most ``total``: each unless one of its events is used or one of its caps is full.

    ``scored``: ``candidate`` (long), ``rank`` and the columns that ``caps``
    name (each of whose values may be taken so many times); ``events``:
    ``candidate``, ``event``.  Candidates stream to the driver in order, and it
    keeps what it has taken and nothing else, so ``total`` bounds it.
    """
    names = sorted(caps)
    rows = scored.select("candidate", "rank", *names).join(events.groupBy("candidate").agg(F.collect_set("event").alias("events")), "candidate", "left").orderBy("rank")
    counts, used, taken = {}, set(), []
    for r in rows.toLocalIterator():
        if used.intersection(r["events"] or ()) or any(counts.get((n, r[n]), 0) >= caps[n] for n in names):
            continue
        used.update(r["events"] or ())
        for n in names:
            counts[n, r[n]] = counts.get((n, r[n]), 0) + 1
        taken.append((r["candidate"],))
        if len(taken) == total:
            break
    return scored.join(F.broadcast(scored.sparkSession.createDataFrame(taken, "candidate long")), "candidate", "left_semi")


def best_first(effects: DataFrame, probes: DataFrame, most: int, least: float = 0.0) -> list[tuple]:
    """Selects candidates one by one, scoring all anew under the shifts made; ends after ``most`` or below ``least``.

    Each round is one distributed scoring; only its best row and that one's events come to the driver.
    """
    spark, chosen, shifts = effects.sparkSession, [], {}
    touch = kept(touched(effects, probes))
    schema = f"key {probes.schema['key'].dataType.simpleString()}, shift long"
    for _ in range(most):
        table = spark.createDataFrame(list(shifts.items()), schema)
        rest = touch.where(~F.col("candidate").isin([c for c, _ in chosen])) if chosen else touch
        best = marginal(rest, table).where("broken_pax = 0").orderBy(F.desc("marginal"), "candidate").limit(1).collect()
        if not best or best[0]["marginal"] <= least:
            break
        name = best[0]["candidate"]
        chosen.append((name, best[0]["marginal"]))
        for r in probes.where(F.col("candidate") == name).groupBy("key").agg(F.sum("delta").alias("d")).collect():
            shifts[r["key"]] = shifts.get(r["key"], 0) + r["d"]
    return chosen


def shifted_paths(paths: DataFrame, shifts: DataFrame, least: int = 0) -> DataFrame:
    """Paths (``path``, ``legs``, ``weight``) under shifts of trips (``trip``, ``shift``): feasibility and change of time.

    The shifts become one map (a bounded set of edits), so a path stays one row.
    """
    moves = bounded(shifts).agg(F.map_from_entries(F.collect_list(F.struct("trip", "shift"))).alias("moves"))
    out = paths.crossJoin(F.broadcast(moves))
    by = lambda x: F.coalesce(F.element_at("moves", x["trip"]), F.lit(0))
    new = F.transform("legs", lambda x: F.struct(x["from_station"].alias("from_station"), x["to_station"].alias("to_station"), (x["dep"] + by(x)).cast("int").alias("dep"), (x["arr"] + by(x)).cast("int").alias("arr"), x["trip"].alias("trip")))
    out = out.withColumn("moved", new)
    ok = F.forall(F.when(F.size("moved") > 1, F.sequence(F.lit(0), F.size("moved") - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.get("moved", i + 1)["dep"] - F.get("moved", i)["arr"] >= F.when(F.get("moved", i + 1)["trip"] == F.get("moved", i)["trip"], 0).otherwise(least))
    total = lambda c: F.element_at(c, -1)["arr"] - F.element_at(c, 1)["dep"]
    return out.withColumns({"feasible": ok, "change": total("moved") - total("legs"), "times": leg_times(F.col("moved"))}).drop("moves")


def inverse(edits: DataFrame) -> DataFrame:
    """The edits that undo ``edits`` (``edit``, ``dep``, ``arr`` clockface minutes, ``delta``), from where these left their sections."""
    moved = lambda c: F.pmod(F.col(c) + F.col("delta"), F.lit(120))
    return edits.withColumns({"edit": F.concat(F.lit("undo "), F.col("edit")), "dep": moved("dep"), "arr": moved("arr")}).withColumn("delta", -F.col("delta"))


def impacted(legs: DataFrame, edits: DataFrame) -> DataFrame:
    """The legs of paths that ride an edited section at its old or its new minutes: ``edit`` and the columns of ``legs``.

    ``legs`` and ``edits`` have ``line``, ``from_station``, ``to_station``, ``dep``, ``arr``; minutes count modulo 120.
    """
    both = edits.select("edit", "line", "from_station", "to_station", F.explode(F.array(F.lit(0), F.col("delta"))).alias("__by"), F.col("dep").alias("__d"), F.col("arr").alias("__a"))
    at = both.select("edit", "line", "from_station", "to_station", F.pmod(F.col("__d") + F.col("__by"), F.lit(120)).alias("__dep"), F.pmod(F.col("__a") + F.col("__by"), F.lit(120)).alias("__arr")).distinct()
    face = legs.withColumns({"__dep": F.pmod("dep", F.lit(120)), "__arr": F.pmod("arr", F.lit(120))})
    return face.join(at, ["line", "from_station", "to_station", "__dep", "__arr"]).drop("__dep", "__arr")


def attribution(hits: DataFrame, cells: DataFrame, cell: str, values: list[str], weight: str) -> DataFrame:
    """By edit: the cells it touches, their passengers and weighted mean changes; a cell counts for each of its edits, once.

    ``hits``: ``edit`` and the cell; ``cells``: the cell, ``weight`` and changes.
    """
    rows = hits.select("edit", cell).distinct().join(cells, cell)
    total = F.sum(weight)
    return rows.groupBy("edit").agg(F.count("*").alias("cells"), total.alias("pax"), *[(F.sum(F.col(v) * F.col(weight)) / F.nullif(total, F.lit(0.0))).alias(f"mean_{v}") for v in values])
