"""Timetable expansion: active rows, tokens to occurrences, chained trips, signatures, boards, line timings, slack, edits.

A segment is an ordered array of rows (``seq``, ``station``, ``kind``, ``token``).
Spark deals the segments to tasks; ``expansion`` makes the trips of many at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import expansion
from .sequences import trimmed

#: Fixed bounds of the service day, in minutes.
DAY_START, DEPARTURE_END, ARRIVAL_END, HOURS = 300, 1440, 1560, (5, 26)
DWELL_MOST = 15
BOUNDS = (DAY_START, DEPARTURE_END, ARRIVAL_END, HOURS, DWELL_MOST)
#: Fixed: line timings show runs that leave from 05:00 to before 07:00.
SHOWN = (300, 420)
EVENT = "struct<station:string,kind:string,minute:int>"


def _spread(rows: DataFrame, segment: str) -> DataFrame:
    """Little data, much work: as many tasks as the session has shuffle partitions, and no further exchange below."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), segment)


def active_rows(wide: DataFrame, years: list[str], ids: list[str]) -> DataFrame:
    """One row for each year column whose cell is a token, from the first departure to the last arrival of the segment.

    ``wide``: ``segment``, ``seq``, ``station``, ``kind`` and the year columns.
    """
    # Dealt by segment before a row becomes one for each year; what follows goes by segment and needs no other exchange.
    wide = _spread(wide, "segment")
    cells = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"`{y}`").alias("raw")) for y in years])).alias("cell")
    long = wide.select(*ids, cells).select(*ids, "cell.*").withColumns({"token": S.token("raw"), "kind": F.lower(F.trim("kind"))})
    return trimmed(long.where("token IS NOT NULL AND kind IN ('an', 'ab')"), ["segment", "year"], "seq", "kind")


def occurrences(token: Column, kind: Column) -> Column:
    """All minutes of a token within the service day."""
    t = F.transform(
        F.filter(F.sequence(F.lit(HOURS[0]), F.lit(HOURS[1])), lambda h: (token["parity"] == "all") | ((token["parity"] == "even") == (h % 2 == 0))), lambda h: h * 60 + token["minute"]
    )
    return F.filter(t, lambda x: (x >= DAY_START) & F.when(kind == "ab", x < DEPARTURE_END).otherwise(x <= ARRIVAL_END))


def _collected() -> Column:
    """A segment's rows in order, as ``expansion`` takes them; ``odd``: 1 odd hours, 0 even ones, -1 all."""
    token = F.col("token")
    odd = F.when(token["parity"] == "all", -1).when(token["parity"] == "even", 0).otherwise(1)
    row = F.struct("seq", "station", "kind", token["minute"].alias("minute"), odd.alias("odd"), token["p"].alias("p"), token["q"].alias("q"))
    return F.array_sort(F.collect_list(F.when(token.isNotNull(), row)))


def trips(rows: DataFrame, segment: str = "segment", until: int | None = None) -> DataFrame:
    """Trips of each segment: every departure row starts one at each of its minutes, before ``until`` only if that is given.

    ``rows`` (active ones): segment, ``seq``, ``station``, ``kind`` (``an`` or
    ``ab``), ``token``.  A trip ends before a departure at which it would turn
    back or stand longer than the longest dwell, and where no minute follows;
    one that does not end in an arrival is none.  Returns segment,
    ``start_seq``, ``start``, ``events``.
    """
    table = _spread(rows.where("token IS NOT NULL"), segment).groupBy(F.col(segment).alias("segment")).agg(_collected().alias("rows"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = table.mapInArrow(expansion.expanded(BOUNDS, until), f"segment {kind[segment]}, start_seq {kind['seq']}, start int, events array<{EVENT}>")
    return made.withColumnRenamed("segment", segment)


def signature(events: Column) -> Column:
    return F.array_join(F.transform(events, lambda e: F.concat_ws("::", e["station"], e["kind"], e["minute"].cast("string"))), "|")


def distinct_trips(df: DataFrame, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One trip of each signature (its stations, kinds and minutes), within ``keys`` if any, the first in order, with a short id."""
    out = df.withColumn("trip", F.substring(F.sha1(signature(F.col("events"))), 1, 16))
    return out.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "trip").orderBy(*order))).where("__n = 1").drop("__n")


def board_rows(df: DataFrame, hubs: list[str], low: int, high: int, line: str = "segment") -> DataFrame:
    """The arrival and departure boards of hub stations from ``low`` to before ``high``.

    Each event with the nearest different station before and after it on its
    trip, once for each station, kind, minute, line and both neighbours; a row
    without a neighbour goes where the same line, minute and direction has one.
    """
    e = df.select(line, "events", F.posexplode("events").alias("pos", "e")).where(F.col("e.station").isin(hubs) & (F.col("e.minute") >= low) & (F.col("e.minute") < high))
    other = lambda part: F.filter(F.transform(part, lambda x: x["station"]), lambda s: s != F.col("e.station"))
    named = e.select(
        F.col(line).alias("line"), F.col("e.station").alias("station"), F.when(F.col("e.kind") == "an", "arrival").otherwise("departure").alias("board"), F.col("e.minute").alias("minute"),
        F.coalesce(F.get(F.reverse(other(F.slice("events", F.lit(1), F.col("pos")))), 0), F.lit("")).alias("previous"),
        F.coalesce(F.get(other(F.slice("events", F.col("pos") + 2, F.size("events"))), 0), F.lit("")).alias("following"),
    ).distinct()
    parts = []
    for board, by, side in (("departure", "following", "previous"), ("arrival", "previous", "following")):
        some = F.bool_or(F.col(side) != "").over(Window.partitionBy("station", "minute", "line", by))
        parts.append(named.where(F.col("board") == board).withColumn("__some", some).where((F.col(side) != "") | ~F.col("__some")).drop("__some"))
    return parts[0].unionByName(parts[1])


def line_timings(df: DataFrame, line: str = "segment") -> DataFrame:
    """For each line and section the runs that leave within the shown hours: ``departures`` and ``arrivals`` as lists of clock times."""
    e = df.select(line, F.posexplode("events").alias("pos", "a"), "events").withColumn("b", F.get("events", F.col("pos") + 1))
    runs = e.where((F.col("a.kind") == "ab") & (F.col("b.kind") == "an") & (F.col("a.minute") >= SHOWN[0]) & (F.col("a.minute") < SHOWN[1]))
    clocks = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda m: S.clock_text(m)), ", ")
    return runs.groupBy(F.col(line).alias("line"), F.col("a.station").alias("from_station"), F.col("b.station").alias("to_station")).agg(clocks("a.minute").alias("departures"), clocks("b.minute").alias("arrivals"))


def slack(df: DataFrame, trip: str, order: list[str]) -> DataFrame:
    """How far the section to the next stop may move: earlier by the dwell before it, later by the dwell after; null is unbounded.

    ``df``: one row per stop with ``arr`` and ``dep``.
    """
    by = Window.partitionBy(trip).orderBy(*order)
    return df.withColumns({
        "earlier": F.when(F.lag(F.lit(1)).over(by).isNotNull(), F.col("dep") - F.col("arr")),
        "later": F.when(F.lead(F.lit(1), 2).over(by).isNotNull(), F.lead("dep").over(by) - F.lead("arr").over(by)),
        "to_stop": F.lead(F.lit(1)).over(by),
    }).where("to_stop IS NOT NULL").drop("to_stop")


def matched(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Each edit with every section it names, and its ``status``.

    ``edits``: ``edit``, ``rank``, ``segment``, ``from_station``, ``to_station``,
    ``dep`` and ``arr`` (clockface minutes of 120, from 05:00), ``delta``.  A
    section is a departure row and the arrival row next to it whose tokens
    stand at those minutes.  Edits apply in order of rank: one that shares a row
    with an earlier match is ``stale``, one without a section ``unmatched``.
    """
    some = F.max(F.col("from_seq").isNotNull()).over(Window.partitionBy("edit"))
    return _found(rows, edits).withColumn("__some", some).where("from_seq IS NOT NULL OR NOT __some").drop("__some")


def _found(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``matched`` where an edit also has a row without a section beside those with one."""
    by = Window.partitionBy("segment").orderBy("seq")
    pair = rows.withColumns({"to_seq": F.lead("seq").over(by), "__to": F.lead("station").over(by), "__kind": F.lead("kind").over(by), "__faces": F.lead(S.token_faces("token")).over(by)})
    pair = pair.where("kind = 'ab' AND __kind = 'an'").select("segment", F.col("station").alias("from_station"), F.col("__to").alias("to_station"), F.col("seq").alias("from_seq"), "to_seq", S.token_faces("token").alias("__dep"), F.col("__faces").alias("__arr"))
    found = edits.join(pair, ["segment", "from_station", "to_station"], "left")
    hit = F.coalesce(F.array_contains("__dep", F.col("dep")) & F.array_contains("__arr", F.col("arr")), F.lit(False))
    found = found.select("edit", "rank", "segment", "delta", F.when(hit, F.col("from_seq")).alias("from_seq"), F.when(hit, F.col("to_seq")).alias("to_seq")).distinct()
    first = F.min("rank").over(Window.partitionBy("segment", "from_seq"))  # a departure row and its arrival row always go together
    return found.withColumn("status", F.when(F.col("from_seq").isNull(), "unmatched").when(F.col("rank") > first, "stale").otherwise("applied"))


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The timetable after the edits that apply: both tokens of a section shift by its ``delta``; ``edit`` names it, or is null."""
    return applied(rows, _found(rows, edits))


def applied(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``edited`` with the edits as ``matched`` gives them."""
    return _moved(rows, found).withColumn("token", F.coalesce("moved", "token")).drop("moved")


def _moved(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the ``edit`` that applies and the token it makes, ``moved``; both are null where none does."""
    moves = found.where("status = 'applied'").select("segment", F.explode(F.array("from_seq", "to_seq")).alias("seq"), "edit", "delta")
    out = rows.join(moves, ["segment", "seq"], "left")
    return out.withColumn("moved", F.when(F.col("delta").isNotNull(), S.token_shifted("token", F.col("delta")))).drop("delta")


def structure(rows: DataFrame) -> DataFrame:
    """By segment: number of trips, their shapes (events and running times) with how many trips have each, the extreme dwells, and whether rows alternate."""
    # The kinds of all rows, also of those without a token.
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda r: r["kind"])
    table = _spread(rows, "segment").groupBy("segment").agg(_collected().alias("rows"), kinds.alias("kinds"))
    alternates = F.forall(F.transform("kinds", lambda k, i: (k == "ab") == (i % 2 == 0)), lambda ok: ok)
    table = table.select("segment", "rows", alternates.alias("alternates"), (F.element_at("kinds", -1) == "an").alias("ends"))
    kind = rows.schema["segment"].dataType.simpleString()
    made = table.mapInArrow(expansion.shaped(BOUNDS), f"segment {kind}, alternates boolean, ends boolean, n long, low int, high int, shapes array<struct<shape:string,n:bigint>>")
    return made.withColumn("shapes", F.array_sort("shapes"))


def compatibility(before: DataFrame, after: DataFrame) -> DataFrame:
    """By segment, what an edited timetable changes beyond times: ``reason``, empty where it keeps its runs.

    Both hold active rows.  The number of trips, the multiset of their events
    and running times, and dwells of 0 to ``DWELL_MOST`` minutes must stay.
    """
    return judged(structure(before), structure(after))


def judged(before: DataFrame, after: DataFrame) -> DataFrame:
    """``compatibility`` of what ``structure`` gives of both."""
    b, a = (x.select("segment", F.struct("alternates", "ends", "n", "shapes", "low", "high").alias(n)) for x, n in ((before, "b"), (after, "a")))
    both = b.join(a, "segment", "full")
    reason = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "presence").when(~(F.col("a.alternates") & F.col("a.ends")), "sequence").when(F.col("a.n") != F.col("b.n"), "count")
        .when(~F.col("a.shapes").eqNullSafe(F.col("b.shapes")), "structure").when((F.col("a.low") < 0) | (F.col("a.high") > DWELL_MOST), "dwell").otherwise("")
    )
    return both.select("segment", reason.alias("reason"))


def composed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The final timetable: the edits that apply, but for segments that they would leave incompatible, which stay as they were."""
    both = _moved(rows, _found(rows, edits))
    after = both.withColumn("token", F.coalesce("moved", "token")).drop("moved", "edit")
    bad = compatibility(rows, after).where("reason <> ''").select("segment", "reason")
    stays = F.col("reason").isNotNull()
    out = both.join(bad, "segment", "left").withColumns({"token": F.when(stays, F.col("token")).otherwise(F.coalesce("moved", "token")), "edit": F.when(~stays, F.col("edit"))})
    return out.withColumn("reason", F.coalesce("reason", F.lit(""))).drop("moved")
