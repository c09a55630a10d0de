"""Queries of timetable expansion and editing, on a timetable of all events.

The SQL follows the rules as they are written down, not the Spark expressions:
lists of occurrences, and one recursive step for each event of a trip.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import timetable as T
from ..operators.ordering import kept
from . import inputs as I
from .registry import add

TOKEN = r"'^\s*(\d{1,2})\s*([inIN]?)\s*([Pp]?)\s*([Qq]?)\s*$'"
#: Tokens of both years, then active rows: from the first departure to the last arrival of a segment.
ACTIVE = f"""{I.TIMETABLE}, cells AS (
  SELECT segment, seq, station, kind, '2026' AS year, y2026 AS raw FROM timetable UNION ALL SELECT segment, seq, station, kind, '2035', y2035 FROM timetable),
tokens AS (
  SELECT *, CAST(regexp_extract(raw, {TOKEN}, 1) AS INT) AS m, lower(regexp_extract(raw, {TOKEN}, 2)) AS half, regexp_extract(raw, {TOKEN}, 3) <> '' AS p, regexp_extract(raw, {TOKEN}, 4) <> '' AS q FROM cells WHERE regexp_matches(raw, {TOKEN})),
active AS (SELECT * FROM tokens WHERE m <= 59 QUALIFY seq >= min(CASE WHEN kind = 'ab' THEN seq END) OVER (PARTITION BY segment, year) AND seq <= max(CASE WHEN kind = 'an' THEN seq END) OVER (PARTITION BY segment, year))"""


def occurring(name: str, source: str) -> str:
    """Rows of ``source`` with all their minutes and whether the train turns back there."""
    return f"""{name} AS (SELECT *, row_number() OVER w AS i,
    list_filter(list_transform(list_filter(range(5, 27), lambda h: half = '' OR (half = 'n') = (h % 2 = 0)), lambda h: CAST(h * 60 + m AS INT)), lambda t: t >= 300 AND CASE WHEN kind = 'ab' THEN t < 1440 ELSE t <= 1560 END) AS ts,
    coalesce(kind = 'ab' AND lag(kind) OVER w = 'an' AND lag(kind, 2) OVER w = 'ab' AND lead(kind) OVER w = 'an' AND lag(station) OVER w = station AND lag(station, 2) OVER w = lead(station) OVER w, false) AS turn
    FROM {source} WINDOW w AS (PARTITION BY segment ORDER BY seq))"""


def tripping(name: str, rows: str) -> str:
    """Trips of the rows of one year, with their events as a list."""
    return f"""{name}_grown(segment, i0, t0, i, station, kind, last, ev) AS (
    SELECT segment, i, t, i, station, kind, t, [{{'s': station, 'k': kind, 'm': t}}] FROM (SELECT segment, i, station, kind, unnest(ts) AS t FROM {rows} WHERE kind = 'ab')
    UNION ALL
    SELECT segment, i0, t0, i, station, kind, t, list_append(ev, {{'s': station, 'k': kind, 'm': t}}) FROM (
      SELECT x.segment, i0, t0, r.i, r.station, r.kind, ev, last, turn, x.station = r.station AND x.kind = 'an' AND r.kind = 'ab' AS dwell,
        list_filter(ts, lambda t: t >= greatest(last + CASE WHEN x.station = r.station AND x.kind = 'an' AND r.kind = 'ab' THEN 0 ELSE 1 END, CASE WHEN p THEN (last // 60 + 1) * 60 ELSE 0 END, CASE WHEN q THEN last + 60 ELSE 0 END))[1] AS t
      FROM {name}_grown x JOIN {rows} r ON r.segment = x.segment AND r.i = x.i + 1)
    WHERE t IS NOT NULL AND NOT (dwell AND (turn OR t - last > 15))),
  {name} AS (SELECT segment, i0, t0, i, last, ev FROM {name}_grown QUALIFY i = max(i) OVER (PARTITION BY segment, i0, t0) AND i > i0 AND kind = 'an'),
  {name}_signed AS (SELECT *, array_to_string(list_transform(ev, lambda e: e.s || '::' || e.k || '::' || e.m), '|') AS signature FROM {name})"""


YEAR = f"{ACTIVE}, now AS (SELECT * FROM active WHERE year = '2026'), {occurring('r', 'now')}, {tripping('trip', 'r')}"
#: The first of equal trips, by segment, departure row and minute.
ONCE = f"{YEAR}, once AS (SELECT * FROM trip_signed QUALIFY row_number() OVER (PARTITION BY signature ORDER BY segment, i0, t0) = 1)"


def _active(spark, sf, year=None):
    rows = T.active_rows(I.timetable(spark, sf), ["2026", "2035"], ["segment", "seq", "station", "kind"])
    return rows.where(F.col("year") == year).drop("year", "raw") if year else rows


def _trips(spark, sf, until=None):
    return T.trips(_active(spark, sf, "2026"), until=until)


def _once(spark, sf, until=None):
    return T.distinct_trips(_trips(spark, sf, until), ["segment", "start_seq", "start"])


@add("T10 F04 W12", f"WITH {ACTIVE} SELECT segment, year, seq, station, kind, m AS minute, CASE half WHEN 'n' THEN 'even' WHEN 'i' THEN 'odd' ELSE 'all' END AS parity, p, q FROM active", "", "seq minute")
def active_rows_by_year(spark, sf):
    return _active(spark, sf).select("segment", "year", "seq", "station", "kind", "token.*")


@add("T01", f"WITH {ACTIVE}, now AS (SELECT * FROM active WHERE year = '2026'), {occurring('r', 'now')} SELECT station, kind, t AS minute, count(*) AS n FROM (SELECT station, kind, unnest(ts) AS t FROM r) GROUP BY ALL", "", "minute n")
def token_occurrences(spark, sf):
    """How many rows of the timetable stand at each station, kind and minute of the day."""
    at = _active(spark, sf, "2026").select("station", "kind", F.explode(T.occurrences(F.col("token"), F.col("kind"))).alias("minute"))
    return at.groupBy("station", "kind", "minute").agg(F.count("*").alias("n"))


@add("T02", f"WITH RECURSIVE {YEAR} SELECT segment, t0 AS start, sha1(signature) AS signature, len(ev) AS events, last AS ends FROM trip_signed", "", "start events ends")
def chained_trips(spark, sf):
    return _trips(spark, sf).select("segment", "start", F.sha1(T.signature(F.col("events"))).alias("signature"), F.size("events").alias("events"), F.element_at("events", -1)["minute"].alias("ends"))


@add("T03 F15", f"WITH RECURSIVE {ONCE} SELECT substr(sha1(signature), 1, 16) AS trip, segment, t0 AS start FROM once", "", "start")
def trips_once(spark, sf):
    return _once(spark, sf).select("trip", "segment", "start")


@add("T04 W05 W10", f"""WITH RECURSIVE {ONCE}, e AS (SELECT segment AS line, ev, unnest(range(1, len(ev) + 1)) AS j FROM once), b AS (
    SELECT DISTINCT line, ev[j].s AS station, CASE ev[j].k WHEN 'an' THEN 'arrival' ELSE 'departure' END AS board, ev[j].m AS minute,
      coalesce(list_filter(list_reverse(ev[1 : j - 1]), lambda x: x.s <> ev[j].s)[1].s, '') AS previous, coalesce(list_filter(ev[j + 1 :], lambda x: x.s <> ev[j].s)[1].s, '') AS following
    FROM e WHERE ev[j].s IN ('S1', 'S4', 'S7') AND ev[j].m >= 300 AND ev[j].m < 420)
  SELECT * FROM b x WHERE NOT EXISTS (FROM b y WHERE x.board = y.board AND x.line = y.line AND x.station = y.station AND x.minute = y.minute
    AND CASE x.board WHEN 'departure' THEN x.following = y.following AND x.previous = '' AND y.previous <> '' ELSE x.previous = y.previous AND x.following = '' AND y.following <> '' END)""", "", "minute")
def station_boards(spark, sf):
    """Boards of three hubs from 05:00 to before 07:00, without the ends that only a shorter run of the same train has."""
    # Minutes never fall along a trip, and equal trips start together: none that starts later is on a board or hides one that is.
    return T.board_rows(_once(spark, sf, 420), ["S1", "S4", "S7"], 300, 420)


@add("T09 F01", f"""WITH RECURSIVE {ONCE}, e AS (SELECT segment AS line, ev, unnest(range(1, len(ev))) AS j FROM once), x AS (SELECT line, ev[j].s AS from_station, ev[j + 1].s AS to_station, ev[j].m AS d, ev[j + 1].m AS a FROM e WHERE ev[j].k = 'ab' AND ev[j + 1].k = 'an' AND ev[j].m >= 300 AND ev[j].m < 420)
  SELECT line, from_station, to_station, array_to_string(list_transform(list_sort(list_distinct(list(d))), lambda t: printf('%02d:%02d', t // 60, t % 60)), ', ') AS departures,
    array_to_string(list_transform(list_sort(list_distinct(list(a))), lambda t: printf('%02d:%02d', t // 60 % 24, t % 60)), ', ') AS arrivals FROM x GROUP BY ALL""")
def line_profile_timings(spark, sf):
    return T.line_timings(_once(spark, sf, T.SHOWN[1]))


#: An edit for every fourth section of a departure and the arrival next to it; some name a minute that is not theirs, some a section that another edit takes first.
EDITS = f"""{ACTIVE}, now AS (SELECT * FROM active WHERE year = '2026'), nx AS (SELECT *, lead(seq) OVER w AS to_seq, lead(station) OVER w AS to_station, lead(kind) OVER w AS to_kind, lead(m) OVER w AS to_m, lead(half) OVER w AS to_half FROM now WINDOW w AS (PARTITION BY segment ORDER BY seq)),
  section AS (SELECT segment, seq, to_seq, station AS from_station, to_station, m, half, to_m, to_half FROM nx WHERE kind = 'ab' AND to_kind = 'an'),
  edits AS (SELECT segment || '-' || seq || '-' || c AS edit, segment, from_station, to_station, CASE WHEN half = 'n' THEN 60 ELSE 0 END + m + CASE WHEN m % 5 = 0 THEN 1 ELSE 0 END AS dep, CASE WHEN to_half = 'n' THEN 60 ELSE 0 END + to_m AS arr, m % 7 - 3 AS delta, segment || '-' || c || '-' || seq AS rank
    FROM section CROSS JOIN (VALUES (0), (1)) AS t(c) WHERE c = 0 OR m % 4 = 0),
  hits AS (SELECT DISTINCT e.*, s.seq, s.to_seq FROM edits e JOIN section s ON e.segment = s.segment AND e.from_station = s.from_station AND e.to_station = s.to_station
    AND e.dep IN (CASE WHEN s.half = 'n' THEN s.m + 60 ELSE s.m END, CASE WHEN s.half = 'i' THEN s.m ELSE s.m + 60 END) AND e.arr IN (CASE WHEN s.to_half = 'n' THEN s.to_m + 60 ELSE s.to_m END, CASE WHEN s.to_half = 'i' THEN s.to_m ELSE s.to_m + 60 END)),
  judged AS (SELECT *, CASE WHEN rank = min(rank) OVER (PARTITION BY segment, seq) THEN 'applied' ELSE 'stale' END AS status FROM hits),
  moves AS (SELECT segment, unnest([seq, to_seq]) AS seq, edit, delta FROM judged WHERE status = 'applied'),
  after AS (SELECT segment, seq, station, kind, year, CAST((m + coalesce(delta, 0) + 60) % 60 AS INT) AS m, CASE WHEN half = '' OR m + coalesce(delta, 0) BETWEEN 0 AND 59 THEN half WHEN half = 'i' THEN 'n' ELSE 'i' END AS half, p, q, edit FROM now LEFT JOIN moves USING (segment, seq))"""


def _edits(spark, sf):
    from pyspark.sql.window import Window

    rows = kept(_active(spark, sf, "2026"))  # the edits are made from them too
    by = Window.partitionBy("segment").orderBy("seq")
    nxt = rows.withColumns({"to_station": F.lead("station").over(by), "to_kind": F.lead("kind").over(by), "to": F.lead("token").over(by)})
    sections = nxt.where("kind = 'ab' AND to_kind = 'an'").withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).where("c = 0 OR token.minute % 4 = 0")
    face = lambda t: F.when(F.col(t)["parity"] == "even", 60).otherwise(0) + F.col(t)["minute"]
    text = lambda *c: F.concat_ws("-", *[F.col(x).cast("string") for x in c])
    return rows, sections.select(
        text("segment", "seq", "c").alias("edit"), text("segment", "c", "seq").alias("rank"), "segment", F.col("station").alias("from_station"), "to_station",
        (face("token") + F.when(F.col("token.minute") % 5 == 0, 1).otherwise(0)).alias("dep"), face("to").alias("arr"), (F.col("token.minute") % 7 - 3).alias("delta"),
    )


@add("T07 J05", f"WITH {EDITS} SELECT edit, CAST(seq AS INT) AS from_seq, status FROM judged UNION ALL SELECT edit, NULL, 'unmatched' FROM edits WHERE edit NOT IN (SELECT edit FROM hits)")
def matched_edits(spark, sf):
    return T.matched(*_edits(spark, sf)).select("edit", F.col("from_seq").cast("int").alias("from_seq"), "status")


TEXT = "CAST(m AS VARCHAR) || half || CASE WHEN p THEN 'P' ELSE '' END || CASE WHEN q THEN 'Q' ELSE '' END"


@add("T07 F05", f"WITH {EDITS} SELECT segment, seq, {TEXT} AS text, edit FROM after", "", "seq")
def edited_timetable(spark, sf):
    return T.edited(*_edits(spark, sf)).select("segment", "seq", S.token_text("token").alias("text"), "edit")


def _shapes(name: str) -> str:
    return f"""{name}_shape AS (SELECT segment, count(*) AS n, list_sort(list(array_to_string(list_transform(ev, lambda e: e.s || ':' || e.k), '|') || '#' || array_to_string(list_transform(list_filter(range(1, len(ev)), lambda j: ev[j].k = 'ab' AND ev[j + 1].k = 'an'), lambda j: ev[j + 1].m - ev[j].m), ','))) AS shapes FROM {name} GROUP BY segment)"""


VERDICT = f"""{EDITS}, {occurring('rb', 'now')}, {tripping('tb', 'rb')}, {occurring('ra', 'after')}, {tripping('ta', 'ra')}, {_shapes('tb')}, {_shapes('ta')},
  order_of AS (SELECT segment, bool_and((kind = 'ab') = (i % 2 = 1)) AS fine FROM ra GROUP BY segment),
  verdict AS (SELECT segment, CASE WHEN NOT fine THEN 'sequence' WHEN coalesce(a.n, 0) <> coalesce(b.n, 0) THEN 'count' WHEN a.shapes IS DISTINCT FROM b.shapes THEN 'structure' ELSE '' END AS reason
    FROM order_of LEFT JOIN ta_shape a USING (segment) LEFT JOIN tb_shape b USING (segment))"""


@add("T08 P11", f"WITH RECURSIVE {VERDICT} SELECT segment, reason FROM verdict")
def edit_compatibility(spark, sf):
    rows, edits = _edits(spark, sf)
    return T.compatibility(rows, T.edited(rows, edits).drop("edit"))


@add("Z11 T07 T08", f"WITH RECURSIVE {VERDICT}, final AS (SELECT segment, seq, reason, CASE WHEN reason = '' THEN a.m ELSE n.m END AS m, CASE WHEN reason = '' THEN a.half ELSE n.half END AS half, n.p, n.q, CASE WHEN reason = '' THEN edit END AS edit FROM after a JOIN now n USING (segment, seq) JOIN verdict USING (segment)) SELECT segment, seq, {TEXT} AS text, edit, reason FROM final", "", "seq")
def composed_timetable(spark, sf):
    """The timetable with all edits but those of segments that they would break."""
    return T.composed(*_edits(spark, sf)).select("segment", "seq", S.token_text("token").alias("text"), "edit", "reason")
