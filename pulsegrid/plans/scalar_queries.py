"""Queries of the scalar functions, on the stand-in tables and on small inline tables of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from . import inputs as I
from .registry import add

#: Fixed texts that some events write in place of a number.
RAW = ["1", " 2.5 ", "x", "", "nan", "-3.5", "4.0", "1e3", "TRUE", "yes", "0", "261.0", "12345", "Zürich HB (31-34)"]
TEXTS = f"texts AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN ({RAW!r})[event_id % {len(RAW)} + 1] ELSE event_id || '.' || event_id % 10 END AS raw FROM events)"
#: Clock texts of five forms; a sixth is empty.
CLOCKS = """clocks AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN printf('%02d:%02d', hour(ts), minute(ts)) WHEN 1 THEN printf('%d:%02d, %d:%02d', hour(ts), minute(ts), hour(ts) + 1, minute(ts))
  WHEN 2 THEN event_id || ' min' WHEN 3 THEN '' WHEN 4 THEN printf('%d:%02d', hour(ts) + 20, minute(ts)) ELSE printf(' %d:%d ', hour(ts), minute(ts)) END AS raw FROM events)"""


def _texts(spark, sf):
    n = F.col("event_id")
    some = F.coalesce(*[F.when(n % len(RAW) == i, F.lit(x)) for i, x in enumerate(RAW)])
    return I.read(spark, sf, "events").select(n.alias("id"), F.when(n % 3 == 0, some).otherwise(F.concat_ws(".", n.cast("string"), (n % 10).cast("string"))).alias("raw"))


def _clocks(spark, sf):
    n, h, m = F.col("event_id") % 6, F.hour("ts"), F.minute("ts")
    forms = [F.format_string("%02d:%02d", h, m), F.format_string("%d:%02d, %d:%02d", h, m, h + 1, m), F.concat(F.col("event_id").cast("string"), F.lit(" min")), F.lit(""), F.format_string("%d:%02d", h + 20, m), F.format_string(" %d:%d ", h, m)]
    return I.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.coalesce(*[F.when(n == i, x) for i, x in enumerate(forms)]).alias("raw"))


@add("P01 P02 P03 P04 S01", f"""WITH {TEXTS} SELECT id, CASE WHEN isfinite(d) THEN d ELSE -1 END AS number, CASE WHEN isfinite(d) AND d > 0 THEN d END AS positive,
  CASE WHEN isfinite(d) THEN round_even(d, 0) ELSE 0 END AS even, CASE WHEN isfinite(d) THEN trunc(d) ELSE 0 END AS cut, lower(trim(raw)) IN ('1', 'true', 'yes') AS flag,
  CASE WHEN g = '' THEN NULL WHEN length(g) >= 4 THEN g ELSE lpad(g, 4, '0') END AS code, CASE WHEN starts_with(trim(raw), 'Zürich HB') THEN 'Zürich HB' ELSE trim(raw) END AS name
  FROM (SELECT *, try_cast(trim(raw) AS DOUBLE) AS d, regexp_replace(regexp_replace(trim(raw), '\\.0$', ''), '\\D', '', 'g') AS g FROM texts)""", "number positive", "even cut")
def lenient_casts(spark, sf):
    t = _texts(spark, sf)
    return t.select("id", S.number_or("raw", -1.0).alias("number"), S.number_or("raw", None, True).alias("positive"), S.integer_or("raw", 0).alias("even"), S.integer_or("raw", 0, False).alias("cut"),
                    S.truthy("raw").alias("flag"), S.community_code("raw").alias("code"), S.alias_name("raw", {"Zürich HB": "Zürich HB"}).alias("name"))


@add("P08 P07", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative balance' WHEN c_mktsegment = 'BUILDING' THEN 'segment' WHEN c_nationkey % 5 = 0 THEN 'nation' END AS reason,
  concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END, CASE WHEN c_nationkey % 5 = 0 THEN 'nation' END) AS flags FROM customer""")
def static_filter_chain(spark, sf):
    checks = [(F.col("c_acctbal") < 0, "negative balance"), (F.col("c_mktsegment") == "BUILDING", "segment"), (F.col("c_nationkey") % 5 == 0, "nation")]
    return I.read(spark, sf, "customer").select("c_custkey", S.first_reason(*checks).alias("reason"), S.flags(*checks).alias("flags"))


@add("P09 P10", """SELECT event_id, coalesce(v, m) AS filled, greatest(10, least(60, coalesce(v, m))) AS clamped FROM (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
  JOIN (SELECT event_type, quantile_cont(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, 0.5) AS m FROM events GROUP BY 1) USING (event_type)""", "filled clamped")
def median_fill_and_clamp(spark, sf):
    e = I.read(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    filled = F.coalesce("v", "m")
    return e.join(e.groupBy("event_type").agg(F.percentile("v", 0.5).alias("m")), "event_type").select("event_id", filled.alias("filled"), S.clamp(filled, 10.0, 60.0).alias("clamped"))


@add("P12 F18", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE contains(props, '1') AND CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 1", "", "k")
def text_filter_before_json(spark, sf):
    e = I.read(spark, sf, "events").where(F.contains("props", F.lit("1"))).select("event_id", F.from_json("props", "k INT")["k"].alias("k"))
    return e.where("k % 2 = 1")


@add("F01 F03", f"""WITH {CLOCKS} SELECT id, CASE WHEN m IS NULL THEN 'NA' ELSE printf('%02d:%02d', (m % 1440) // 60, m % 60) END AS text, m AS minute, n AS number, len(l) AS times
  FROM (SELECT id, raw, try_cast(split_part(trim(raw), ':', 1) AS INT) * 60 + try_cast(nullif(split_part(trim(raw), ':', 2), '') AS INT) AS m, try_cast(nullif(regexp_extract(raw, '(-?\\d+)', 1), '') AS INT) AS n,
  list_filter(list_transform(string_split(raw, ','), lambda x: try_cast(nullif(split_part(trim(x), ':', 1), '') AS INT) * 60 + try_cast(nullif(split_part(trim(x), ':', 2), '') AS INT)), lambda x: x IS NOT NULL) AS l FROM clocks)""", "", "minute number times")
def clock_texts(spark, sf):
    t = _clocks(spark, sf)
    return t.select("id", S.clock_text(S.clock_minute("raw")).alias("text"), S.clock_minute("raw").alias("minute"), S.leading_number("raw").alias("number"), F.size(S.clock_list("raw")).alias("times"))


@add("F02", f"WITH {I.BOARD} SELECT id, (((minute - 777) % 120) + 120) % 120 AS face FROM board", "", "face")
def clockface_minutes(spark, sf):
    return I.board(spark, sf).select("id", S.clockface(F.col("minute") - 777).alias("face"))


#: Every cell of the timetable's two years, and texts that are no token.
CELLS = f"{I.TIMETABLE}, cells AS (SELECT segment, seq, y2026 AS raw, 2026 AS year FROM timetable UNION ALL SELECT segment, seq, y2035, 2035 FROM timetable UNION ALL SELECT segment, seq, (['61', '7 x', '5ni', ' 05I p Q '])[seq % 4 + 1], 0 FROM timetable)"
TOKEN_SQL = """SELECT * FROM (SELECT segment, seq, year, raw, try_cast(nullif(regexp_extract(raw, r, 1), '') AS INT) AS minute, CASE lower(regexp_extract(raw, r, 2)) WHEN 'n' THEN 'even' WHEN 'i' THEN 'odd' ELSE 'all' END AS parity, lower(regexp_extract(raw, r, 3)) = 'p' AS p, lower(regexp_extract(raw, r, 4)) = 'q' AS q
  FROM cells, (SELECT '^\\s*(\\d{1,2})\\s*([inIN]?)\\s*([Pp]?)\\s*([Qq]?)\\s*$' AS r)) WHERE minute BETWEEN 0 AND 59"""


def _cells(spark, sf):
    t = I.timetable(spark, sf)
    odd = F.coalesce(*[F.when(F.col("seq") % 4 == i, F.lit(x)) for i, x in enumerate(["61", "7 x", "5ni", " 05I p Q "])])
    parts = [t.select("segment", "seq", c.alias("raw"), F.lit(y).alias("year")) for c, y in ((F.col("`2026`"), 2026), (F.col("`2035`"), 2035), (odd, 0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("t", S.token("raw")).where("t IS NOT NULL")


@add("F04", f"WITH {CELLS} {TOKEN_SQL}", "", "seq year minute")
def parsed_tokens(spark, sf):
    return _cells(spark, sf).select("segment", "seq", "year", "raw", "t.minute", "t.parity", "t.p", "t.q")


@add("F05", f"""WITH {CELLS} SELECT segment, seq, year, delta, CAST((minute + delta + 120) % 60 AS VARCHAR) || CASE WHEN parity = 'all' THEN '' WHEN (parity = 'even') = ((minute + delta + 120) // 60 % 2 = 0) THEN 'n' ELSE 'i' END || CASE WHEN p THEN 'P' ELSE '' END || CASE WHEN q THEN 'Q' ELSE '' END AS text
  FROM ({TOKEN_SQL}) CROSS JOIN (VALUES (-7), (0), (5), (45)) AS d(delta)""", "", "seq year")
def shifted_tokens(spark, sf):
    t = _cells(spark, sf).withColumn("delta", F.explode(F.array(*[F.lit(d) for d in (-7, 0, 5, 45)])))
    return t.select("segment", "seq", "year", "delta", S.token_text(S.token_shifted("t", "delta")).alias("text"))


@add("F07 F08 F21", f"""WITH {I.STATIONS}, p AS (SELECT id, lat, lon, (lat * 3600 - 169028.66) / 10000 AS p, (lon * 3600 - 26782.5) / 10000 AS q FROM stations)
  SELECT id, 2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q AS east, 1200147.07 + 308807.95 * p + 3745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p AS north,
  (lon - 6) * least(800 / 5.0, 600 / 2.5) AS x, (48.3 - lat) * least(800 / 5.0, 600 / 2.5) AS y, (2.0 + lat / 2) / (1 + 2 + lat) AS tx, lat * sqrt(3.0) / 2 / (1 + 2 + lat) AS ty FROM p""", "east north x y tx ty", "", 4)
def projected_coordinates(spark, sf):
    s = I.stations(spark, sf)
    east, north = S.to_lv95("lat", "lon")
    x, y = S.fitted("lon", "lat", (6.0, 45.8, 11.0, 48.3), 800, 600)
    tx, ty = S.simplex(F.lit(1.0), F.lit(2.0), "lat")
    return s.select("id", east.alias("east"), north.alias("north"), x.alias("x"), y.alias("y"), tx.alias("tx"), ty.alias("ty"))


@add("F09 F10", """SELECT event_id, CASE WHEN value <= 10 THEN 0 WHEN value <= 40 THEN 1 WHEN value <= 90 THEN 2 ELSE 3 END AS b, CASE WHEN s >= 3600 THEN printf('%d h %d min %d s', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%d min %d s', s // 60, s % 60) ELSE printf('%d s', s) END AS d
  FROM (SELECT *, CAST(floor(value * 60) AS BIGINT) AS s FROM events)""", "", "b")
def buckets_and_durations(spark, sf):
    return I.read(spark, sf, "events").select("event_id", S.bucket("value", [10, 40, 90]).alias("b"), S.duration_text(F.col("value") * 60).alias("d"))


@add("F11 F12 F13 F14 P14", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ln(q) AS a, ln(1 + d) AS b, exp(greatest(-60, least(60, -q))) AS c, 1.0 / pow(q + 3, 2) AS e, least(1, q / 12) AS f, CASE WHEN q > 0 AND d > 0 THEN exp(0.5 * ln(q) + 0.5 * ln(d)) ELSE 0 END AS g,
  greatest(q * 0.3, q * (1 - least(0.7, 0.4 * 2 * (d * 300) / q))) AS h, CASE WHEN q < 12 THEN 0.6 + 0.4 * pow(q / 12, 1.5) ELSE 1 END AS i, coalesce(nullif(l_tax * l_suppkey, 0), q * d) AS w FROM (SELECT *, l_quantity AS q, l_discount AS d FROM lineitem)""", "a b c e f g h i w")
def decay_and_blends(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return I.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.ln(q).alias("a"), F.log1p(d).alias("b"), S.clipped_exp(-q).alias("c"), S.power_decay(q, 3, 2).alias("e"), S.attenuation(q, 12).alias("f"),
                                                S.geometric_blend(q, d, 0.5).alias("g"), S.transfer_discount(q, d * 300).alias("h"),
                                                S.near_damping(q, 0.6, 12.0, 1.5).alias("i"), S.path_weight(F.col("l_tax") * F.col("l_suppkey"), q, d).alias("w"))


@add("F15", f"WITH {I.BOARD} SELECT id, substr(sha1(concat_ws('|', CAST(station AS VARCHAR), kind, CAST(minute AS VARCHAR))), 1, 16) AS key, sha256(CAST(id AS VARCHAR)) AS content FROM board")
def stable_ids(spark, sf):
    return I.board(spark, sf).select("id", S.short_id(F.col("station").cast("string"), "kind", F.col("minute").cast("string")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("content"))


@add("F16 F17", f"""WITH {I.BOARD}, p AS (SELECT trip, list(station ORDER BY ts, id) AS s FROM board GROUP BY trip)
  SELECT trip, CAST(len(list_distinct(s)) AS INT) AS kinds, array_to_string(list_transform(s[2:4], lambda x: CAST(x AS VARCHAR)), '-') AS inner_nodes, CAST(len(list_filter(range(1, len(s) + 1), lambda i: i = 1 OR s[i] <> s[i - 1])) AS INT) AS changes FROM p""", "", "kinds changes")
def array_operations(spark, sf):
    p = I.board(spark, sf).groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "station"))).alias("e")).withColumn("s", F.transform("e", lambda x: x["station"]))
    return p.select("trip", F.size(S.first_of_each("s")).alias("kinds"), F.array_join(F.transform(F.slice("s", 2, 3), lambda x: x.cast("string")), "-").alias("inner_nodes"), F.size(S.without_repeats("s")).alias("changes"))


@add("F19", "SELECT p_partkey, lower(trim(p_type)) AS t, split_part(p_type, ' ', 1) AS first, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, starts_with(p_brand, 'Brand#1') AS one, lpad(CAST(p_size AS VARCHAR), 4, '0') AS size FROM part")
def text_operations(spark, sf):
    return I.read(spark, sf, "part").select("p_partkey", F.lower(F.trim("p_type")).alias("t"), F.substring_index("p_type", " ", 1).alias("first"), F.regexp_replace("p_name", "[aeiou]", "*").alias("masked"),
                                            F.col("p_brand").startswith("Brand#1").alias("one"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size"))


@add("F20", "SELECT p_partkey, p_size / 4.0 AS x, round_even(p_size / 4.0, 0) AS even FROM part", "x even")
def half_even_rounding(spark, sf):
    return I.read(spark, sf, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("x"), S.weight_half_even(F.col("p_size") / 4.0, 0).alias("even"))


#: A fixed polygon over the stand-in stations.
RING = ([6.4, 9.3, 9.9, 7.1], [45.9, 45.9, 47.0, 47.6])


@add("F22 J09", f"""WITH {I.STATIONS}, e AS (SELECT * FROM (VALUES (6.4::DOUBLE, 45.9::DOUBLE, 9.3::DOUBLE, 45.9::DOUBLE), (9.3, 45.9, 9.9, 47.0), (9.9, 47.0, 7.1, 47.6), (7.1, 47.6, 6.4, 45.9)) AS t(x1, y1, x2, y2)),
  a AS (SELECT sum(x1 * y2 - x2 * y1) / 2 AS area FROM e), c AS (SELECT sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (6 * any_value(area)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (6 * any_value(area)) AS cy FROM e, a)
  SELECT id, area, cx, cy, (SELECT count(*) % 2 = 1 FROM e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) AS within FROM stations, a, c""", "area cx cy")
def points_in_polygon(spark, sf):
    xs, ys = (F.array(*[F.lit(float(v)) for v in axis]) for axis in RING)
    cx, cy = S.ring_centroid(F.col("xs"), F.col("ys"))
    s = I.stations(spark, sf).withColumns({"xs": xs, "ys": ys})
    return s.select("id", S.ring_area("xs", "ys").alias("area"), cx.alias("cx"), cy.alias("cy"), S.inside("lon", "lat", "xs", "ys").alias("within"))


@add("O06", "SELECT o_orderkey, lab, CAST(year(o_orderdate) AS DOUBLE) + CASE WHEN month(o_orderdate) > 6 THEN 0.5 ELSE 0 END AS position FROM (SELECT *, year(o_orderdate) || CASE WHEN month(o_orderdate) > 6 THEN ' Q3/4' ELSE ' Q1/2' END AS lab FROM orders)", "position")
def half_year_labels(spark, sf):
    from ..operators.sequences import label_order

    o = I.read(spark, sf, "orders").withColumn("lab", F.concat(F.year("o_orderdate").cast("string"), F.when(F.month("o_orderdate") > 6, " Q3/4").otherwise(" Q1/2")))
    return o.select("o_orderkey", "lab", label_order("lab").alias("position"))
