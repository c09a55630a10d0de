"""Queries that go through a source or sink: tables are written to the shared folder in a format and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources import readers, writers
from . import inputs as I
from .registry import add


def _folder(spark) -> str:
    return I.shared_folder(spark, "tables")


@add("S02 K01 P13", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey IN (3, 7, 11)", "c_acctbal", "c_custkey c_nationkey")
def text_table_round_trip(spark, sf):
    """A table as text and back, typed by column, with a filter to a constant list in the scan."""
    at = _folder(spark)
    writers.csv(I.read(spark, sf, "customer"), at, ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    hubs = spark.createDataFrame([("3",), ("7",), ("11",)], "c_nationkey string")
    return readers.csv(spark, at, ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]).join(F.broadcast(hubs), "c_nationkey", "left_semi")


@add("K02 U01", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, '' AS balance FROM nation UNION ALL SELECT c_name, '', CAST(c_acctbal AS VARCHAR) FROM customer")
def ragged_text_tables(spark, sf):
    at = _folder(spark)
    n = I.read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    writers.ragged_csv([n, I.read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))], at)
    return readers.csv(spark, at)


@add("S05 S06 K05 F18", f"WITH {I.BOARD} SELECT trip, id, minute, pax FROM board", "pax", "trip id minute")
def nested_rows_round_trip(spark, sf):
    """Rows with nested arrays as gzip JSON and back to one row per element."""
    at = _folder(spark)
    rows = I.board(spark, sf).groupBy("trip").agg(F.collect_list(F.to_json(F.struct("id", "minute", "pax"))).alias("cells"))
    writers.json_rows(rows, at)
    back = spark.read.schema("trip BIGINT, cells ARRAY<STRING>").json(at).select("trip", F.explode("cells").alias("c"))
    return back.select("trip", F.from_json("c", "id BIGINT, minute INT, pax DOUBLE").alias("v")).select("trip", "v.*")


@add("S07", "SELECT s_nationkey AS origin_zone, c_nationkey AS destination_zone, count(*) AS trips FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL", "trips", "origin_zone destination_zone")
def zone_matrix_text(spark, sf):
    """A matrix as white-space separated text with comments, and back."""
    at = _folder(spark)
    t = {n: I.read(spark, sf, n) for n in ("lineitem", "orders", "customer", "supplier")}
    m = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    lines = m.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n")).select(F.format_string("  %d %d\t%d", "s_nationkey", "c_nationkey", "n").alias("value"))
    lines.unionByName(spark.createDataFrame([("* comment",), ("$x",), ("1 2",), ("a b c",)], "value string")).write.text(at)
    return readers.whitespace_matrix(spark, at)


@add("S09", "SELECT r_name AS region, c_mktsegment AS segment, count(c_custkey) AS value FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN (SELECT c_custkey, c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) c USING (c_mktsegment) WHERE n_regionkey = r_regionkey GROUP BY ALL", "value")
def statistics_cube(spark, sf):
    """A cube flattened to one array of values and read again by position."""
    regions, segments = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    c = I.read(spark, sf, "customer").join(I.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(I.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = (F.array_position(F.lit(regions), F.col("r_name")) - 1) * len(segments) + F.array_position(F.lit(segments), F.col("c_mktsegment")) - 1
    cells = c.groupBy(at.alias("pos")).agg(F.count("*").cast("double").alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    flat = cells.select(F.transform(F.sequence(F.lit(0), F.lit(len(regions) * len(segments) - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("value"))
    return readers.statistics_cube(flat, "value", [5, 5], ["region", "segment"], [regions, segments]).where("value > 0")


@add("S11 K08 A11", "SELECT user_id, sum(value) AS daily, min(value) AS least FROM events GROUP BY user_id", "daily least")
def merged_state(spark, sf):
    """State merged from two batches: sums add up and minima skip nulls."""
    e = I.read(spark, sf, "events").select("user_id", F.col("value").alias("daily"), F.col("value").alias("least"))
    half = F.pmod(F.xxhash64("user_id", "daily"), F.lit(2))
    at = _folder(spark)
    writers.replaced(writers.merged_state(None, e.where(half == 0), ["user_id"], ["daily"], ["least"]), at)
    return writers.merged_state(readers.current(spark, at), e.where(half == 1), ["user_id"], ["daily"], ["least"])


@add("S12 S13 K04", f"WITH {I.DEMAND} SELECT origin, destination, sum(weight) AS value FROM demand GROUP BY ALL", "value", "", 2)
def kept_matrix(spark, sf):
    """A long matrix kept by the fingerprint of its inputs."""
    def build():
        return I.demand(spark, sf).groupBy("origin", "destination").agg(F.sum("weight").alias("value"))

    at = _folder(spark)
    made_of = readers.fingerprint(spark, [f"{sf}/{t}.parquet" for t in ("lineitem", "orders", "customer", "supplier", "nation", "region")])
    readers.fingerprinted(spark, at, build, made_of).limit(0).count()

    def never():
        raise AssertionError("the kept table is there")

    return readers.fingerprinted(spark, at, never, made_of)


@add("S14 S10", "SELECT n_name AS name, n_regionkey AS region FROM nation", "", "region")
def script_assignment(spark, sf):
    """A table as an object assigned in a script, and back."""
    at = _folder(spark)
    n = I.read(spark, sf, "nation").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))).alias("j"))
    n.select(F.concat(F.lit("var stations = {\"rows\": "), "j", F.lit("};")).alias("value")).coalesce(1).write.text(at)
    return readers.assigned_json(spark, at, "stations", "rows ARRAY<STRUCT<name: STRING, region: INT>>").select(F.inline("rows"))


@add("K07", f"WITH {I.PATHS} SELECT count(*) AS n, round(sum(weight), 2) AS weight FROM paths", "weight", "n", 2)
def summary_report(spark, sf):
    """A one-row summary through its JSON report."""
    text = writers.summary(I.paths(spark, sf).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))
    return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "n BIGINT, weight DOUBLE").alias("s")).select("s.*")


@add("O08 Z12", f"WITH {I.BOARD} SELECT line, id % 4 AS shard, count(*) AS n, sum(pax) AS pax FROM board GROUP BY ALL", "pax", "n")
def sharded_runs_merged(spark, sf):
    """The shards of a run (row number modulo count), each aggregated and merged again."""
    b = I.board(spark, sf).withColumn("shard", F.col("id") % 4)
    return b.groupBy("line", "shard").agg(F.count("*").alias("n"), F.sum("pax").alias("pax"))


@add("D18 T09", f"""WITH {I.BOARD}, n AS (SELECT *, lead(line) OVER w AS next_line, lead(minute) OVER w - minute AS wait, lead(kind) OVER w AS next_kind FROM board WINDOW w AS (PARTITION BY station ORDER BY minute, id))
  SELECT station, line AS arrival_line, next_line AS departure_line, wait, count(*) AS n, sum(pax) AS pax, min(minute) AS first FROM n WHERE kind = 'an' AND next_kind = 'ab' AND line <> next_line GROUP BY ALL""", "pax", "wait n first", 4)
def transfer_contexts(spark, sf):
    """Transfers by station, lines and wait, from each arrival to the departure that follows it there."""
    from ..operators.sequences import adjacent

    n = adjacent(I.board(spark, sf), ["station"], ["minute", "id"], ["line", "minute", "kind"]).where("kind = 'an' AND next_kind = 'ab' AND line <> next_line")
    return n.groupBy("station", F.col("line").alias("arrival_line"), F.col("next_line").alias("departure_line"), (F.col("next_minute") - F.col("minute")).alias("wait")).agg(F.count("*").alias("n"), F.sum("pax").alias("pax"), F.min("minute").alias("first"))


@add("S03 W11", f"WITH {I.TIMETABLE} SELECT segment, seq, station, kind, trim(y2026) AS a, trim(y2035) AS b FROM timetable", "", "seq")
def headed_timetable(spark, sf):
    """The timetable as a file whose first line is data and whose segments begin with a row of their own, read again into numbered segments."""
    from ..operators.ordering import running

    at = _folder(spark)
    t = I.timetable(spark, sf)
    order = ["segment", "seq"]
    head = t.select("segment").distinct().select("segment", F.lit(-1).alias("seq"), F.concat_ws(",", "segment", F.lit("an/ab"), F.lit("2026"), F.lit("2035")).alias("line"))
    lines = head.unionByName(t.select(*order, F.concat_ws(",", "station", "kind", "`2026`", "`2035`").alias("line")))
    lines.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("line").write.text(at)
    rows = readers.headed_rows(spark, at, 4).toDF("rownum", "station", "kind", "a", "b")
    named = running(rows, [], ["rownum"], F.when(F.col("kind") == "an/ab", 1).otherwise(0), "block")
    heads = named.where("kind = 'an/ab'").select("block", F.col("station").alias("segment"), F.col("rownum").alias("first"))
    out = named.where("kind <> 'an/ab'").join(heads, "block")
    return out.select("segment", (F.col("rownum") - F.col("first") - 1).alias("seq"), "station", "kind", F.trim("a").alias("a"), F.trim("b").alias("b"))


@add("S15", "SELECT c_name AS station, CAST(c_nationkey AS VARCHAR) AS n FROM customer")
def table_of_a_document(spark, sf):
    """The cells of a labelled table in a typeset document."""
    at = _folder(spark)
    rows = I.read(spark, sf, "customer").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(F.col("c_name"), F.lit(" & "), F.col("c_nationkey").cast("string"), F.lit(r" \\"))))).alias("rows"))
    rows.select(F.concat(F.lit("\\begin{table}\\label{tab:x}\n\\toprule\n"), "rows", F.lit("\n\\bottomrule\n\\end{table}")).alias("value")).coalesce(1).write.text(at)
    return readers.latex_rows(spark, at, "tab:x", 2).select(F.col("c0").alias("station"), F.col("c1").alias("n"))


MATRIX = f"{I.DEMAND}, m AS (SELECT origin, destination, round(sum(weight), 2) AS value FROM demand GROUP BY ALL)"


@add("S04 K03 X02", f"WITH {MATRIX}, n AS (SELECT n_name FROM nation) SELECT o.n_name AS origin, d.n_name AS destination, coalesce(value, 0) AS value FROM n o CROSS JOIN n d LEFT JOIN m ON m.origin = o.n_name AND m.destination = d.n_name", "value", "", 2)
def square_matrix_text(spark, sf):
    """Demand as a wide labelled square table and back to long rows."""
    at = _folder(spark)
    m = I.demand(spark, sf).groupBy("origin", "destination").agg(F.sum("weight").alias("value"))
    names = [f"NATION_{i}" for i in range(25)]
    writers.matrix(m, at, names, 2)
    return readers.matrix(spark, at)


@add("S05 S06 K05", f"WITH {I.BOARD} SELECT trip AS row_idx, 'S' || trip AS origin, CAST(k AS INT) AS col_idx, minute AS dep_min, minute + 10 AS arr_min, pax AS daily_demand_total FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY id) - 1 AS k FROM board)", "daily_demand_total", "row_idx col_idx dep_min arr_min")
def row_states_round_trip(spark, sf):
    """Path rows stored as JSON, each cell a JSON text of its own, and read to one row per path."""
    at = _folder(spark)
    path = F.struct(F.col("minute").alias("dep_min"), (F.col("minute") + 10).alias("arr_min"), F.lit(0).alias("num_transfers"))
    cell = F.to_json(F.struct(F.lit(False).alias("same_station"), F.lit(1).alias("path_count"), F.col("pax").alias("daily_demand_total"), F.array(path).alias("paths")))
    rows = I.board(spark, sf).select("trip", F.struct("id", cell.alias("cell")).alias("c")).groupBy(F.col("trip").cast("int").alias("row_idx")).agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cell"]).alias("cells"))
    one = rows.select("row_idx", F.concat(F.lit("S"), F.col("row_idx").cast("string")).alias("origin"), F.lit("2026").alias("year"), "cells")
    writers.json_rows(one.repartition(4, "row_idx"), at)
    return readers.row_states(spark, at, lines=True).select("row_idx", "origin", "col_idx", "dep_min", "arr_min", "daily_demand_total")


@add("S10 O04", "SELECT user_id, value, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'click' THEN 1 ELSE 0 END DESC, event_id DESC) = 1", "value")
def route_cache(spark, sf):
    """Two logs of JSON lines: the last record of each key, and a local log (clicks) over the master."""
    from ..operators import joins as J

    logs = []
    e = I.read(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    for mine in (False, True):
        at = _folder(spark)
        e.where((F.col("event_type") == "click") == mine).write.json(at)
        logs.append(readers.last_records(spark, at, "event_id BIGINT, user_id BIGINT, value DOUBLE, event_type STRING", "user_id", "event_id"))
    return J.overlaid(logs[0], logs[1], ["user_id"], "event_id").select("user_id", "value", "event_type")


@add("S08 J09 F22", f"WITH {I.STATIONS}, z AS (SELECT DISTINCT region, CASE region WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END AS k FROM stations) SELECT z.region AS zone, id FROM z JOIN stations ON lon >= 6 + k * 0.75 AND lon <= 6.75 + k * 0.75 AND lat >= 45.75 AND lat <= 47.25", "", "id")
def zone_membership(spark, sf):
    """Stations within the polygons of a vector layer; a point on a border is within."""
    from ..functions import scalars as S

    at = _folder(spark)
    order = {"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3}
    k = F.coalesce(*[F.when(F.col("r_name") == n, F.lit(i)) for n, i in order.items()], F.lit(4))
    low, high = 6 + k * 0.75, 6.75 + k * 0.75
    ring = F.array(*[F.array(x, F.lit(y)) for x, y in ((low, 45.75), (high, 45.75), (high, 47.25), (low, 47.25), (low, 45.75))])
    feature = F.struct(F.struct(F.col("r_name").alias("zone")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    I.read(spark, sf, "region").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).coalesce(1).write.text(at)
    zones = readers.vector_layer(spark, at, "zone: STRING")
    boxes = zones.select("*", F.array_min("xs").alias("x1"), F.array_max("xs").alias("x2"))
    # A station meets the zones of its cell of one degree only.
    cells = boxes.withColumn("cell", F.explode(F.sequence(F.floor("x1"), F.floor("x2"))))
    s = I.stations(spark, sf).withColumn("cell", F.floor("lon"))
    return s.join(cells, "cell").where(S.inside("lon", "lat", "xs", "ys")).select("zone", "id")


#: Of each region two boxes, the first with a hole; points of all customers.
BOXES = """box AS (SELECT r_name AS zone, 6 + r_regionkey * 0.75::DOUBLE AS x FROM region), pt AS (SELECT c_custkey AS id, 5.5 + c_custkey * 37 % 640 / 128.0 AS px, 45.5 + c_custkey * 91 % 256 / 128.0 AS py FROM customer)"""


def _zones(spark, sf):
    at, k = _folder(spark), F.col("r_regionkey")

    def box(x1, y1, x2, y2):
        return F.array(*[F.array(F.lit(x) if isinstance(x, float) else x, F.lit(y)) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))])

    x = 6 + k * 0.75
    parts = F.array(F.array(box(x, 45.75, x + 0.75, 47.0), box(x + 0.25, 46.0, x + 0.5, 46.5)), F.array(box(x - 0.25, 47.125, x + 0.5, 47.25)))
    feature = F.struct(F.struct(F.col("r_name").alias("zone")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")).alias("geometry"))
    I.read(spark, sf, "region").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).coalesce(1).write.text(at)
    return readers.vector_layer(spark, at, "zone: STRING")


@add("S08 J09", f"""WITH {BOXES} SELECT id, zone FROM pt JOIN box ON px BETWEEN x AND x + 0.75 AND py BETWEEN 45.75 AND 47.0 AND NOT (px > x + 0.25 AND px < x + 0.5 AND py > 46.0 AND py < 46.5)
  OR px BETWEEN x - 0.25 AND x + 0.5 AND py BETWEEN 47.125 AND 47.25""", "", "id")
def points_of_zones(spark, sf):
    """All customers' points in areas of two polygons with a hole, by a cover of cells; borders count."""
    from ..operators import polygons

    k = F.col("c_custkey")
    points = I.read(spark, sf, "customer").select(k.alias("id"), (5.5 + k * 37 % 640 / 128.0).alias("px"), (45.5 + k * 91 % 256 / 128.0).alias("py"))
    return polygons.points_in(points, _zones(spark, sf).select("zone", "rings"), "px", "py", 0.3).select("id", "zone")


@add("F22 S08", f"""WITH {BOXES}, s AS (SELECT zone, x, 0.75 * 1.25 AS a, 0.25 * 0.5 AS h, 0.75 * 0.125 AS b FROM box)
  SELECT zone, a - h + b AS size, (a * (x + 0.375) - h * (x + 0.375) + b * (x + 0.125)) / (a - h + b) AS cx, (a * 46.375 - h * 46.25 + b * 47.1875) / (a - h + b) AS cy FROM s""", "size cx cy")
def zone_sizes(spark, sf):
    """Size and centre of areas of two polygons with a hole."""
    from ..operators import polygons

    cx, cy = polygons.centroid("rings")
    return _zones(spark, sf).select("zone", polygons.size("rings").alias("size"), cx.alias("cx"), cy.alias("cy"))


@add("K07", "SELECT CAST(row_number() OVER (ORDER BY r_name) + 3 AS INT) AS n, '| ' || r_name || ' | ' || n || ' |' AS line FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name) UNION ALL SELECT 0, '# Regions' UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| region | stations |' UNION ALL SELECT 3, '| --- | --- |'", "", "n")
def markdown_report(spark, sf):
    t = I.stations(spark, sf).groupBy("region").agg(F.count("*").alias("stations")).orderBy("region")
    return writers.markdown(t, "Regions")


@add("K06 I01 I04", "SELECT count(*) AS on_disk, count(DISTINCT event_id) AS events, count(*) AS rows_seen FROM events", "", "on_disk events rows_seen")
def appended_stream(spark, sf):
    """A stream appended twice to a table: the second run finds its rows on disk; a listener counts what was read."""
    import time

    from ..streaming import incremental

    at, progress = _folder(spark), incremental.Progress()
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.streams.addListener(progress)
    try:
        for _ in range(2):
            stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
            incremental.appended(stream, f"{at}/rows", f"{at}/cursor").awaitTermination()
        for _ in range(100):  # listeners are told a moment later
            if progress.batches:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    return spark.read.parquet(f"{at}/rows").agg(F.count("*").alias("on_disk"), F.countDistinct("event_id").alias("events")).withColumn("rows_seen", F.lit(progress.rows))


@add("J18 S04 P11", f"WITH {I.DEMAND}, m AS (SELECT DISTINCT origin, destination FROM demand WHERE origin < 'NATION_2') SELECT destination AS label, 'column' AS only FROM m WHERE destination NOT IN (SELECT origin FROM m) GROUP BY ALL UNION ALL SELECT origin, 'row' FROM m WHERE origin NOT IN (SELECT destination FROM m) GROUP BY ALL")
def matrix_label_faults(spark, sf):
    return J.label_faults(I.demand(spark, sf).where("origin < 'NATION_2'"))


