"""Loads of services from the flows of paths, and what transfers share with the stations before and after them.

A leg is one movement of a path between neighbouring stops: ``path``, ``seq``
(its place in the path), ``line``, ``train`` (one run of the line), ``a`` and
``b`` (from and to), ``dep``, ``arr``, ``flow`` (the path's, the same on each
of its legs) and ``instances`` (departures a day over which the flow spreads).
A null flow counts as none; a path of no legs has no load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What names a transfer: station, line that arrives, minutes between, line that departs.
TRANSFER = ["station", "arrival_line", "wait", "departure_line"]


def service_loads(legs: DataFrame) -> DataFrame:
    """Loads by ``kind``, with ``line``, ``train``, ``a``, ``b`` where they apply, else null.

    ``service``: daily flow of a line over a section, a path counted once;
    ``network``: the same over all lines; ``riders``: paths that ride a line,
    each once; ``volume``: leg traversals of a line; ``train``: mean load of a
    train over a section, a path's flow spread over its instances.

    The legs are dealt by path once; what counts a path once is aggregated
    there, and only sums by section or line are shuffled again.
    """
    dealt = legs.withColumn("flow", F.coalesce(F.col("flow").cast("double"), F.lit(0.0))).repartition("path")
    none = lambda kind, *names: [F.lit(kind).alias("kind"), *[F.lit(None).cast(kind_of[n]).alias(n) for n in names]]
    kind_of = dict(legs.dtypes)
    by_section = dealt.groupBy("path", "line", "a", "b").agg(F.max("flow").alias("flow")).groupBy("line", "a", "b").agg(F.sum("flow").alias("load"))
    network = by_section.groupBy("a", "b").agg(F.sum("load").alias("load"))
    lines = dealt.groupBy("path", "line").agg(F.max("flow").alias("flow"), F.count("*").alias("n"))
    lines = lines.groupBy("line").agg(F.sum("flow").alias("riders"), F.sum(F.col("flow") * F.col("n")).alias("volume")).unpivot(["line"], ["riders", "volume"], "kind", "load")
    trains = dealt.groupBy("path", "line", "train", "a", "b").agg((F.max("flow") / F.nullif(F.max("instances").cast("double"), F.lit(0.0))).alias("flow"))
    trains = trains.groupBy("line", "train", "a", "b").agg(F.sum("flow").alias("load"))
    parts = [by_section.select(*none("service", "train"), "line", "a", "b", "load"), network.select(*none("network", "train", "line"), "a", "b", "load")]
    parts += [lines.withColumns({n: F.lit(None).cast(kind_of[n]) for n in ("train", "a", "b")}), trains.withColumn("kind", F.lit("train"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "line", "train", "a", "b", "load")


def path_transfers(legs: DataFrame) -> DataFrame:
    """One row for each change of train within a path: what names it, the flow, and the stations ridden ``before`` and ``after``.

    ``before`` are the stations where the arriving train was boarded or passed,
    nearest last; ``after`` those that the departing train is ridden to, nearest
    first: only the part of a train that the path uses.
    """
    by = Window.partitionBy("path").orderBy("seq")
    change = F.when(F.lag("train").over(by).eqNullSafe(F.col("train")), 0).otherwise(1)
    ridden = legs.withColumn("run", F.sum(change).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("seq", "a", "b", "dep", "arr")))
    runs = ridden.groupBy("path", "run").agg(F.first("line").alias("line"), F.max("flow").alias("flow"), rows.alias("legs"))
    of_path = Window.partitionBy("path").orderBy("run")
    both = runs.withColumns({"next_line": F.lead("line").over(of_path), "next": F.lead("legs").over(of_path)}).where("next IS NOT NULL")
    first, last = F.col("next")[0], F.element_at("legs", -1)
    return both.select(
        "path", "run", first["a"].alias("station"), F.col("line").alias("arrival_line"), (first["dep"] - last["arr"]).alias("wait"), F.col("next_line").alias("departure_line"),
        F.coalesce(F.col("flow").cast("double"), F.lit(0.0)).alias("flow"), F.col("legs.a").alias("before"), F.col("next.b").alias("after"),
    )


def transfer_rows(transfers: DataFrame) -> DataFrame:
    """Each kind of transfer with its ``paths`` and ``flow``; a path counts once."""
    once = transfers.groupBy("path", *TRANSFER).agg(F.max("flow").alias("flow"))
    return once.groupBy(*TRANSFER).agg(F.count("*").alias("paths"), F.sum("flow").alias("flow"))


def transfer_overlap(transfers: DataFrame) -> DataFrame:
    """For each kind of transfer, the flow that also passes an ``other`` station on the same train, ``side`` prior or following.

    An ``other`` is a station where some path changes from or to that line, and
    not the transfer's own.  A path counts once for a transfer and an other.
    """
    side = lambda name, line, stations: transfers.select("path", *TRANSFER, "flow", F.lit(name).alias("side"), F.col(line).alias("line"), F.explode(F.array_distinct(stations)).alias("other"))
    passed = side("prior", "arrival_line", "before").unionByName(side("following", "departure_line", "after")).where("other <> station")
    changed = transfers.select(F.col("station").alias("other"), F.explode(F.array("arrival_line", "departure_line")).alias("line")).distinct()
    once = passed.join(changed, ["line", "other"], "left_semi").groupBy("path", *TRANSFER, "side", "other").agg(F.max("flow").alias("flow"))
    return once.groupBy(*TRANSFER, "side", "other").agg(F.count("*").alias("paths"), F.sum("flow").alias("flow"))
