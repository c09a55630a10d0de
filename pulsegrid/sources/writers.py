"""Sinks: text tables with fixed or joined columns, matrices, gzip JSON rows, atomic replacement, merged state."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lines of a report.
MOST_LINES = 10_000


def csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The named columns in order; one that ``df`` lacks is empty."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def ragged_csv(frames: Sequence[DataFrame], path: str) -> None:
    """Tables of different columns in one; columns in the order they are met first."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").csv(path, header=True)


def matrix(long: DataFrame, path: str, names: Sequence[str], digits: int) -> None:
    """A square matrix of a bounded list of names: each is a column and a row, also without any cell."""
    text = long.withColumn("value", F.format_string(f"%.{digits}f", "value"))
    wide = text.groupBy("origin").pivot("destination", list(names)).agg(F.first("value"))
    rows = long.sparkSession.createDataFrame([(n,) for n in names], "origin string")
    rows.join(wide, "origin", "left").write.mode("overwrite").csv(path, header=True)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def replaced(df: DataFrame, path: str) -> None:
    """A new version of the table at ``path``: written whole beside the old one, then one pointer file is renamed over.

    A reader (``readers.current``) sees the old table or the new one, and a
    writer that dies leaves the old one.  The version before the old one goes.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    old = pointer(spark, path)
    df.write.parquet(f"{path}/{version}")
    fs, new = hadoop.Path(path).getFileSystem(conf), hadoop.Path(f"{path}/_next-{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), conf).rename(new, hadoop.Path(f"{path}/_CURRENT"), over)
    for f in fs.listStatus(hadoop.Path(path)):
        if f.isDirectory() and f.getPath().getName() not in (version, old):
            fs.delete(f.getPath(), True)


def pointer(spark: SparkSession, path: str) -> str | None:
    """The version that the table at ``path`` has now, or None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_CURRENT")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return bytes(source.readNBytes(64)).decode()
    finally:
        source.close()


def merged_state(state: DataFrame | None, batch: DataFrame, keys: Sequence[str], sums: Sequence[str], least: Sequence[str]) -> DataFrame:
    """The state with a batch merged in: sums add up, minima skip nulls."""
    rows = batch if state is None else state.select(*batch.columns).unionByName(batch)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least])


def summary(df: DataFrame) -> str:
    """A one-row table as JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("j")).first()["j"]


def markdown(df: DataFrame, title: str) -> DataFrame:
    """A report of a table in its order of rows, as lines of Markdown: ``n``, ``line``; one of more than ``MOST_LINES`` fails."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    rows = [r["line"] for r in df.limit(MOST_LINES + 1).select(cells.alias("line")).collect()]
    if len(rows) > MOST_LINES:
        raise ValueError(f"a report of more than {MOST_LINES} lines; write it as a table")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return df.sparkSession.createDataFrame(list(enumerate(head + rows)), "n int, line string")
