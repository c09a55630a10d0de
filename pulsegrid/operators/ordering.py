"""Order over groups of any size: running sums and numbers of rows, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage by the session's checkpoint folder; only a session without one (tests, a notebook) keeps it in memory."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str | Column, name: str, total: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row of its ``group`` in ``order``, and the group's ``total``.

    Rows are dealt by ranges of group and order.  Sums run within a range, and
    only one row for each range and group is summed across ranges.  Rows should
    differ in ``order``; null keys are a group.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [*[F.col(c) for c in group], *[F.col(o) if isinstance(o, str) else o for o in order]]
    lying = df.withColumn("__value", value).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    lying = kept(lying.withColumn("__part", F.spark_partition_id()))
    own = lying.withColumn("__sum", F.sum("__value").over(Window.partitionBy(*group, "__part").orderBy(*keys[len(group) :]).rowsBetween(Window.unboundedPreceding, 0)))
    parts = lying.groupBy(*group, "__part").agg(F.sum("__value").alias("__all"))
    by = Window.partitionBy(*group)  # a row for each range that the group meets
    before = F.coalesce(F.sum("__all").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__part").alias("__of"), before.alias("__before"), F.sum("__all").over(by).alias("__total"))
    same = F.col("__part") == F.col("__of")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = [*[F.col(c) for c in df.columns], (F.col("__sum") + F.col("__before")).alias(name)]
    return own.join(parts, same).select(*out, *([F.col("__total").alias(total)] if total else []))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with each row's number in its ``group``, from 1."""
    return running(df, group, order, F.lit(1), name)
