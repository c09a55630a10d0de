"""Rows of vectors dealt to bounded groups, for the two vector searches.

Vectors go to shards and queries to blocks by a hash of the id, so a frequent
vector is spread evenly.  A search task gets one shard and one block: the
vectors are repeated for each block of queries and the queries for each shard,
so both sides of a task are bounded however many there are.

Defined results for both searches: rows with a null id, and vectors that are
null, empty or hold a null or non-finite component, take no part; an id that
repeats counts once, with its least vector; a query meets only candidates of
its own dimension; ties go to the smaller id; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """Columns ``vec_id`` and ``vector`` of the rows that take part, and the dimension ``dim``."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND size(vector) > 0").where(F.forall("vector", finite))
    if nonzero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    return rows.withColumn("dim", F.size("vector"))


def deal(vectors: DataFrame, query_every: int, shard_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The vectors with ``shard``, the queries with ``block`` and ``home`` (a shard), and the numbers of shards and blocks."""
    is_query = F.col("vec_id") % query_every == 0
    n, q = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(q / block_rows))
    hashed = lambda seed, k: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(k)).cast("int")
    return (
        vectors.withColumn("shard", hashed(0, shards)),
        vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.col("dim").alias("q_dim"), hashed(1, blocks).alias("block"), hashed(2, shards).alias("home")),
        shards,
        blocks,
    )


def every(df: DataFrame, column: str, n: int) -> DataFrame:
    """Each row once for each number below ``n``."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def rows_of(table: pa.Table, id_col: str, vector_col: str) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Ids (ascending, each once), the matrix of their vectors, and the table in that order."""
    ids = table.column(id_col).to_numpy()
    flat = pc.list_flatten(table.column(vector_col)).to_numpy().reshape(len(ids), -1)
    order = np.lexsort((*flat.T[::-1], ids))
    order = order[np.r_[True, np.diff(ids[order]) != 0]] if len(order) else order
    return ids[order], flat[order], table.take(pa.array(order))


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query among what its shards found, with ``rank``."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
