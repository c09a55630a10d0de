"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="pulsegrid-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared folder.

    ``spark.checkpoint.dir`` names that folder.  Where it is unset, only a local
    session (tests, a notebook) has a temporary one that all its tasks see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_dir()
    return f"{root.rstrip('/')}/pulsegrid-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: an Arrow batch holds a thousand rows and 4 MB, where the session has the library's defaults of ten thousand and 64 MB."""
    for name, default, own in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "4194304b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0): each such word becomes one letter and all else goes, so no array of words is made."""
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long"), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose values in ``column`` are about ``most_bytes`` at most, or one row."""
    if not batch.num_rows:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)


def free(columns: list[str], *names: str) -> tuple[str, ...]:
    """``names`` that no column has: underscores are put before those that are taken."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


#: What empties tables that a module keeps only for the length of a task.
TABLES: list[Callable[[], None]] = []


def trim(collect: bool = False) -> None:
    """Give freed memory back to the system; a worker lives on for other tasks."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def spread_join(rows: DataFrame, other: DataFrame, on: list[str], counts: DataFrame, total: int, deal: list[str]) -> DataFrame:
    """``rows`` joined with ``other`` (few rows for each key), the rows of a very frequent key dealt to several tasks by ``deal``.

    ``counts`` has the number of ``rows`` of each key as ``rows``.  A key is
    frequent with more than its share of the ``total``, so there are at most a
    few for each partition, and their table may be broadcast at any size of
    the input.
    """
    share = max(1000, total // (4 * partitions(rows.sparkSession)))
    salts, salt = free([*rows.columns, *other.columns], "salts", "salt")
    hot = F.broadcast(counts.where(F.col("rows") > share).select(*on, F.ceil(F.col("rows") / share).cast("int").alias(salts)))
    dealt = rows.join(hot, on, "left").withColumn(salt, F.pmod(F.xxhash64(*deal), F.coalesce(salts, F.lit(1))).cast("int")).drop(salts)
    each = other.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    return dealt.join(each, [*on, salt]).drop(salt)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` whose workers keep no freed memory between tasks.

    Spark looks columns up by name there, so a name with a dot reaches ``f`` with another sign in its place.
    """
    if any("." in c for c in df.columns):
        df = df.toDF(*[c.replace(".", "\u00b7") for c in df.columns])

    def run(batches):
        try:
            yield from f(batches)
        finally:
            for clear in TABLES:
                clear()
            trim(collect=True)

    return df.mapInArrow(run, schema)
