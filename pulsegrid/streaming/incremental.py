"""Incremental mode: running loads and live appends as Structured Streaming; a checkpoint holds the cursor and the state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources import readers, writers


def files(spark: SparkSession, folder: str, schema: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def once(stream: DataFrame, event: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each ``event``; one that comes again within ``late`` of it is dropped by the state, which is dropped behind the watermark.

    Rows without a time take no part; rows older than the watermark are late and are dropped.
    """
    return stream.where(F.col(time).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark(list(event))


def accounts(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], event: Sequence[str], time: str, late: str, weight: str, values: Sequence[str]) -> StreamingQuery:
    """Weighted accounts by ``keys`` in the table at ``path``, each event counted once: ``n``, ``weight``, ``weighted_<value>`` and the ``first`` time.

    All of these merge by sums and minima, so a batch is aggregated by itself
    and added to what stands; means are taken on reading (``means``).  A null
    weight or value adds nothing.  What was seen is in the checkpoint, so a run
    over more files goes on where the last one ended.
    """
    if taken := {"n", "weight", "first", *(f"weighted_{v}" for v in values)} & set(keys):
        raise ValueError(f"keys are named like accounts: {sorted(taken)}")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = once(stream, event, time, late).select(
        *keys, F.lit(1).cast("long").alias("n"), w.alias("weight"), *[(w * F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(f"weighted_{v}") for v in values], F.col(time).alias("first")
    )
    return merged(rows, path, checkpoint, keys, ["n", "weight", *(f"weighted_{v}" for v in values)], ["first"])


def means(accounts: DataFrame, values: Sequence[str]) -> DataFrame:
    """Accounts with the weighted mean of each value; null where nothing weighs."""
    return accounts.withColumns({f"mean_{v}": F.col(f"weighted_{v}") / F.nullif(F.col("weight"), F.lit(0.0)) for v in values})


def windowed(stream: DataFrame, time: str, late: str | None, width: str, keys: Sequence[str], value: str) -> DataFrame:
    """Loads by window with a bound on lateness (``None``: the stream has its watermark): a window is final, and its state goes, behind the watermark."""
    marked = stream.withWatermark(time, late) if late else stream
    return marked.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("value")).select("window.start", "window.end", *keys, "n", "value")


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Only rows that are not on disk yet are added, whole batches at a time."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], sums: Sequence[str], least: Sequence[str]) -> StreamingQuery:
    """Each batch is merged into the table at ``path``; a batch that is run again after a failure is not added twice."""

    def merge(batch: DataFrame, number: int) -> None:
        state = readers.current(batch.sparkSession, path)
        if state is not None and state.where(F.col("batch") >= number).limit(1).count():
            return
        new = writers.merged_state(state.drop("batch") if state is not None else None, batch, keys, sums, least)
        writers.replaced(new.withColumn("batch", F.lit(number).cast("long")), path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows and batches so far, for a heartbeat."""

    def __init__(self):
        self.rows = self.batches = 0

    def onQueryStarted(self, event): ...

    def onQueryIdle(self, event): ...

    def onQueryTerminated(self, event): ...

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.batches += 1
