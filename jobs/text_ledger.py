"""Ledger of a growing store of texts: takes what is new, measures it, and keeps the accounts of each source and language.

A file stream reads the files that the checkpoint has not seen (``availableNow``)
and drops rows whose id came before, in this run or an earlier one; rows without
an id are told apart by what they say.  Every text's words, characters, lines,
clock times and signature (equal where texts differ in white space only) go to
``<output>/texts``, partitioned by shelf, a hash of the source, and batch: a
batch that runs again after a failure writes its own partitions over.

``<output>/ledger``, partitioned by shelf, has one row for each source and
language with sums, distinct signatures and exact percentiles of the words.  Its
rows carry the last batch that is in them.  That is a mark for each shelf: only
shelves with a later batch are read and written again, also where a run stopped
between the two steps.  A run without new files changes nothing.

    python -m jobs.text_ledger DOCUMENTS OUTPUT --config jobs/text_ledger.json
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import scalars
from pulsegrid.operators import aggregates
from pulsegrid.streaming import incremental

from .common import command, log, replace_partitions, settings, table

DEFAULTS = {"shelves": 16, "files_per_batch": 200, "percentiles": [0.5, 0.9]}
COLUMNS = ["doc_id", "text", "lang", "source"]
MEASURES = ["words", "chars", "lines", "times"]
TEXTS = "doc_id bigint, source string, lang string, words bigint, chars bigint, lines bigint, times bigint, signature string, shelf int, batch bigint"
#: The state of seen ids lies on the executors' disks, not in their memory.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def shelf(source: Column, shelves: int) -> Column:
    return (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % shelves).cast("int")


def pattern(path: str) -> str:
    """``path`` as a glob of itself, since a file stream takes a single file only so."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def measured(texts: DataFrame, shelves: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    plain = F.trim(F.regexp_replace(text, scalars.WHITE, " "))
    return texts.select(
        "doc_id", "source", "lang", scalars.word_count(text).alias("words"), F.length(text).cast("long").alias("chars"),
        F.when(text == "", 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("lines"),
        scalars.clock_count(text).alias("times"), scalars.short_id(plain).alias("signature"), shelf(F.col("source"), shelves).alias("shelf"),
    )


def taken(spark: SparkSession, documents: str, output: str, config: dict) -> tuple[int, int]:
    """Adds the texts that are new: the numbers of rows that the stream read (of its last batches) and of new texts."""
    stream = incremental.files(spark, pattern(documents), spark.read.parquet(documents).select(COLUMNS).schema, config["files_per_batch"])
    rows = measured(stream, config["shelves"]).withColumn("unnamed", F.when(F.col("doc_id").isNull(), F.concat_ws("|", "signature", "source", "lang")))
    once = rows.dropDuplicates(["doc_id", "unnamed"]).drop("unnamed")

    new = []

    def add(batch: DataFrame, number: int) -> None:
        seen = Observation()
        replace_partitions(batch.withColumn("batch", F.lit(number).cast("long")).observe(seen, F.count(F.lit(1)).alias("rows")), f"{output}/texts", ["shelf", "batch"])
        new.append(seen.get["rows"])

    query = once.writeStream.foreachBatch(add).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress), sum(new)


def accounts(rows: DataFrame, percentiles: list[float]) -> DataFrame:
    keys = ["shelf", "source", "lang"]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("texts"), F.countDistinct("signature").alias("distinct_texts"), *[F.sum(m).alias(m) for m in MEASURES],
        F.min("words").alias("least_words"), F.max("words").alias("most_words"),
    )
    steps = aggregates.exact_percentiles(rows, keys, "words", percentiles)
    marks = rows.groupBy("shelf").agg(F.max("batch").alias("batch"))
    same = (F.col("a.shelf") == F.col("b.shelf")) & F.col("a.source").eqNullSafe(F.col("b.source")) & F.col("a.lang").eqNullSafe(F.col("b.lang"))
    both = sums.alias("a").join(steps.alias("b"), same).select("a.*", *[F.col(f"b.{c}") for c in steps.columns if c not in keys])
    return both.join(marks, "shelf")


def behind(texts: DataFrame, ledger: DataFrame) -> list[int]:
    """Shelves with a batch that the ledger has not: no more than there are shelves."""
    last = texts.groupBy("shelf").agg(F.max("batch").alias("last"))
    done = ledger.groupBy("shelf").agg(F.max("batch").alias("done"))
    late = last.join(done, "shelf", "left").where("done IS NULL OR done < last")
    return sorted(r["shelf"] for r in late.collect())


def run(spark: SparkSession, documents: str, output: str, config: dict) -> str:
    """Takes what is new below ``documents`` and returns the folder of the ledger."""
    output = output.rstrip("/")
    with settings(spark, STATE):
        read, new = taken(spark, documents, output, config)
    log.info("read %d rows from new files of %s; %d texts are new", read, documents, new)
    texts = table(spark, f"{output}/texts", TEXTS, ["shelf", "batch"])
    shelves = behind(texts, table(spark, f"{output}/ledger", "source string, batch bigint, shelf int", ["shelf"]))
    if shelves:
        ledger = accounts(texts.where(F.col("shelf").isin(shelves)), config["percentiles"])
        replace_partitions(ledger.repartition("shelf"), f"{output}/ledger", ["shelf"])
    log.info("wrote %d of %d shelves of %s/ledger: %s", len(shelves), config["shelves"], output, shelves)
    return f"{output}/ledger"


if __name__ == "__main__":
    command("text_ledger", __doc__, {"documents": "folder, file or glob of the texts", "output": "folder of the ledger"}, DEFAULTS, run)
