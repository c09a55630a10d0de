"""What the jobs share: configuration, settings that are put back, partitions that are replaced, and the command line."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config(path: str, known: dict) -> dict:
    """The file's settings over the ``known`` ones; a name that is not known fails."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return known | given


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes ``df`` over the partitions that it has rows of and no others: the same rows again change nothing."""
    df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def table(spark: SparkSession, path: str, schema: str, by: list[str]) -> DataFrame:
    """The Parquet table at ``path``, partitioned by ``by``; before its first run it is made without rows."""
    spark.createDataFrame([], schema).write.partitionBy(*by).mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def command(name: str, description: str, paths: dict[str, str], known: dict, run: Callable) -> None:
    """The command line of a job: one argument for each path, a configuration file; the only place that makes and stops a session."""
    parser = argparse.ArgumentParser(prog=name, description=description)
    for argument, text in paths.items():
        parser.add_argument(argument, help=text)
    parser.add_argument("--config", help="a JSON file with any of: " + ", ".join(sorted(known)))
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    chosen = config(given.pop("config"), known) if given["config"] else (given.pop("config"), known)[1]
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *given.values(), chosen)
    finally:
        spark.stop()
