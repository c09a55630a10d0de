"""A training corpus from ``documents``: five stages, each over all that the one before has kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``docs``, whatever further ones there are and whatever they are called.
``run`` writes each stage's rows as Parquet in the cluster's shared
folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import jaccard, packing, quality, secrets, substrings
from pulsegrid.llm.common import dropped, free, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Without any label none does."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least id.

    A row with a null id stays.  Rows that repeat an id are one document, of
    which the row of least text stays; without words it is in no group.
    """
    groups = jaccard.jaccard_components(docs)
    id_, row_, several = free(docs.columns, "id", "row", "several")
    counts = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_)).agg((F.count("*") > 1).alias(several))
    named = docs.join(counts, docs["doc_id"] == counts[id_]).drop(id_)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    row = F.struct(*others)
    # Only ids that repeat are aggregated, the least text first.
    first = named.where(several).groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias(row_))
    one = first.select("doc_id", *[F.col(f"{row_}.`{c}`").alias(c) for c in docs.columns if c != "doc_id"])
    single = named.where(~F.col(several)).drop(several)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(columns).unionByName(one.select(columns)).unionByName(docs.where("doc_id IS NULL"))


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that an earlier document has go; a text that loses none is unchanged, and one that loses all goes."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    whole, words, gone, kept = free(docs.columns, "whole", "words", "gone", "kept")
    cut = substrings.remove_repeated(docs.withColumn(whole, F.col("text")), keep=(*others, whole), out=(words, gone, kept))
    some = F.col(gone) > 0
    out = cut.where(~some | (F.col(gone) < F.col(words))).withColumn("text", F.when(some, F.col(kept)).otherwise(F.col(whole)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, also inside encodings, is replaced by ``[REDACTED]``."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in training sequences."""
    return packing.packed(spark, docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_substrings),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the decoding scan nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; a stage's table goes once the next one stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(spark, before)
        before = docs
    return docs
