"""The pipeline's stages on odd rows and on the smallest table, and SQL beside the queries that have it."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from pulsegrid.llm import queries

from .test_documents import ODD, SCHEMA, brute_components


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    rows = [(i, t, "en", None, len(t or ""), 0.5, "k", "s", 1, 2, "key", 3, None, 4) for i, t in ODD]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == set(brute_components(ODD).values()) | {None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_with_clashing_names(spark, sf_dir):
    """Columns named like those that operators make on the way pass through."""
    names = ["__score", "__scored", "__words", "__gone", "__kept", "__whole", "__id", "__row", "score", "scored", "words", "gone", "kept", "whole", "id", "row", "several", "own", "hashed", "cut", "hash", "a b", "x.y"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert all(r["x.y"] == f"x.y{r['doc_id']}" for r in out.collect()), name


def test_pipeline_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count()
    held = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").count()
    assert held > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
