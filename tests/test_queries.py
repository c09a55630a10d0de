"""Every registered query beside its DuckDB SQL; those without SQL run and have rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from jobs import queries as jobs
from pulsegrid.plans import registry

QUERIES, ORACLE_SQL = registry.QUERIES | jobs.QUERIES, registry.ORACLE_SQL | jobs.ORACLE_SQL


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None:
        return x
    return float(x) if isinstance(x, int) else str(x)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    key = lambda r: str(r)
    assert sorted((tuple(map(plain, r)) for r in rows), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
