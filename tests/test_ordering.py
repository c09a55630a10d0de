"""Running sums over ranges, and what stands on them, beside plain versions; one group holds a third of all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import aggregates as A
from pulsegrid.operators import ordering as O


def data(n=900, seed=1):
    rnd = random.Random(seed)
    return [(("hot" if i % 3 == 0 else rnd.choice(["a", "b", None])), rnd.choice([None, *range(40)]), rnd.choice([0.0, 1.0, 2.5]), i) for i in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(data(), "g string, v int, w double, i int").repartition(7)


def groups(rows):
    out = {}
    for g, v, w, i in rows:
        out.setdefault(g, []).append((v, w, i))
    return out


def test_numbers_and_sums(df):
    got = {r["i"]: (r["n"], r["s"], r["t"]) for r in O.running(O.numbered(df, ["g"], [F.desc_nulls_last("v"), "i"], "n"), ["g"], [F.desc_nulls_last("v"), "i"], "w", "s", "t").collect()}
    for rows in groups(data()).values():
        total = 0.0
        for n, (v, w, i) in enumerate(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2])), 1):
            total += w
            assert got[i][:2] == (n, pytest.approx(total)) and got[i][2] == pytest.approx(sum(r[1] for r in rows))
    assert [r["n"] for r in O.numbered(df, [], ["i"], "n").orderBy("i").collect()] == list(range(1, 901))


def test_percentiles(df, spark):
    got = {r["g"]: r for r in A.exact_percentiles(df, ["g"], "v", [0.0, 0.05, 0.5, 0.913, 1.0]).collect()}
    for g, rows in groups(data()).items():
        values = [r[0] for r in rows if r[0] is not None]
        assert [got[g][f"p{round(q * 1000):04d}"] for q in (0.0, 0.05, 0.5, 0.913, 1.0)] == pytest.approx(list(np.percentile(values, [0, 5, 50, 91.3, 100])))
    none = A.exact_percentiles(spark.createDataFrame([("x", None)], "g string, v int"), ["g"], "v", [0.5]).collect()
    assert [tuple(r) for r in none] == [("x", None)]
    assert A.exact_percentiles(df.where("false"), ["g"], "v", [0.5]).count() == 0


def test_weighted_quantiles(df):
    got = {r["g"]: r for r in A.weighted_quantiles(df, ["g"], "v", "w", [0.25, 0.9]).collect()}
    for g, rows in groups(data()).items():
        rows = sorted((v, w) for v, w, _ in rows if v is not None and w > 0)
        total = sum(w for _, w in rows)
        for q in (0.25, 0.9):
            cum = 0.0
            for v, w in rows:
                cum += w
                if cum >= q * total - 1e-9 * total:
                    assert got[g][f"q{round(q * 1000):04d}"] == v
                    break


def test_rank_correlation(df):
    rows = [(v, w) for _, v, w, _ in data() if v is not None]

    def ranks(x):
        x = np.array(x)
        return np.array([(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x])

    r = A.rank_correlation(df, "v", "w").first()
    assert r["n"] == len(rows) and r["rho"] == pytest.approx(np.corrcoef(*map(ranks, zip(*rows)))[0, 1])
