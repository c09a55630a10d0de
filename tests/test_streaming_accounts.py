"""Accounts of a stream that is stopped and started again, with repeated, late and empty rows, equal those of one batch."""

from __future__ import annotations

import datetime as dt

import pytest

from pulsegrid.sources import readers
from pulsegrid.streaming import incremental

SCHEMA = "path int, event int, kind string, at timestamp, w double, v double"
T = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
at = lambda minutes: T + dt.timedelta(minutes=minutes)
PARTS = [
    [(1, 1, "a", at(0), 2.0, 10.0), (1, 1, "a", at(0), 2.0, 10.0), (2, 1, "a", at(1), 1.0, 4.0), (3, 1, "b", at(2), None, 7.0), (4, 1, "b", None, 5.0, 5.0)],
    [(2, 1, "a", at(1), 1.0, 4.0), (1, 2, "a", at(-20), 1.0, 1.0), (5, 1, None, at(40), 3.0, None)],  # a repeat, a late event, a null key and value
    [],
    [(5, 1, None, at(40), 3.0, None), (6, 1, "b", at(50), 2.0, 8.0)],
]


def test_accounts_after_restarts(spark, tmp_path):
    folder, state, cursor = (f"{tmp_path}/{n}" for n in ("in", "state", "cursor"))
    run = lambda: incremental.accounts(incremental.files(spark, folder, SCHEMA, 1), state, cursor, ["kind"], ["path", "event"], "at", "30 minutes", "w", ["v"]).awaitTermination()
    for part in PARTS:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run()
    run()  # nothing new
    rows = incremental.means(readers.current(spark, state), ["v"]).collect()
    got = {r["kind"]: (r["n"], r["weight"], r["weighted_v"], r["mean_v"], r["first"].astimezone(dt.timezone.utc)) for r in rows}
    assert got == {"a": (3, 4.0, 25.0, 6.25, at(-20)), "b": (2, 2.0, 16.0, 8.0, at(2)), None: (1, 3.0, 0.0, 0.0, at(40))}


def test_account_names_are_refused_as_keys(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = incremental.files(spark, f"{tmp_path}/in", SCHEMA).withColumnRenamed("kind", "n")
    with pytest.raises(ValueError, match="named like accounts"):
        incremental.accounts(stream, f"{tmp_path}/s", f"{tmp_path}/c", ["n"], ["path"], "at", "1 hour", "w", ["v"])
