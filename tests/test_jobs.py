"""The jobs: growing input, refreshed years, stopped runs, and the same result again."""

from __future__ import annotations

import json
import logging
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, queries, text_ledger, yearly_accounts

SCHEMA = "doc_id bigint, text string, lang string, source string"


def rows(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect() if columns else df.collect()))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def ledger(spark, output):
    return rows(spark.read.parquet(f"{output}/ledger"), *queries.LEDGER)


def add(spark, store, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(store))


def test_ledger_takes_only_what_is_new(spark, sf_dir, tmp_path, caplog):
    """Half the table and then the rest, with rows that come twice, gives what one run over all gives."""
    store, output, whole = tmp_path / "store", tmp_path / "out", tmp_path / "whole"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.where("doc_id < 90").write.parquet(str(store))
    text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    first, before = ledger(spark, output), files(output)
    docs.where("doc_id >= 60").write.mode("append").parquet(str(store))
    with caplog.at_level(logging.INFO, "jobs"):
        text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    assert f"{docs.where('doc_id >= 90').count()} texts are new" in caplog.text
    assert first != ledger(spark, output)
    texts = spark.read.parquet(f"{output}/texts")
    assert texts.count() == docs.count() == texts.select("doc_id").distinct().count()
    text_ledger.run(spark, f"{sf_dir}/documents.parquet", str(whole), text_ledger.DEFAULTS)
    assert ledger(spark, output) == ledger(spark, whole)
    # Texts of the first run stay as they were written.
    assert all(files(output).get(p) == t for p, t in before.items() if "/texts/" in p)
    after = files(output)
    text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    assert files(output) == after


def test_ledger_touches_only_shelves_with_new_texts(spark, tmp_path):
    store, output = tmp_path / "store", tmp_path / "out"
    add(spark, store, [(i, f"text {i}", "en", f"s{i % 9}") for i in range(40)])
    text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    before = files(output / "ledger")
    add(spark, store, [(100, "one more", "en", "s3")])
    text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    after = files(output / "ledger")
    assert len(set(before) - set(after)) == len(set(after) - set(before)) == 1


def test_ledger_catches_up_after_a_stop(spark, tmp_path, monkeypatch):
    """A run that ends between its two steps leaves shelves behind; the next one, without new files, mends them."""
    store, output = tmp_path / "store", tmp_path / "out"
    add(spark, store, [(1, "a b", "en", "x")])
    text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    add(spark, store, [(2, "c d e", "en", "x")])

    def stop(*a):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(text_ledger, "accounts", stop)
        with pytest.raises(RuntimeError):
            text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    assert spark.read.parquet(f"{output}/ledger").first()["texts"] == 1
    text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    assert spark.read.parquet(f"{output}/ledger").first()["texts"] == 2


def test_ledger_of_nulls_empty_texts_and_ids_of_none(spark, tmp_path):
    store, output = tmp_path / "store", tmp_path / "out"
    data = [(1, None, "en", None), (2, "", None, ""), (None, "at 9:05 and 23:59, not 24:00\n", "en", "s"), (None, "other", "en", "s"), (None, "other", "en", "s"), (3, " at  9:05 and 23:59, not 24:00", "en", "s")]
    add(spark, store, data)
    text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    texts = {(r["doc_id"], r["words"]): r for r in spark.read.parquet(f"{output}/texts").collect()}
    assert len(texts) == 5  # the two equal rows without an id are one
    assert texts[3, 6]["times"] == texts[None, 6]["times"] == 2 and texts[None, 6]["lines"] == 2 and texts[2, 0]["lines"] == 0
    got = {(r["source"], r["lang"]): r for r in spark.read.parquet(f"{output}/ledger").collect()}
    assert (got["s", "en"]["texts"], got["s", "en"]["distinct_texts"], got["s", "en"]["words"]) == (3, 2, 13)
    assert got[None, "en"]["texts"] == got["", None]["texts"] == 1


def test_ledger_of_an_empty_store(spark, tmp_path):
    store, output = tmp_path / "store", tmp_path / "out"
    spark.createDataFrame([], SCHEMA).write.parquet(str(store))
    target = text_ledger.run(spark, str(store), str(output), text_ledger.DEFAULTS)
    assert spark.read.schema("texts bigint").parquet(target).count() == 0


def test_settings_are_put_back(spark, sf_dir, tmp_path):
    name = next(iter(text_ledger.STATE))
    before = spark.conf.get(name, None)
    text_ledger.run(spark, f"{sf_dir}/documents.parquet", str(tmp_path / "out"), text_ledger.DEFAULTS)
    assert spark.conf.get(name, None) == before
    with common.settings(spark, {"spark.pulsegrid.test": "1"}):
        assert spark.conf.get("spark.pulsegrid.test") == "1"
    assert spark.conf.get("spark.pulsegrid.test", None) is None


TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "region")


def test_accounts_of_growing_tables(spark, sf_dir, tmp_path):
    """Orders until 1996, then all of them: refreshing the new years gives what one run over all gives."""
    tables, output, whole = tmp_path / "tables", tmp_path / "out", tmp_path / "whole"
    for t in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df.where("year(o_orderdate) <= 1996").write.parquet(f"{tables}/{t}.parquet") if t == "orders" else df.write.parquet(f"{tables}/{t}.parquet")
    target = yearly_accounts.run(spark, str(tables), str(output), yearly_accounts.DEFAULTS)
    assert spark.read.parquet(target).agg(F.max("year")).first()[0] == 1996
    before = files(output)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.where("year(o_orderdate) > 1996").write.mode("append").parquet(f"{tables}/orders.parquet")
    years = sorted(r[0] for r in orders.where("year(o_orderdate) > 1996").select(F.year("o_orderdate")).distinct().collect())
    yearly_accounts.run(spark, str(tables), str(output), yearly_accounts.DEFAULTS | {"years": years})
    yearly_accounts.run(spark, sf_dir, str(whole), yearly_accounts.DEFAULTS)
    assert rows(spark.read.parquet(target)) == rows(spark.read.parquet(f"{whole}/accounts"))
    assert before.items() <= files(output).items()
    yearly_accounts.run(spark, str(tables), str(output), yearly_accounts.DEFAULTS)
    assert rows(spark.read.parquet(target)) == rows(spark.read.parquet(f"{whole}/accounts"))


def test_a_year_changes_the_next_one_too(spark, tmp_path):
    paths = [("a", "b", "r", y, 10.0 * y, 1.0, 2.0, 3.0) for y in (2000, 2001, 2003)] + [("b", "a", "r", 2001, 5.0, 0.0, 0.0, 1.0), ("a", "a", "r", 2001, 9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(paths, "origin string, destination string, region string, year int, rolling double, dwell double, transfer double, weight double")
    got = {(r["year"], r["level"], r["origin"], r["destination"]): r for r in yearly_accounts.accounts(df, 0.5, 6).collect()}
    assert got[2001, "pair", "a", "b"]["total_change"] == 10 and got[2000, "pair", "a", "b"]["total_change"] is None and got[2003, "pair", "a", "b"]["total_change"] is None
    net = got[2001, "network", None, None]
    assert net["weight"] == 4 and net["members"] == 2 and net["rolling"] == (3 * 20010 + 5) / 4
    assert [got[2001, "pair", *p]["heavy"] for p in (("a", "b"), ("b", "a"))] == [True, False]


def test_command_lines(spark, sf_dir, tmp_path):
    """Each job runs by its command line with its own configuration file; an unknown setting fails."""
    root = Path(__file__).parent.parent
    for job in ("text_ledger", "yearly_accounts"):
        known = {"text_ledger": text_ledger, "yearly_accounts": yearly_accounts}[job].DEFAULTS
        assert common.config(str(root / "jobs" / f"{job}.json"), known) == known
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"yeers": []}))
    with pytest.raises(ValueError, match="yeers"):
        common.config(str(bad), yearly_accounts.DEFAULTS)
    done = subprocess.run([sys.executable, "-m", "jobs.yearly_accounts", sf_dir, str(tmp_path / "out"), "--config", "jobs/yearly_accounts.json"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read from" in done.stderr and "wrote to" in done.stderr
    assert spark.read.parquet(str(tmp_path / "out" / "accounts")).where("level = 'network'").count() > 3
