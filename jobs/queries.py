"""The jobs as queries: each runs twice into one new folder of the shared one and gives the output as it stands then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans import inputs

from . import text_ledger, yearly_accounts

LEDGER = ["source", "lang", "texts", "distinct_texts", *text_ledger.MEASURES, "least_words", "most_words", "p0500", "p0900"]


def job1_yearly_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All years, then three of them again."""
    output = inputs.shared_folder(spark, "yearly-accounts")
    yearly_accounts.run(spark, sf_dir, output, yearly_accounts.DEFAULTS)
    target = yearly_accounts.run(spark, sf_dir, output, yearly_accounts.DEFAULTS | {"years": [1995, 1996, 1999]})
    return spark.read.parquet(target)


def job2_text_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts (with their ids) and the ledger's rows, told apart by ``level``; the second run finds nothing new."""
    output = inputs.shared_folder(spark, "text-ledger")
    for _ in range(2):
        target = text_ledger.run(spark, f"{sf_dir}/documents.parquet", output, text_ledger.DEFAULTS)
    texts = spark.read.schema(text_ledger.TEXTS).parquet(f"{output}/texts")
    ledger = spark.read.parquet(target)
    one = texts.select(F.lit("text").alias("level"), "doc_id", "source", "lang", *text_ledger.MEASURES, "signature", "shelf")
    rows = ledger.select(F.lit("ledger").alias("level"), *LEDGER, F.col("shelf").cast("int").alias("shelf"))
    return one.unionByName(rows, allowMissingColumns=True)


QUERIES = {"job1_yearly_accounts": job1_yearly_accounts, "job2_text_ledger": job2_text_ledger}

_PARTS = ("rolling", "dwell", "transfer")
_MEANS = ", ".join(f"sum(weight * {p}) / sum(weight) AS {p}" for p in _PARTS)
_NAMES = "region, origin, destination"
_ROUNDED = ["weight", *_PARTS, "total", *[f"{p}_share" for p in _PARTS], "total_change", "cum_share"]
#: CRC-32 of a source, bit by bit over its UTF-8 bytes.
_SHELF = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(octet_length(encode(coalesce(source, '')))),
  lambda i: list_transform(range(8), lambda k: (CAST('0x' || substr(hex(encode(coalesce(source, ''))), CAST(2 * i + 1 AS INT), 2) AS BIGINT) >> CAST(k AS INT)) & 1)))),
  lambda x, y: xor(x >> 1, CASE WHEN xor(x, y) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 16"""

ORACLE_SQL = {
    "job1_yearly_accounts": f"""
WITH {inputs.PATHS},
pairs AS (SELECT year, {_NAMES}, count(*) AS members, sum(weight) AS weight, {_MEANS} FROM paths WHERE origin <> destination GROUP BY ALL),
sums AS (
  SELECT 'pair' AS level, * FROM pairs
  UNION ALL SELECT 'origin', year, region, origin, NULL, count(*), sum(weight), {_MEANS} FROM pairs GROUP BY year, region, origin
  UNION ALL SELECT 'region', year, region, NULL, NULL, count(*), sum(weight), {_MEANS} FROM pairs GROUP BY year, region
  UNION ALL SELECT 'network', year, NULL, NULL, NULL, count(*), sum(weight), {_MEANS} FROM pairs GROUP BY year),
totals AS (SELECT *, rolling + dwell + transfer AS total FROM sums),
placed AS (
  SELECT t.*, {", ".join(f"t.{p} / t.total AS {p}_share" for p in _PARTS)}, t.total - b.total AS total_change,
    row_number() OVER w AS rank, sum(t.weight) OVER (w ROWS UNBOUNDED PRECEDING) / sum(t.weight) OVER (PARTITION BY t.year, t.level) AS cum_share,
    t.weight / sum(t.weight) OVER (PARTITION BY t.year, t.level) AS own
  FROM totals t LEFT JOIN totals b ON b.year = t.year - 1 AND b.level = t.level AND b.region IS NOT DISTINCT FROM t.region AND b.origin IS NOT DISTINCT FROM t.origin AND b.destination IS NOT DISTINCT FROM t.destination
  WINDOW w AS (PARTITION BY t.year, t.level ORDER BY t.weight DESC, t.region NULLS FIRST, t.origin NULLS FIRST, t.destination NULLS FIRST))
SELECT CAST(year AS INT) AS year, level, {_NAMES}, members, {", ".join(f"round({m}, 6) AS {m}" for m in _ROUNDED)}, rank, cum_share - own < 0.5 AS heavy FROM placed""",
    "job2_text_ledger": f"""
WITH plain AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
texts AS (
  SELECT 'text' AS level, doc_id, source, lang, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars,
    CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS BIGINT) AS lines,
    CAST(len(regexp_extract_all(text, '(^|[^0-9:])([01]?[0-9]|2[0-3]):[0-5][0-9]')) AS BIGINT) AS times,
    substr(sha1(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')), 1, 16) AS signature, CAST({_SHELF} AS INT) AS shelf
  FROM plain),
ledger AS (
  SELECT 'ledger' AS level, source, lang, count(*) AS texts, count(DISTINCT signature) AS distinct_texts, {", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in text_ledger.MEASURES)},
    min(words) AS least_words, max(words) AS most_words, quantile_cont(words, 0.5) AS p0500, quantile_cont(words, 0.9) AS p0900, any_value(shelf) AS shelf
  FROM texts GROUP BY source, lang)
SELECT * FROM texts UNION ALL BY NAME SELECT * FROM ledger""",
}
