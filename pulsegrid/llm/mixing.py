"""Mixing sources to target weights by systematic sampling, with DataFrame functions alone.

Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share all
words.  No target exceeds ``MOST`` times the words of its source: what is above
is shared again by weight among the others until none is above.  A source's
rate, target over words, is the expected number of copies of each of its
documents.  Documents stand in order of size; the prefix sum of the expected
copies plus one offset of the source, drawn by a keyed hash, passes integers,
and a document is emitted once for each that it passes: no more often than the
rate rounded up, so ``MOST`` times at most.  In this order the words taken from
a source differ from its target by less than its longest document.

Rates are whole multiples of 2^-30, so sums are exact, whatever their length.

No source meets in one task: rows are dealt by ranges of (source, size, id,
row), numbered where they lie, and only one row for each range and source is
summed.  Targets take one aggregate over the sources for each round of sharing.

Defined results: null text has no words; a null source is a source of its own,
an empty one too; rows that repeat stand each for itself, null ids included; an
empty table gives no rows; sources without words have target 0; a document
without words takes 0.  Other columns, whatever they are called, do not matter
to ``allocation`` and are carried by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, free, partitions, table, word_count, written

#: A source repeats up to so many times.
MOST = 3
#: Weights, in turn.
WEIGHTS = 3
#: Bits behind the point of an expected number of copies.
BITS = 30
SEED = "mix-1"


def offset(source: Column, seed: str = SEED) -> Column:
    """28 random bits of a source as a number of ``BITS`` bits."""
    named = F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    return F.conv(F.substring(F.md5(named), 1, 7), 16, 10).cast("long") * (1 << (BITS - 28))


def targets(sizes: DataFrame, seed: str = SEED) -> DataFrame:
    """``source``, ``size`` (rows) to ``source``, ``source_size``, ``weight``, ``target`` and the ``step`` and ``offset`` of its prefix sums.

    One row for each source; the sources are ranked by ranges as rows are.
    """
    sums = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = numbered(sums, [], [F.col("source").asc_nulls_last()], "at")
    weighed = written(ranked.select("source", "source_size", (F.col("at") % WEIGHTS + 1).alias("weight")), "weights")
    exact = lambda x: F.lit(x).cast("decimal(38,0)") if isinstance(x, int) else x.cast("decimal(38,0)")
    cap = F.lit(MOST) * F.col("source_size")
    total, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, left = total, weights
    while left:
        # A larger share of the rest only ever caps further sources.
        above = exact(cap) * exact(left) <= exact(rest) * F.col("weight")
        capped, heavy = weighed.where(above).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - capped, weights - heavy) == (rest, left):
            break
        rest, left = total - capped, weights - heavy
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(left)) if left else cap.cast("double")
    target = F.least(cap.cast("double"), share)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    out = weighed.withColumn("target", target).withColumn("step", F.least(F.floor(rate * float(1 << BITS)), F.lit(MOST << BITS))).withColumn("offset", offset(F.col("source"), seed))
    out = written(out, "targets")
    for old in (sums, weighed):
        dropped(old.sparkSession, old)
    return out


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of each row within its ``group`` (from 0) in ``order``; rows that tie in all of it are numbered in any order.

    Rows are dealt by ranges of group and order, sorted there and numbered by
    their place.  Only counts of each range and group are added up, so no task
    holds a group.  ``df`` is read more than once: it should be a table.
    """
    place, part, first, count, begin = free(df.columns, "place", "part", "first", "count", "begin")
    keys = [*[F.col(f"`{c}`").asc_nulls_last() for c in group], *order]
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    # The high bits are the partition, the low 33 the row in it.
    lying = written(dealt.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1)), name)
    quoted = [F.col(f"`{c}`") for c in group]
    counts = lying.groupBy(*quoted, part).agg(F.min(place).alias(first), F.count("*").alias(count))
    before = Window.partitionBy(*quoted).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range that the group meets
    starts = counts.select(*[c.alias(f"{begin}_{i}") for i, c in enumerate(quoted)], F.col(part).alias(f"{part}_of"), (F.coalesce(F.sum(count).over(before), F.lit(0)) - F.col(first)).alias(begin))
    same = F.col(part) == F.col(f"{part}_of")
    for i, c in enumerate(quoted):
        same &= c.eqNullSafe(F.col(f"{begin}_{i}"))
    return lying.join(starts, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col(place) + F.col(begin)).alias(name))


def allocation(docs: DataFrame, keep: list[str] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row's ``size``, ``source_size``, ``target`` and ``copies``, beside its id and the columns of ``keep``."""
    keep = keep or []
    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    sizes = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), *named, F.monotonically_increasing_id().alias("row"))
    sizes = written(sizes, "sizes")
    shares = targets(sizes, seed)
    # The row tells equal rows apart, so that many of them are dealt to several ranges.
    placed = numbered(sizes, ["source"], [F.col("size"), F.col("id"), F.col("row")], "at")
    found = placed.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    mask = (1 << BITS) - 1
    # What the prefix sum of the rows before, with the offset, has behind the point.
    behind = (F.col("at").bitwiseAND(mask) * F.col("step") + F.col("offset")).bitwiseAND(mask)
    copies = F.shiftright(behind + F.col("step"), BITS)
    return found.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", copies.alias("copies"))


def mixture(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken; ``copy`` counts from 1."""
    (copy,) = free(docs.columns, "copy")
    plan = allocation(docs.withColumns({f"__{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}), [f"__{i}" for i in range(len(docs.columns))], seed, id_col, text_col, source_col)
    return plan.where("copies > 0").select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))


def op12_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = allocation(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The fixed point of the shares by sorting the sources by limit over weight; prefix sums by a window.
OP12_SQL = """
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS heavy
  FROM sources WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT total - capped AS rest, weights - heavy AS rest_weight FROM levels
  WHERE 3 * source_size * (weights - heavy) > (total - capped) * weight ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(3.0::DOUBLE * source_size, CAST((SELECT rest FROM level) AS DOUBLE) * weight / CAST((SELECT rest_weight FROM level) AS DOUBLE)), 0.0) AS target
  FROM sources),
steps AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size * 1073741824) AS BIGINT), 3221225472) ELSE 0 END AS step,
    CAST('0x' || substr(md5('mix-1:' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 7) AS BIGINT) * 4 AS off
  FROM targets),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS place FROM sizes)
SELECT doc_id, size, source_size, target,
  CAST(((CAST(place AS HUGEINT) + 1) * step + off) // 1073741824 - (CAST(place AS HUGEINT) * step + off) // 1073741824 AS BIGINT) * size AS taken
FROM placed JOIN steps ON placed.source IS NOT DISTINCT FROM steps.source
"""
