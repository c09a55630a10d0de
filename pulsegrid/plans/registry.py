"""All registered queries of the library proper, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Operators of the blueprint that each query covers.
COVERS: dict[str, list[str]] = {}


def add(covers: str, sql: str | None = None, doubles: str = "", ints: str = "", digits: int = 6):
    """Registers a query under its function's name.

    ``doubles`` and ``ints`` name columns that both sides round to ``digits``
    places or cast to whole numbers, since sums differ in their last bits.
    """

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in doubles.split()} | {c: F.col(c).cast("long") for c in ints.split()})

        name = f.__name__
        QUERIES[name], COVERS[name] = run, covers.split()
        run.__doc__ = f.__doc__
        if sql:
            swaps = [f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql})" if swaps else sql
        return f

    return register


from . import demand_queries, domain_queries, relational_queries, scalar_queries, source_queries, timetable_queries  # noqa: E402, F401  they register themselves
