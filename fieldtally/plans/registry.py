"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 4
# Added before rounding so that ties fall the same way in both engines.
NUDGE = 1e-7


def presentable(df: DataFrame) -> DataFrame:
    """Dates as text, booleans as 0/1, doubles rounded, for comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + NUDGE, DIGITS) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, dates: str = "", bools: str = "", nums: str = ""):
    """Register a query; ``dates``, ``bools`` and ``nums`` name the columns of
    the SQL result that get the same presentation as on the Spark side."""

    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: presentable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = oracle(sql, dates, bools, nums)
        return fn

    return wrap


def oracle(body: str, dates: str, bools: str, nums: str) -> str:
    swaps = [f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dates.split()]
    swaps += [f"CAST({c} AS INTEGER) AS {c}" for c in bools.split()]
    swaps += [f"round(CAST({c} AS DOUBLE) + 0.0000001, {DIGITS}) + 0.0 AS {c}" for c in nums.split()]
    star = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
    ctes = fx.cte_prefix(body)
    return f"{ctes}SELECT {star} FROM (\n{body.strip()}\n) AS result"
