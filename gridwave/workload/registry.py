"""Names, Spark functions and equivalent SQL of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Decimals kept of floating-point results, on both sides of a comparison.
DIGITS = 8


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name."""

    def register(function: Query) -> Query:
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Named columns rounded, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in columns})


def nonzero(df: DataFrame, *columns: str) -> DataFrame:
    """``rounded``, and without the rows in which all of the columns round to zero."""
    keep: Column = F.lit(False)
    for c in columns:
        keep = keep | (F.col(c) != 0)
    return rounded(df, *columns).where(keep)


# --- the same, in SQL ---------------------------------------------------------------------------


def sql_round(expression: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0"


def sql_nonzero(source: str, keys: str, *columns: str) -> str:
    values = ", ".join(f"{sql_round(c)} AS {c}" for c in columns)
    keep = " OR ".join(f"{c} <> 0" for c in columns)
    return f"SELECT * FROM (SELECT {keys}, {values} FROM {source}) WHERE {keep}"


def sql_mod(a: str, n: str) -> str:
    return f"((({a}) % ({n}) + ({n})) % ({n}))"


# Index extents, as used by the Spark side.
SQL_EXTENTS = """extents AS (
  SELECT (SELECT max(c_custkey) + 1 FROM customer)::BIGINT AS nc,
         (SELECT max(p_partkey) + 1 FROM part)::BIGINT AS np,
         (SELECT max(s_suppkey) + 1 FROM supplier)::BIGINT AS ns,
         (SELECT max(n_nationkey) + 1 FROM nation)::BIGINT AS nn,
         (SELECT max(r_regionkey) + 1 FROM region)::BIGINT AS nr)"""
