"""Transforms and products of large operators that are never written out, over order facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.operators import matrix as mx
from gridwave.operators import measure, transforms
from gridwave.sources import tables
from gridwave.workload.algebra import extents
from gridwave.workload.registry import SQL_EXTENTS, query, rounded, sql_round

ROUNDS, STATES, SIZE = 10, 100, 256
FIRST_DAY = "1995-01-01"

# --- coins of any size ----------------------------------------------------------------------------


def daily(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """(o_orderpriority, x): orders of each of the first days, an array for each priority."""
    orders = tables.read(spark, folder, "orders", "o_orderpriority", "o_orderdate")
    day = F.date_diff(F.to_date("o_orderdate"), F.lit(FIRST_DAY).cast("date"))
    return transforms.arrays(orders, ["o_orderpriority"], day, F.lit(1), size)


def _sql_daily(size: int) -> str:
    day = f"date_diff('day', DATE '{FIRST_DAY}', o_orderdate::DATE)"
    return f"""x AS (SELECT o_orderpriority, {day} AS j, count(*)::DOUBLE AS v FROM orders
  WHERE {day} BETWEEN 0 AND {size - 1} GROUP BY ALL),
p AS (SELECT DISTINCT o_orderpriority FROM x), r AS (SELECT unnest(range({size})) AS i)"""


@query(
    f"""WITH {_sql_daily(2**ROUNDS)}
SELECT o_orderpriority, i, {sql_round(f"sum(CASE WHEN bit_count(i & j) % 2 = 0 THEN v ELSE -v END) / sqrt({2**ROUNDS})")} AS v
FROM x, r GROUP BY ALL"""
)
def c_hadamard_1024(spark: SparkSession, folder: str) -> DataFrame:
    """Walsh spectrum of daily orders: ten rounds of butterflies for each priority."""
    spectrum = transforms.elements(daily(spark, folder, 2**ROUNDS), ["o_orderpriority"], transforms.hadamard("x", ROUNDS))
    return rounded(spectrum, "v")


@query(
    f"""WITH {_sql_daily(STATES)}, s AS (SELECT o_orderpriority, sum(v) AS s FROM x GROUP BY ALL)
SELECT s.o_orderpriority, i, {sql_round(f"2 * s / {STATES} - coalesce(v, 0)")} AS v
FROM s, r LEFT JOIN x ON x.o_orderpriority = s.o_orderpriority AND x.j = r.i"""
)
def c_grover_100(spark: SparkSession, folder: str) -> DataFrame:
    """Daily orders reflected about their mean, for each priority."""
    return rounded(transforms.elements(daily(spark, folder, STATES), ["o_orderpriority"], transforms.grover("x")), "v")


@query(
    f"""WITH {_sql_daily(SIZE)},
t AS (SELECT o_orderpriority, i, v, i * j % 4 AS turn FROM x, r)
SELECT o_orderpriority, i,
  {sql_round(f"sum(CASE turn WHEN 0 THEN v WHEN 2 THEN -v ELSE 0 END) / sqrt({SIZE})")} AS re,
  {sql_round(f"sum(CASE turn WHEN 1 THEN v WHEN 3 THEN -v ELSE 0 END) / sqrt({SIZE})")} AS im
FROM t GROUP BY ALL"""
)
def c_fourier_256(spark: SparkSession, folder: str) -> DataFrame:
    """Spectrum of daily orders with phase i, by class, for each priority."""
    spectrum = transforms.elements(daily(spark, folder, SIZE), ["o_orderpriority"], transforms.fourier("x"), "re", "im")
    return rounded(spectrum, "re", "im")


# --- products with an operator that is not formed ---------------------------------------------------


@query(
    f"""WITH {SQL_EXTENTS}
SELECT p_size::BIGINT * nn + s_nationkey AS "row", 0::BIGINT AS col, sum(l_quantity) AS v
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey, extents GROUP BY 1"""
)
def m_kron_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity by size of part and nation of supplier: (size x part) (x) (nation x supplier) times all line items."""
    parts, suppliers, nations = extents(spark, folder, "np", "ns", "nn")
    sizes = tables.extent(spark, folder, "part", "p_size")
    ones = {"v": F.lit(1.0)}
    by_size = mx.from_table(tables.read(spark, folder, "part", "p_size", "p_partkey"), "p_size", "p_partkey", (sizes, parts), "float", **ones)
    homes = mx.from_table(tables.read(spark, folder, "supplier", "s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", (nations, suppliers), "float", **ones)
    items = mx.as_vector(tables.part_supplier(spark, folder, (parts, suppliers)))
    return mx.kron_apply(by_size, homes, items).df


# --- several marginals at once ----------------------------------------------------------------------


@query(
    f"""SELECT event_type, hour, grouping, {sql_round("w / (SELECT count(*) FROM events)")} AS p
FROM (SELECT event_type, hour(ts)::BIGINT AS hour, GROUPING_ID(event_type, hour(ts)::BIGINT)::BIGINT AS grouping, count(*) AS w
      FROM events GROUP BY GROUPING SETS ((event_type, hour(ts)::BIGINT), (event_type), (hour(ts)::BIGINT), ()))"""
)
def d_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of events by type and hour, by either alone, and of all: one pass."""
    events = tables.read(spark, folder, "events", "event_type", "ts").select("event_type", F.hour("ts").cast("long").alias("hour"))
    over = ["event_type", "hour"]
    return rounded(measure.marginals(events, over, F.lit(1), [over, ["event_type"], ["hour"], []]), "p")
