"""Distributions of facts: where the goods of each month go, by quantity.

A cell is a month, the customer's nation (x0) and the supplier's nation (x1); its p is the
share of the month's quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.operators import measure
from gridwave.sources import tables
from gridwave.sources.grids import Grid
from gridwave.workload.registry import query, rounded, sql_round

AXES = ["x0", "x1"]


def trade(spark: SparkSession, folder: str) -> DataFrame:
    """(month, x0, x1, l_quantity) for each line item."""
    lines = tables.read(spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    orders = tables.read(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers = tables.read(spark, folder, "customer", "c_custkey", "c_nationkey")
    suppliers = tables.read(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    return joined.select(
        month.alias("month"), F.col("c_nationkey").cast("long").alias("x0"), F.col("s_nationkey").cast("long").alias("x1"),
        "l_quantity",
    )


def monthly(spark: SparkSession, folder: str, over: list[str] = AXES) -> DataFrame:
    """(month, over, p)."""
    return measure.weighted(trade(spark, folder), ["month"], over, F.col("l_quantity"))


def sql_monthly(over: str = "x0, x1") -> str:
    return f"""WITH f AS (
  SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS month, c_nationkey::BIGINT AS x0, s_nationkey::BIGINT AS x1,
         l_quantity AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT month, {over}, sum(v) AS v FROM f GROUP BY ALL),
d AS (SELECT month, {over}, v / sum(v) OVER (PARTITION BY month) AS p FROM c)"""


@query(f"{sql_monthly()} SELECT month, x0, x1, {sql_round('p')} AS p FROM d")
def d_joint(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(monthly(spark, folder), "p")


@query(f"{sql_monthly()} SELECT month, x1, {sql_round('sum(p)')} AS p FROM d GROUP BY ALL")
def d_marginal(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(measure.marginal_of(monthly(spark, folder), ["month", "x1"]), "p")


@query(f"{sql_monthly()} SELECT month, x0 AS x, {sql_round('p')} AS p FROM d WHERE x0 = x1")
def d_collision(spark: SparkSession, folder: str) -> DataFrame:
    """Trade within a nation."""
    same = measure.co_located(monthly(spark, folder), [["x0"], ["x1"]])
    return rounded(same.select("month", F.col("x0").alias("x"), "p"), "p")


@query(f"{sql_monthly()} SELECT month, {sql_round('sum(p)')} AS total FROM d GROUP BY 1")
def d_sum(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(measure.total(monthly(spark, folder), ["month"]), "total")


@query(f"{sql_monthly()} SELECT month, {sql_round('sqrt(sum(p * p))')} AS norm FROM d GROUP BY 1")
def d_norm(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(measure.norm(monthly(spark, folder), ["month"]), "norm")


@query(
    f"""{sql_monthly()} SELECT month, {sql_round('max(p)')} AS max_p,
  arg_min(x0, (-p, x0, x1)) AS x0, arg_min(x1, (-p, x0, x1)) AS x1 FROM d GROUP BY 1"""
)
def d_max(spark: SparkSession, folder: str) -> DataFrame:
    """The largest share, and the pair of nations that has it (the first of equal ones)."""
    return rounded(measure.largest_at(monthly(spark, folder), ["month"], AXES), "max_p")


@query(f"{sql_monthly()} SELECT month, {sql_round('min(p)')} AS min_p FROM d GROUP BY 1")
def d_min(spark: SparkSession, folder: str) -> DataFrame:
    """The least share among the pairs of nations that trade."""
    return rounded(measure.smallest(monthly(spark, folder), ["month"]), "min_p")


@query(
    f"""{sql_monthly('x0')}
SELECT x0, {sql_round('sum(p) / (SELECT count(DISTINCT month) FROM d)')} AS p FROM d GROUP BY 1"""
)
def d_ensemble_average(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over the months that there are, a month without trade of a nation counting as zero."""
    return rounded(measure.average_over(monthly(spark, folder, ["x0"]), ["x0"], ["month"]), "p")


@query(
    f"""{sql_monthly('x0')},
every AS (SELECT DISTINCT month, n FROM d, (SELECT unnest(range((SELECT max(n_nationkey) + 1 FROM nation))) AS n))
SELECT every.month, every.n AS x0, {sql_round('coalesce(p, 0.0)')} AS p
FROM every LEFT JOIN d ON d.month = every.month AND d.x0 = every.n"""
)
def d_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Every nation in every month."""
    ring = Grid("cycle", (tables.extent(spark, folder, "nation", "n_nationkey"),))
    shares = monthly(spark, folder, ["x0"]).withColumnRenamed("month", "walk_id")
    whole = measure.dense(shares, shares, ring)
    return rounded(whole.withColumnRenamed("walk_id", "month"), "p")


@query(
    f"""SELECT event_type, extract('hour' FROM ts)::INTEGER AS hour, count(*) AS n,
  {sql_round("count(*) / (SELECT count(*) FROM events)::DOUBLE")} AS p FROM events GROUP BY 1, 2"""
)
def d_events_joint(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(measure.empirical(event_hours(spark, folder), ["event_type", "hour"]), "p")


@query(
    f"""SELECT event_type, {sql_round("count(*) / (SELECT count(*) FROM events)::DOUBLE")} AS p FROM events GROUP BY 1"""
)
def d_events_marginal(spark: SparkSession, folder: str) -> DataFrame:
    both = measure.empirical(event_hours(spark, folder), ["event_type", "hour"])
    return rounded(measure.marginal_of(both, ["event_type"]), "p")


def event_hours(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "events", "event_type", "ts").select("event_type", F.hour("ts").alias("hour"))
