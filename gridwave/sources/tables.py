"""The fact tables and the matrices, grids and start tables read from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridwave.operators.matrix import MatrixTable, from_cells, from_table


# Schemas of the fact tables read so far, by application; later reads skip the job that infers them.
_schemas: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    reader = spark.read.schema(_schemas[key]) if key in _schemas else spark.read
    df = reader.parquet(path)
    _schemas.setdefault(key, df.schema)
    return df.select(*columns) if columns else df


def extents(spark: SparkSession, folder: str, **keys: tuple[str, str]) -> dict[str, int]:
    """Number of index values per 0-based key, its maximum plus one: one job, one row per key."""
    maxima = [
        read(spark, folder, table, key).select(F.lit(name).alias("name"), F.col(key).cast("long").alias("key"))
        for name, (table, key) in keys.items()
    ]
    rows = reduce(DataFrame.unionByName, maxima).groupBy("name").agg(F.max("key").alias("m")).collect()
    return {r["name"]: r["m"] + 1 for r in rows}


def extent(spark: SparkSession, folder: str, table: str, key: str) -> int:
    return extents(spark, folder, n=(table, key))["n"]


def customer_part(spark: SparkSession, folder: str, parts: int, customers: int) -> MatrixTable:
    """Quantity ordered, customer x part."""
    lines = read(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, folder, "orders", "o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return from_table(joined, "o_custkey", "l_partkey", (customers, parts), "float", v=F.col("l_quantity"))


def part_supplier(spark: SparkSession, folder: str, shape: tuple[int, int], **values: Column) -> MatrixTable:
    """Line items per part x supplier; the quantity unless other values are given."""
    lines = read(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    dtype = "complex" if "re" in values else "float"
    return from_table(lines, "l_partkey", "l_suppkey", shape, dtype, **(values or {"v": F.col("l_quantity")}))


def part_line(spark: SparkSession, folder: str, parts: int) -> MatrixTable:
    """Number of line items, part x line number: a tall matrix of 8 columns."""
    lines = read(spark, folder, "lineitem", "l_partkey", "l_linenumber")
    return from_table(lines, "l_partkey", "l_linenumber", (parts, 8), "int", v=F.lit(1))


def supplier_vector(spark: SparkSession, folder: str, suppliers: int) -> MatrixTable:
    """Supplier balance in whole units, as a column vector."""
    cells = read(spark, folder, "supplier", "s_suppkey", "s_acctbal").select(
        F.col("s_suppkey").alias("row"),
        F.lit(0).cast("long").alias("col"),
        F.floor("s_acctbal").cast("double").alias("v"),
    )
    return from_cells(cells, (suppliers, 1), "float")
