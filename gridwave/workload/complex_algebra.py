"""Matrix algebra on complex cells, and the keyed layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.operators import matrix as mx
from gridwave.operators.matrix import MatrixTable
from gridwave.sources import tables
from gridwave.workload.algebra import SQL_N, SQL_T, SQL_Z, extents, incidence, matrix_t, matrix_z
from gridwave.workload.registry import SQL_EXTENTS, query, rounded, sql_round


def matrix_w(spark: SparkSession, folder: str) -> MatrixTable:
    """Suppliers x nations: 1 + i * whole balance where a supplier is at home."""
    suppliers, nations = extents(spark, folder, "ns", "nn")
    homes = tables.read(spark, folder, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    values = {"re": F.lit(1.0), "im": F.floor("s_acctbal").cast("double")}
    return mx.from_table(homes, "s_suppkey", "s_nationkey", (suppliers, nations), "complex", **values)


@query(
    f"""WITH {SQL_Z}, {SQL_T}
SELECT Z.r AS "row", Z.c AS col, Z.re, Z.im - T.v AS im FROM Z JOIN T ON Z.r = T.r AND Z.c = T.c WHERE Z.re <> 0 OR Z.im <> T.v"""
)
def m_add_complex(spark: SparkSession, folder: str) -> DataFrame:
    return mx.add(matrix_z(spark, folder), mx.scale(matrix_t(spark, folder), -1j)).df


@query(
    f"""WITH {SQL_Z}
SELECT r AS "row", c AS col, {sql_round("0.2 * re + 0.4 * im")} AS re, {sql_round("0.2 * im - 0.4 * re")} AS im FROM Z"""
)
def m_divide_complex(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.divide(matrix_z(spark, folder), 1 + 2j).df, "re", "im")


@query(
    """SELECT coalesce(sum(l_quantity), 0)::DOUBLE AS re, coalesce(sum(l_linenumber), 0)::DOUBLE AS im
FROM lineitem WHERE l_partkey = l_suppkey"""
)
def m_trace_complex(spark: SparkSession, folder: str) -> DataFrame:
    z = matrix_z(spark, folder)
    n = max(z.shape)
    return mx.trace(MatrixTable(z.df, (n, n), z.dtype))


@query(f'WITH {SQL_Z} SELECT {sql_round("sqrt(sum(re * re + im * im))")} AS norm FROM Z')
def m_norm_complex(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.norm(matrix_z(spark, folder)), "norm")


@query(
    """SELECT coalesce(sum(l_quantity * p_size - l_linenumber), 0)::DOUBLE AS re,
  coalesce(sum(l_quantity + l_linenumber * p_size), 0)::DOUBLE AS im FROM lineitem JOIN part ON l_partkey = p_partkey"""
)
def m_dot_complex(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.extent(spark, folder, "part", "p_partkey")
    lines = tables.read(spark, folder, "lineitem", "l_partkey", "l_quantity", "l_linenumber").withColumn("zero", F.lit(0))
    row = mx.from_table(lines, "zero", "l_partkey", (1, parts), "complex", re=F.col("l_quantity"), im=F.col("l_linenumber"))
    sizes = tables.read(spark, folder, "part", "p_partkey", "p_size").withColumn("zero", F.lit(0))
    column = mx.from_table(sizes, "p_partkey", "zero", (parts, 1), "complex", re=F.col("p_size"), im=F.lit(1.0))
    return mx.dot(row, column)


@query(
    f"""WITH {SQL_EXTENTS}, {SQL_N}
SELECT s_suppkey * nn + N.r AS "row", s_nationkey::BIGINT * nr + N.c AS col, 1.0::DOUBLE AS re, floor(s_acctbal)::DOUBLE AS im
FROM supplier, N, extents"""
)
def m_kron_complex(spark: SparkSession, folder: str) -> DataFrame:
    nations, regions = extents(spark, folder, "nn", "nr")
    lands = incidence(spark, folder, "nation", "n_nationkey", "n_regionkey", (nations, regions))
    return mx.kron(matrix_w(spark, folder), lands).df


@query(
    f"""WITH {SQL_EXTENTS},
W AS (SELECT s_suppkey AS r, s_nationkey AS c, floor(s_acctbal)::DOUBLE AS im FROM supplier),
G AS (SELECT r, c FROM (SELECT unnest(range((SELECT ns FROM extents))) AS r) a, (SELECT unnest(range((SELECT nn FROM extents))) AS c) b)
SELECT G.r AS "row", G.c AS col, CASE WHEN W.r IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS re, coalesce(W.im, 0.0)::DOUBLE AS im
FROM G LEFT JOIN W ON W.r = G.r AND W.c = G.c"""
)
def m_dense_complex(spark: SparkSession, folder: str) -> DataFrame:
    return mx.dense(matrix_w(spark, folder)).df


@query(
    f"""WITH {SQL_T} SELECT 'multiplier' AS layout, c AS key, r AS other, v FROM T
UNION ALL SELECT 'multiplicand', r, c, v FROM T"""
)
def m_layout_keyed(spark: SparkSession, folder: str) -> DataFrame:
    """Cells by the key on which a product joins them."""
    t = matrix_t(spark, folder)
    sides = [("multiplier", "row"), ("multiplicand", "col")]
    parts = [
        mx.layout(t, name).select(F.lit(name).alias("layout"), "key", F.col(f"value.{other}").alias("other"), "value.v")
        for name, other in sides
    ]
    return parts[0].unionByName(parts[1])
