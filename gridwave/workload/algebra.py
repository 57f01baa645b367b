"""Matrix algebra over order facts.

Q is customer x part (quantity), T part x supplier (quantity), L part x line number (count),
Z part x supplier with complex cells. Their values are whole numbers, so sums are exact in
any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.operators import matrix as mx
from gridwave.operators.matrix import MatrixTable
from gridwave.sources import tables
from gridwave.workload.registry import SQL_EXTENTS, query, rounded, sql_round

SQL_Q = """Q AS (SELECT o_custkey AS r, l_partkey AS c, sum(l_quantity) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
SQL_T = "T AS (SELECT l_partkey AS r, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
SQL_L = "L AS (SELECT l_partkey AS r, l_linenumber::BIGINT AS c, count(*) AS v FROM lineitem GROUP BY 1, 2)"
SQL_Z = """Z AS (SELECT l_partkey AS r, l_suppkey AS c, sum(l_quantity) AS re,
  sum(l_linenumber)::DOUBLE AS im FROM lineitem GROUP BY 1, 2)"""
SQL_N = "N AS (SELECT n_nationkey::BIGINT AS r, n_regionkey::BIGINT AS c FROM nation)"


KEYS = {
    "nc": ("customer", "c_custkey"),
    "np": ("part", "p_partkey"),
    "ns": ("supplier", "s_suppkey"),
    "nn": ("nation", "n_nationkey"),
    "nr": ("region", "r_regionkey"),
}


def extents(spark: SparkSession, folder: str, *names: str) -> list[int]:
    found = tables.extents(spark, folder, **{n: KEYS[n] for n in names})
    return [found[n] for n in names]


def matrix_q(spark: SparkSession, folder: str) -> MatrixTable:
    customers, parts = extents(spark, folder, "nc", "np")
    return tables.customer_part(spark, folder, parts, customers)


def part_supplier_shape(spark: SparkSession, folder: str) -> tuple[int, int]:
    parts, suppliers = extents(spark, folder, "np", "ns")
    return parts, suppliers


def matrix_t(spark: SparkSession, folder: str) -> MatrixTable:
    return tables.part_supplier(spark, folder, part_supplier_shape(spark, folder))


def square_t(spark: SparkSession, folder: str) -> MatrixTable:
    """T with as many columns as rows, the missing ones empty."""
    t = matrix_t(spark, folder)
    n = max(t.shape)
    return MatrixTable(t.df, (n, n), t.dtype)


def matrix_z(spark: SparkSession, folder: str) -> MatrixTable:
    shape = part_supplier_shape(spark, folder)
    return tables.part_supplier(spark, folder, shape, re=F.col("l_quantity"), im=F.col("l_linenumber"))


def matrix_l(spark: SparkSession, folder: str) -> MatrixTable:
    return tables.part_line(spark, folder, tables.extent(spark, folder, "part", "p_partkey"))


def returned(spark: SparkSession, folder: str) -> MatrixTable:
    """Quantity sent back, part x supplier."""
    lines = tables.read(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    shape = part_supplier_shape(spark, folder)
    back = lines.where(F.col("l_returnflag") == "R")
    return tables.from_table(back, "l_partkey", "l_suppkey", shape, "float", v=F.col("l_quantity"))


def incidence(spark: SparkSession, folder: str, name: str, row: str, col: str, shape: tuple[int, int]) -> MatrixTable:
    cells = tables.read(spark, folder, name, row, col).select(
        F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.lit(1).cast("long").alias("v")
    )
    return mx.from_cells(cells, shape, "int")


# --- sources -----------------------------------------------------------------------------------


@query(f'WITH {SQL_Q} SELECT r AS "row", c AS col, v FROM Q')
def m_from_table(spark: SparkSession, folder: str) -> DataFrame:
    return matrix_q(spark, folder).df


@query(
    f"""WITH {SQL_EXTENTS}, {SQL_T},
D AS (SELECT unnest(range((SELECT greatest(np, ns) FROM extents))) AS i)
SELECT r AS "row", c AS col, sum(v) AS v
FROM (SELECT r, c, v FROM T UNION ALL SELECT i, i, 2.5::DOUBLE FROM D) GROUP BY 1, 2"""
)
def m_diagonal(spark: SparkSession, folder: str) -> DataFrame:
    t = square_t(spark, folder)
    return mx.add(t, mx.diagonal(spark, t.shape[0], 2.5)).df


@query(
    f"""WITH {SQL_EXTENTS}, {SQL_T},
D AS (SELECT unnest(range((SELECT greatest(np, ns) FROM extents))) AS i)
SELECT r AS "row", c AS col, sum(v) AS v
FROM (SELECT r, c, -v AS v FROM T UNION ALL SELECT i, i, 1::DOUBLE FROM D) GROUP BY 1, 2 HAVING sum(v) <> 0"""
)
def m_eye(spark: SparkSession, folder: str) -> DataFrame:
    t = square_t(spark, folder)
    return mx.subtract(mx.eye(spark, t.shape[0]), t).df


@query(f'WITH {SQL_T} SELECT r AS "row", c AS col, v FROM T WHERE v <> 0')
def m_zeros(spark: SparkSession, folder: str) -> DataFrame:
    t = matrix_t(spark, folder)
    return mx.add(mx.zeros(spark, t.shape), t).df


@query(
    f"""WITH {SQL_EXTENTS}, {SQL_L},
G AS (SELECT r, c FROM (SELECT unnest(range((SELECT np FROM extents))) AS r) a,
                       (SELECT unnest(range(8)) AS c) b)
SELECT G.r AS "row", G.c AS col, coalesce(L.v, 0) + 1 AS v FROM G LEFT JOIN L ON L.r = G.r AND L.c = G.c"""
)
def m_ones(spark: SparkSession, folder: str) -> DataFrame:
    counts = matrix_l(spark, folder)
    return mx.add(mx.ones(spark, counts.shape, "int"), counts).df


# --- projections and filters -----------------------------------------------------------------------


@query(
    f"""WITH {SQL_T} SELECT 'default' AS layout, r AS "row", c AS col, v FROM T
UNION ALL SELECT 'indexed', r, c, v FROM T"""
)
def m_layout(spark: SparkSession, folder: str) -> DataFrame:
    t = matrix_t(spark, folder)
    plain = mx.layout(t, "default").select(F.lit("default").alias("layout"), "row", "col", "v")
    indexed = mx.layout(t, "indexed").select(
        F.lit("indexed").alias("layout"), "key.row", "key.col", "value.v"
    )
    return plain.unionByName(indexed)


@query(f'WITH {SQL_T} SELECT c AS "row", r AS col, v FROM T')
def m_transpose(spark: SparkSession, folder: str) -> DataFrame:
    return mx.transpose(matrix_t(spark, folder)).df


@query(f'WITH {SQL_T} SELECT r AS "row", c AS col, 1.5::DOUBLE * v AS v FROM T')
def m_scale(spark: SparkSession, folder: str) -> DataFrame:
    return mx.scale(matrix_t(spark, folder), 1.5).df


@query(f'WITH {SQL_Z} SELECT r AS "row", c AS col, 2 * re + im AS re, 2 * im - re AS im FROM Z')
def m_scale_complex(spark: SparkSession, folder: str) -> DataFrame:
    return mx.scale(matrix_z(spark, folder), 2 - 1j).df


@query(f'WITH {SQL_L} SELECT r AS "row", c AS col, {sql_round("v / 3.0::DOUBLE")} AS v FROM L')
def m_divide(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.divide(matrix_l(spark, folder), 3).df, "v")


@query(
    f"""WITH {SQL_Z},
C AS (SELECT l_partkey AS r, l_suppkey AS c, count(*) AS v FROM lineitem GROUP BY 1, 2),
B AS (SELECT l_partkey AS r, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem
      WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT Z.r AS "row", Z.c AS col, C.v + coalesce(B.v, 0) + Z.re AS re, Z.im AS im
FROM Z JOIN C ON C.r = Z.r AND C.c = Z.c LEFT JOIN B ON B.r = Z.r AND B.c = Z.c"""
)
def m_add_mixed_types(spark: SparkSession, folder: str) -> DataFrame:
    lines = tables.read(spark, folder, "lineitem", "l_partkey", "l_suppkey")
    counts = mx.from_table(
        lines, "l_partkey", "l_suppkey", part_supplier_shape(spark, folder), "int", v=F.lit(1)
    )
    return mx.add(mx.add(counts, returned(spark, folder)), matrix_z(spark, folder)).df


@query(
    """SELECT l_partkey AS "row", l_suppkey AS col, sum(l_quantity - 25) AS v
FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity - 25) <> 0"""
)
def m_clear(spark: SparkSession, folder: str) -> DataFrame:
    shape = part_supplier_shape(spark, folder)
    return mx.clear(tables.part_supplier(spark, folder, shape, v=F.col("l_quantity") - 25)).df


@query(
    f"""WITH {SQL_EXTENTS},
S AS (SELECT 'quantities' AS name, np AS a, ns AS b, (SELECT count(*) FROM lineitem) AS n FROM extents
 UNION ALL SELECT 'square', greatest(np, ns), greatest(np, ns), (SELECT count(*) FROM lineitem) FROM extents
 UNION ALL SELECT 'balances', ns, 1, (SELECT count(*) FROM supplier) FROM extents
 UNION ALL SELECT 'balances_transposed', 1, ns, (SELECT count(*) FROM supplier) FROM extents
 UNION ALL SELECT 'cancelled', np, ns, 0 FROM extents)
SELECT name, a = b AS is_square, a = 1 AS is_row_vector, b = 1 AS is_column_vector, n = 0 AS is_empty FROM S"""
)
def m_shape_flags(spark: SparkSession, folder: str) -> DataFrame:
    t = matrix_t(spark, folder)
    b = tables.supplier_vector(spark, folder, t.shape[1])
    named = {
        "quantities": t,
        "square": square_t(spark, folder),
        "balances": b,
        "balances_transposed": mx.transpose(b),
        "cancelled": mx.subtract(t, t),
    }
    rows = [mx.shape_flags(m).select(F.lit(n).alias("name"), "*") for n, m in named.items()]
    return reduce(DataFrame.unionByName, rows)


# --- sums ----------------------------------------------------------------------------------------

_SQL_R = "R AS (SELECT l_partkey AS r, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"


def _sql_combine(sign: str) -> str:
    return f"""WITH {SQL_T}, {_SQL_R}
SELECT coalesce(T.r, R.r) AS "row", coalesce(T.c, R.c) AS col, coalesce(T.v, 0) {sign} coalesce(R.v, 0) AS v
FROM T FULL OUTER JOIN R ON T.r = R.r AND T.c = R.c WHERE coalesce(T.v, 0) {sign} coalesce(R.v, 0) <> 0"""


@query(_sql_combine("+"))
def m_add(spark: SparkSession, folder: str) -> DataFrame:
    return mx.add(matrix_t(spark, folder), returned(spark, folder)).df


@query(_sql_combine("-"))
def m_subtract(spark: SparkSession, folder: str) -> DataFrame:
    return mx.subtract(matrix_t(spark, folder), returned(spark, folder)).df


def _sql_combine_scalar(expression: str) -> str:
    return f"""WITH {SQL_EXTENTS}, {SQL_L},
G AS (SELECT r, c FROM (SELECT unnest(range((SELECT np FROM extents))) AS r) a,
                       (SELECT unnest(range(8)) AS c) b)
SELECT G.r AS "row", G.c AS col, coalesce(L.v, 0) {expression} AS v
FROM G LEFT JOIN L ON L.r = G.r AND L.c = G.c WHERE coalesce(L.v, 0) {expression} <> 0"""


@query(_sql_combine_scalar("+ 5"))
def m_add_scalar(spark: SparkSession, folder: str) -> DataFrame:
    return mx.add(matrix_l(spark, folder), 5).df


@query(_sql_combine_scalar("- 1"))
def m_subtract_scalar(spark: SparkSession, folder: str) -> DataFrame:
    return mx.subtract(matrix_l(spark, folder), 1).df


@query(_sql_combine_scalar("+ 0").replace("WHERE coalesce(L.v, 0) + 0 <> 0", ""))
def m_dense(spark: SparkSession, folder: str) -> DataFrame:
    return mx.dense(matrix_l(spark, folder)).df


# --- products --------------------------------------------------------------------------------------


@query(
    f"""WITH {SQL_Q}, {SQL_T}
SELECT Q.r AS "row", T.c AS col, sum(Q.v * T.v) AS v FROM Q JOIN T ON Q.c = T.r GROUP BY 1, 2"""
)
def m_matmul(spark: SparkSession, folder: str) -> DataFrame:
    customers, parts, suppliers = extents(spark, folder, "nc", "np", "ns")
    q = tables.customer_part(spark, folder, parts, customers)
    return mx.matmul(q, tables.part_supplier(spark, folder, (parts, suppliers))).df


@query(
    f"""WITH {SQL_Z},
W AS (SELECT s_suppkey AS r, s_nationkey::BIGINT AS c, 1.0::DOUBLE AS re, floor(s_acctbal) AS im FROM supplier)
SELECT Z.r AS "row", W.c AS col, sum(Z.re * W.re - Z.im * W.im) AS re, sum(Z.re * W.im + Z.im * W.re) AS im
FROM Z JOIN W ON Z.c = W.r GROUP BY 1, 2"""
)
def m_matmul_complex(spark: SparkSession, folder: str) -> DataFrame:
    z = matrix_z(spark, folder)
    cells = tables.read(spark, folder, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(
        F.col("s_suppkey").alias("row"),
        F.col("s_nationkey").cast("long").alias("col"),
        F.lit(1.0).alias("re"),
        F.floor("s_acctbal").cast("double").alias("im"),
    )
    nations = tables.extent(spark, folder, "nation", "n_nationkey")
    return mx.matmul(z, mx.from_cells(cells, (z.shape[1], nations), "complex")).df


@query(
    f"""WITH {SQL_T}
SELECT T.r AS "row", 0::BIGINT AS col, sum(T.v * floor(s_acctbal)) AS v
FROM T JOIN supplier ON T.c = s_suppkey GROUP BY 1"""
)
def m_matvec(spark: SparkSession, folder: str) -> DataFrame:
    t = matrix_t(spark, folder)
    return mx.matvec(t, tables.supplier_vector(spark, folder, t.shape[1])).df


@query(
    f"""WITH {SQL_Q},
V0 AS (SELECT p_partkey AS r, p_size::DOUBLE AS v FROM part),
V1 AS (SELECT Q.r, sum(Q.v * V0.v) AS v FROM Q JOIN V0 ON Q.c = V0.r GROUP BY 1),
V2 AS (SELECT Q.c AS r, sum(Q.v * V1.v) AS v FROM Q JOIN V1 ON Q.r = V1.r GROUP BY 1),
V3 AS (SELECT Q.r, sum(Q.v * V2.v) AS v FROM Q JOIN V2 ON Q.c = V2.r GROUP BY 1)
SELECT Q.c AS "row", 0::BIGINT AS col, sum(Q.v * V3.v) AS v FROM Q JOIN V3 ON Q.r = V3.r GROUP BY 1"""
)
def m_power_iterate(spark: SparkSession, folder: str) -> DataFrame:
    """Two rounds of part -> customer -> part scores, without a part x part matrix."""
    q = matrix_q(spark, folder)
    sizes = tables.read(spark, folder, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").alias("row"), F.lit(0).cast("long").alias("col"), F.col("p_size").cast("double").alias("v")
    )
    start = mx.from_cells(sizes, (q.shape[1], 1), "float")
    return mx.propagate([q, mx.transpose(q)], start, steps=2).df


@query(
    f"""WITH {SQL_EXTENTS}, {SQL_N}
SELECT c_custkey * nn + N.r AS "row", c_nationkey::BIGINT * nr + N.c AS col, 1::BIGINT AS v
FROM customer, N, extents"""
)
def m_kron(spark: SparkSession, folder: str) -> DataFrame:
    customers, nations, regions = extents(spark, folder, "nc", "nn", "nr")
    homes = incidence(spark, folder, "customer", "c_custkey", "c_nationkey", (customers, nations))
    regions = incidence(spark, folder, "nation", "n_nationkey", "n_regionkey", (nations, regions))
    return mx.kron(homes, regions).df


@query(
    f"""WITH {SQL_EXTENTS}, {SQL_T}, I AS (SELECT unnest(range((SELECT nr FROM extents))) AS t)
SELECT t * np + r AS "row", t * ns + c AS col, v FROM T, I, extents"""
)
def m_kron_identity_left(spark: SparkSession, folder: str) -> DataFrame:
    return mx.kron_identity(matrix_t(spark, folder), tables.extent(spark, folder, "region", "r_regionkey"), "left").df


@query(
    f"""WITH {SQL_EXTENTS}, {SQL_T}, I AS (SELECT unnest(range((SELECT nr FROM extents))) AS t)
SELECT r * nr + t AS "row", c * nr + t AS col, v FROM T, I, extents"""
)
def m_kron_identity_right(spark: SparkSession, folder: str) -> DataFrame:
    return mx.kron_identity(matrix_t(spark, folder), tables.extent(spark, folder, "region", "r_regionkey"), "right").df


# --- aggregates --------------------------------------------------------------------------------------


@query("SELECT coalesce(sum(l_quantity), 0) AS v FROM lineitem WHERE l_partkey = l_suppkey")
def m_trace(spark: SparkSession, folder: str) -> DataFrame:
    return mx.trace(square_t(spark, folder))


@query(f'WITH {SQL_Q} SELECT {sql_round("sqrt(sum(v * v))")} AS norm FROM Q')
def m_norm(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.norm(matrix_q(spark, folder)), "norm")


@query(
    f"""WITH P AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
A AS (SELECT sqrt(q / (SELECT sum(q) FROM P)) AS a FROM P)
SELECT {sql_round("sqrt(sum(a * a))")} AS norm, round(sqrt(sum(a * a)), 10) = 1.0 AS is_unit FROM A"""
)
def m_unit_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Amplitudes whose squares are the parts' shares of all quantity."""
    per_part = tables.read(spark, folder, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("q")
    )
    everything = per_part.agg(F.sum("q")).scalar()
    cells = per_part.select(
        F.col("l_partkey").alias("row"), F.lit(0).cast("long").alias("col"), F.sqrt(F.col("q") / everything).alias("v")
    )
    parts = tables.extent(spark, folder, "part", "p_partkey")
    return rounded(mx.has_unit_norm(mx.from_cells(cells, (parts, 1), "float")), "norm")


@query("SELECT coalesce(sum(l_quantity * p_size), 0) AS v FROM lineitem JOIN part ON l_partkey = p_partkey")
def m_dot(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.extent(spark, folder, "part", "p_partkey")
    lines = tables.read(spark, folder, "lineitem", "l_partkey", "l_quantity").withColumn("zero", F.lit(0))
    quantities = mx.from_table(lines, "zero", "l_partkey", (1, parts), "float", v=F.col("l_quantity"))
    sizes = tables.read(spark, folder, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").alias("row"), F.lit(0).cast("long").alias("col"), F.col("p_size").cast("long").alias("v")
    )
    return mx.dot(quantities, mx.from_cells(sizes, (parts, 1), "int"))


@query(
    f"""WITH {SQL_EXTENTS}, {SQL_Q}
SELECT count(*) AS nelem, any_value(nc * np) AS size,
  {sql_round("1.0::DOUBLE - count(*) / any_value(nc * np)::DOUBLE")} AS sparsity,
  min(Q.r) >= 0 AND max(Q.r) < any_value(nc) AND min(Q.c) >= 0 AND max(Q.c) < any_value(np) AS in_shape
FROM Q, extents"""
)
def m_describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mx.describe(matrix_q(spark, folder)), "sparsity")
