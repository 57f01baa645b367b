"""Grid queries. Grids are sized by the tables; broken edges and points come from facts.

One-dimensional grids have a site per customer, two-dimensional ones a column per supplier and
a row per nation. A customer with a negative balance breaks the edge of its number. A supplier
with a negative balance breaks the edge at (its number, its nation); on natural grids one with
a balance above 5000 breaks the vertical edge there as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.functions.indexing import ORDERS
from gridwave.sources import grids, tables
from gridwave.sources.grids import Grid
from gridwave.workload.algebra import extents
from gridwave.workload.registry import SQL_EXTENTS, query, sql_mod


def customer_grid(spark: SparkSession, folder: str, kind: str) -> Grid:
    n = tables.extent(spark, folder, "customer", "c_custkey")
    return grids.line(n) if kind == "line" else Grid(kind, (n,))


def supplier_grid(spark: SparkSession, folder: str, kind: str) -> Grid:
    w, h = extents(spark, folder, "ns", "nn")
    return Grid(kind, (2 * w + 1, 2 * h + 1) if kind.endswith("lattice") else (w, h))


def customer_edges(spark: SparkSession, folder: str) -> DataFrame:
    customers = tables.read(spark, folder, "customer", "c_custkey", "c_acctbal")
    return customers.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("edge"))


def supplier_edges(spark: SparkSession, folder: str, grid: Grid) -> DataFrame:
    suppliers = tables.read(spark, folder, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    x, y = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    flat = suppliers.where(F.col("s_acctbal") < 0).select((x + F.lit(grid.shape[0]) * y).alias("edge"))
    if grid.kind not in grids.NATURAL:
        return flat
    upright = suppliers.where(F.col("s_acctbal") > 5000).select(
        (F.lit(grid.sites) + x * F.lit(grid.shape[1]) + y).alias("edge")
    )
    return flat.unionByName(upright)


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    """(o_orderkey, coin, x): orders stand at their customer's site; odd ones have coin 1."""
    orders = tables.read(spark, folder, "orders", "o_orderkey", "o_custkey")
    return orders.select("o_orderkey", F.pmod("o_orderkey", F.lit(2)).cast("long").alias("coin"), F.col("o_custkey").alias("x"))


def item_points(spark: SparkSession, folder: str) -> DataFrame:
    """(l_orderkey, coin, x, y): line items stand at (supplier, its nation); the coin is their line number modulo 4."""
    lines = tables.read(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")
    suppliers = tables.read(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", F.pmod("l_linenumber", F.lit(4)).cast("long").alias("coin"), F.col("l_suppkey").alias("x"),
        F.col("s_nationkey").cast("long").alias("y"),
    )


def items_at(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """(keys, n_items): line items per coordinate of their points."""
    return item_points(spark, folder).groupBy(*keys).agg(F.count("*").alias("n_items"))


# --- SQL pieces -----------------------------------------------------------------------------------

SQL_LINE = f"WITH {SQL_EXTENTS}, g AS (SELECT nc AS w, nc AS e FROM extents)"


def sql_plane(kind: str) -> str:
    w, h = ("(2 * ns + 1)", "(2 * nn + 1)") if kind.endswith("lattice") else ("ns", "nn")
    edges = f"2 * {w} * {h}" if kind.startswith("natural") else f"{w} * {h}"
    return f"WITH {SQL_EXTENTS}, g AS (SELECT {w} AS w, {h} AS h, {w} * {h} AS p, {edges} AS e FROM extents)"


SQL_CUSTOMER_EDGES = "broken AS (SELECT c_custkey AS edge FROM customer WHERE c_acctbal < 0)"
SQL_DIAGONAL_EDGES = """broken AS (
  SELECT s_suppkey + w * s_nationkey AS edge FROM supplier, g WHERE s_acctbal < 0)"""
SQL_NATURAL_EDGES = """broken AS (
  SELECT s_suppkey + w * s_nationkey AS edge FROM supplier, g WHERE s_acctbal < 0
  UNION SELECT p + s_suppkey * h + s_nationkey FROM supplier, g WHERE s_acctbal > 5000)"""
SQL_NONE = "broken AS (SELECT -1 AS edge)"


def sql_line_by_site(n: str) -> str:
    """Moves of a plain one-dimensional grid, from the source site."""
    return f"""WITH {SQL_EXTENTS}, g AS (SELECT {n} AS w FROM extents),
s AS (SELECT unnest(range((SELECT w FROM g))) AS x)
SELECT c AS src_coin, x AS src_x, c AS dst_coin, {sql_mod("x + 1 - 2 * c", "w")} AS dst_x
FROM s, g, (VALUES (0::BIGINT), (1::BIGINT)) AS coins(c)"""


def sql_line_by_edge(broken: str, border: str = "false") -> str:
    """Moves of a one-dimensional grid with broken edges, from the edge crossed."""
    return f"""{SQL_LINE}, {broken},
m AS (SELECT k.edge, i, 1 - 2 * i AS l, {sql_mod("k.edge - i - (1 - 2 * i)", "w")} AS x, w,
        k.edge IN (SELECT edge FROM broken) AS hit
  FROM (SELECT unnest(range((SELECT e FROM g))) AS edge) k, g, (VALUES (0::BIGINT), (1::BIGINT)) AS ends(i))
SELECT 1 - i AS src_coin, x AS src_x,
  CASE WHEN hit OR {border} THEN i ELSE 1 - i END AS dst_coin,
  CASE WHEN hit OR {border} THEN x ELSE {sql_mod("x + l", "w")} END AS dst_x
FROM m"""


SQL_BORDER_1D = "x + l < 0 OR x + l >= w"
_BITS = "(VALUES (0::BIGINT), (1::BIGINT))"


def sql_plane_by_site(kind: str) -> str:
    if kind.startswith("natural"):
        dx, dy = "CASE WHEN i = j THEN 0 ELSE 1 - 2 * i END", "CASE WHEN i = j THEN 1 - 2 * i ELSE 0 END"
    else:
        dx, dy = "1 - 2 * i", "1 - 2 * j"
    return f"""{sql_plane(kind)},
s AS (SELECT k % w AS x, k // w AS y, i, j, w, h
  FROM (SELECT unnest(range((SELECT p FROM g))) AS k), g, {_BITS} AS a(i), {_BITS} AS b(j))
SELECT 2 * i + j AS src_coin, x AS src_x, y AS src_y, 2 * i + j AS dst_coin,
  {sql_mod(f"x + ({dx})", "w")} AS dst_x, {sql_mod(f"y + ({dy})", "h")} AS dst_y FROM s"""


def sql_plane_by_edge(kind: str, broken: str) -> str:
    edges = "(SELECT unnest(range((SELECT e FROM g))) AS edge) k"
    border = "x + dx < 0 OR x + dx >= w OR y + dy < 0 OR y + dy >= h" if kind.endswith("box") else "false"
    if kind.startswith("natural"):
        m = f"""m AS (
  SELECT edge, i, 1 - i AS j, 1 - 2 * i AS dx, 0 AS dy,
    {sql_mod("edge % w - i - (1 - 2 * i)", "w")} AS x, edge // w AS y, w, h
  FROM {edges}, g, {_BITS} AS a(i) WHERE edge < p
  UNION ALL
  SELECT edge, i, i AS j, 0 AS dx, 1 - 2 * i AS dy,
    (edge - p) // h AS x, {sql_mod("(edge - p) % h - i - (1 - 2 * i)", "h")} AS y, w, h
  FROM {edges}, g, {_BITS} AS a(i) WHERE edge >= p)"""
    else:
        m = f"""m AS (
  SELECT edge, i, j, 1 - 2 * i AS dx, 1 - 2 * j AS dy,
    {sql_mod("edge % w - i - (1 - 2 * i)", "w")} AS x, {sql_mod("edge // w - j - (1 - 2 * j)", "h")} AS y, w, h
  FROM {edges}, g, {_BITS} AS a(i), {_BITS} AS b(j))"""
    return f"""{sql_plane(kind)}, {broken}, {m},
f AS (SELECT *, (edge IN (SELECT edge FROM broken)) OR {border} AS stay FROM m)
SELECT 2 * (1 - i) + (1 - j) AS src_coin, x AS src_x, y AS src_y,
  CASE WHEN stay THEN 2 * i + j ELSE 2 * (1 - i) + (1 - j) END AS dst_coin,
  CASE WHEN stay THEN x ELSE {sql_mod("x + dx", "w")} END AS dst_x,
  CASE WHEN stay THEN y ELSE {sql_mod("y + dy", "h")} END AS dst_y
FROM f"""


SQL_ORDERS = "(SELECT o_orderkey, o_orderkey % 2 AS coin, o_custkey AS x FROM orders)"
SQL_ITEMS = """(SELECT l_orderkey, (l_linenumber % 4)::BIGINT AS coin, l_suppkey AS x, s_nationkey::BIGINT AS y
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def sql_orders_moved(moves: str) -> str:
    return f"""SELECT o_orderkey, coin, x, dst_coin, dst_x FROM {SQL_ORDERS} i JOIN ({moves}) t ON coin = src_coin AND x = src_x"""


def sql_items_moved(moves: str) -> str:
    return f"""SELECT l_orderkey, coin, x, y, dst_coin, dst_x, dst_y
FROM {SQL_ITEMS} i JOIN ({moves}) t ON coin = src_coin AND x = src_x AND y = src_y"""


# --- sites and coordinates ----------------------------------------------------------------------------


@query(
    f"""SELECT s.*, coalesce(n_items, 0)::BIGINT AS n_items FROM ({sql_plane("natural_lattice")}
SELECT k AS site, (k % w) * h + k // w AS pos, k % w AS x, k // w AS y,
  k % w - (w - 1) // 2 AS ax, k // w - (h - 1) // 2 AS ay, k % w = (w - 1) // 2 AND k // w = (h - 1) // 2 AS is_center
FROM (SELECT unnest(range((SELECT p FROM g))) AS k), g) s
LEFT JOIN (SELECT x, y, count(*) AS n_items FROM {SQL_ITEMS} GROUP BY ALL) n USING (x, y)"""
)
def g_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Every site, with the number of line items that stand there."""
    found = grids.sites(spark, supplier_grid(spark, folder, "natural_lattice"))
    counted = found.join(items_at(spark, folder, "x", "y"), ["x", "y"], "left")
    return counted.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))


@query(
    f"""{sql_plane("diagonal_lattice")}
SELECT l_orderkey, l_linenumber, l_suppkey AS ax, l_linenumber::BIGINT - 4 AS ay,
  CASE WHEN l_suppkey BETWEEN -((w - 1) // 2) AND (w - 1) // 2
        AND l_linenumber - 4 BETWEEN -((h - 1) // 2) AND (h - 1) // 2
    THEN l_suppkey + (w - 1) // 2 + w * (l_linenumber - 4 + (h - 1) // 2) END AS site
FROM lineitem, g"""
)
def g_to_site(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as points (supplier, line number - 4) of a centred lattice."""
    grid = supplier_grid(spark, folder, "diagonal_lattice")
    points = tables.read(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").alias("ax"),
        (F.col("l_linenumber").cast("long") - 4).alias("ay"),
    )
    return points.withColumn("site", grids.to_site(grid, [F.col("ax"), F.col("ay")]))


@query(
    f"""{sql_plane("natural_torus")}
SELECT l_orderkey, l_linenumber, l_partkey AS site,
  CASE WHEN l_partkey < p THEN l_partkey % w END AS ax, CASE WHEN l_partkey < p THEN l_partkey // w END AS ay
FROM lineitem, g"""
)
def g_to_coordinate(spark: SparkSession, folder: str) -> DataFrame:
    """Part numbers read as sites; those beyond the grid have no coordinates."""
    grid = supplier_grid(spark, folder, "natural_torus")
    points = tables.read(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    points = points.withColumnRenamed("l_partkey", "site")
    return points.withColumns(dict(zip(("ax", "ay"), grids.to_coordinate(grid, F.col("site")))))


@query(
    f"""{sql_plane("diagonal_lattice")}
SELECT l_orderkey, l_linenumber, l_partkey BETWEEN 0 AND p - 1 AS has_site,
  l_suppkey BETWEEN -((w - 1) // 2) AND (w - 1) // 2 AS has_x,
  l_suppkey BETWEEN -((w - 1) // 2) AND (w - 1) // 2
    AND l_quantity::BIGINT BETWEEN -((h - 1) // 2) AND (h - 1) // 2 AS has_point
FROM lineitem, g"""
)
def g_in_bounds(spark: SparkSession, folder: str) -> DataFrame:
    grid = supplier_grid(spark, folder, "diagonal_lattice")
    points = tables.read(
        spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    point = [F.col("l_suppkey"), F.col("l_quantity").cast("long")]
    return points.select(
        "l_orderkey",
        "l_linenumber",
        grids.has_site(grid, F.col("l_partkey")).alias("has_site"),
        grids.has_coordinate(grid, point, dim=0).alias("has_x"),
        grids.has_coordinate(grid, point).alias("has_point"),
    )


@query(
    f"""SELECT a.*, coalesce(n_items, 0)::BIGINT AS n_items FROM ({sql_plane("natural_lattice")}
SELECT 0::BIGINT AS dim, k - (w - 1) // 2 AS coordinate FROM (SELECT unnest(range((SELECT w FROM g))) AS k), g
UNION ALL SELECT 1, k - (h - 1) // 2 FROM (SELECT unnest(range((SELECT h FROM g))) AS k), g) a
LEFT JOIN (SELECT 0 AS dim, x AS coordinate, count(*) AS n_items FROM {SQL_ITEMS} GROUP BY ALL
  UNION ALL SELECT 1, y, count(*) FROM {SQL_ITEMS} GROUP BY ALL) n USING (dim, coordinate)"""
)
def g_axis(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates of both axes, with the line items of the supplier or nation of that number."""
    found = grids.axis(spark, supplier_grid(spark, folder, "natural_lattice"))
    items = items_at(spark, folder, "x", "y")
    counts = [
        items.groupBy(F.col(n).alias("coordinate")).agg(F.sum("n_items").alias("n_items")).withColumn("dim", F.lit(d).cast("long"))
        for d, n in enumerate("xy")
    ]
    counted = found.join(counts[0].unionByName(counts[1]), ["dim", "coordinate"], "left")
    return counted.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))


# --- edges -----------------------------------------------------------------------------------------------


@query(
    f"""SELECT e.*, coalesce(n_items, 0)::BIGINT AS n_items FROM ({sql_plane("natural_torus")}
SELECT k AS edge, {sql_mod("k % w - 1", "w")} AS x_a, k // w AS y_a, k % w AS x_b, k // w AS y_b
FROM (SELECT unnest(range((SELECT p FROM g))) AS k), g
UNION ALL
SELECT p + k, k // h, {sql_mod("k % h - 1", "h")}, k // h, k % h
FROM (SELECT unnest(range((SELECT p FROM g))) AS k), g) e
LEFT JOIN (SELECT x AS x_b, y AS y_b, count(*) AS n_items FROM {SQL_ITEMS} GROUP BY ALL) n USING (x_b, y_b)"""
)
def g_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every edge, with the number of line items at its second end."""
    found = grids.edges(spark, supplier_grid(spark, folder, "natural_torus"))
    items = items_at(spark, folder, "x", "y").withColumnsRenamed({"x": "x_b", "y": "y_b"})
    counted = found.join(items, ["x_b", "y_b"], "left")
    return counted.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))


@query(f"{SQL_LINE}, {SQL_CUSTOMER_EDGES} SELECT DISTINCT edge FROM broken")
def g_broken_permanent(spark: SparkSession, folder: str) -> DataFrame:
    return grids.permanent_edges(customer_grid(spark, folder, "cycle"), customer_edges(spark, folder))


@query(
    f"""WITH {SQL_EXTENTS},
k AS (SELECT c_custkey AS walk_id, step FROM customer, (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) AS t(step))
SELECT walk_id, step, edge FROM k, (SELECT unnest(range((SELECT nn FROM extents))) AS edge)
WHERE ('0x' || substr(md5('7:' || walk_id || ':' || step || ':' || edge), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1"""
)
def g_broken_random(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of a ring of nations that are broken for each customer's walk in steps 1 to 3."""
    ring = Grid("cycle", (tables.extent(spark, folder, "nation", "n_nationkey"),))
    steps = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("step")
    walks = tables.read(spark, folder, "customer", "c_custkey").select(F.col("c_custkey").alias("walk_id"), steps)
    return grids.random_edges(ring, walks, probability=0.1, seed=7)


@query(
    f"""{sql_plane("natural_torus")}, {SQL_NATURAL_EDGES}
SELECT k AS edge, k IN (SELECT edge FROM broken) AS is_broken
FROM (SELECT unnest(range((SELECT e FROM g))) AS k)"""
)
def g_broken_flags(spark: SparkSession, folder: str) -> DataFrame:
    grid = supplier_grid(spark, folder, "natural_torus")
    return grids.broken_flags(spark, grid, supplier_edges(spark, folder, grid))


# --- moves ---------------------------------------------------------------------------------------------------


@query(sql_orders_moved(sql_line_by_site("2 * nc + 1")))
def g_line_shift(spark: SparkSession, folder: str) -> DataFrame:
    return grids.moved(order_points(spark, folder), customer_grid(spark, folder, "line"))


@query(sql_orders_moved(sql_line_by_site("nc")))
def g_cycle_shift(spark: SparkSession, folder: str) -> DataFrame:
    return grids.moved(order_points(spark, folder), customer_grid(spark, folder, "cycle"))


@query(sql_line_by_edge(SQL_CUSTOMER_EDGES).replace("nc AS w, nc AS e", "2 * nc + 1 AS w, 2 * nc + 1 AS e"))
def g_line_shift_broken(spark: SparkSession, folder: str) -> DataFrame:
    return grids.transition(spark, customer_grid(spark, folder, "line"), customer_edges(spark, folder))


@query(sql_line_by_edge(SQL_CUSTOMER_EDGES))
def g_cycle_shift_broken(spark: SparkSession, folder: str) -> DataFrame:
    return grids.transition(spark, customer_grid(spark, folder, "cycle"), customer_edges(spark, folder))


@query(sql_orders_moved(sql_line_by_edge(SQL_NONE, SQL_BORDER_1D)))
def g_segment_shift(spark: SparkSession, folder: str) -> DataFrame:
    return grids.moved(order_points(spark, folder), customer_grid(spark, folder, "segment"))


@query(sql_line_by_edge(SQL_CUSTOMER_EDGES, SQL_BORDER_1D))
def g_segment_shift_broken(spark: SparkSession, folder: str) -> DataFrame:
    return grids.transition(spark, customer_grid(spark, folder, "segment"), customer_edges(spark, folder))


def _plane_shift(kind: str, with_broken: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        grid = supplier_grid(spark, folder, kind)
        if with_broken:
            return grids.transition(spark, grid, supplier_edges(spark, folder, grid))
        return grids.moved(item_points(spark, folder), grid)

    return run


def _register_planes() -> None:
    for style, short, edges in (
        ("diagonal", "diag", SQL_DIAGONAL_EDGES),
        ("natural", "nat", SQL_NATURAL_EDGES),
    ):
        variants = {
            f"g_{short}_lattice_shift": (f"{style}_lattice", False, sql_items_moved(sql_plane_by_site(f"{style}_lattice"))),
            f"g_{short}_torus_shift": (f"{style}_torus", False, sql_items_moved(sql_plane_by_site(f"{style}_torus"))),
            f"g_{short}_box_shift": (f"{style}_box", False, sql_items_moved(sql_plane_by_edge(f"{style}_box", SQL_NONE))),
            f"g_{short}_shift_broken": (f"{style}_torus", True, sql_plane_by_edge(f"{style}_torus", edges)),
            f"g_{short}_lattice_shift_broken": (f"{style}_lattice", True, sql_plane_by_edge(f"{style}_lattice", edges)),
            f"g_{short}_box_shift_broken": (f"{style}_box", True, sql_plane_by_edge(f"{style}_box", edges)),
        }
        for name, (kind, with_broken, sql) in variants.items():
            function = _plane_shift(kind, with_broken)
            function.__name__ = name
            query(sql)(function)


_register_planes()


@query(
    f"""{sql_plane("natural_box")}, t AS ({{moves}})
SELECT count(*) AS n, count(DISTINCT (src_coin, src_x, src_y)) AS n_src, count(DISTINCT (dst_coin, dst_x, dst_y)) AS n_dst,
  count(*) = count(DISTINCT (src_coin, src_x, src_y)) AND count(*) = count(DISTINCT (dst_coin, dst_x, dst_y)) AS is_permutation
FROM t""".replace("{moves}", sql_plane_by_edge("natural_box", SQL_NATURAL_EDGES))
)
def g_validate_transition(spark: SparkSession, folder: str) -> DataFrame:
    grid = supplier_grid(spark, folder, "natural_box")
    return grids.validate_transition(grids.transition(spark, grid, supplier_edges(spark, folder, grid)))


def _sql_shift_entries(order: str) -> str:
    return {
        "coin_position": "dst_coin * p + dst_x * h + dst_y AS \"row\", src_coin * p + src_x * h + src_y AS col",
        "position_coin": "(dst_x * h + dst_y) * 4 + dst_coin AS \"row\", (src_x * h + src_y) * 4 + src_coin AS col",
    }[order]


@query(
    f"""{sql_plane("natural_torus")}, t AS ({sql_plane_by_edge("natural_torus", SQL_NATURAL_EDGES)})
SELECT 'coin_position' AS representation, {_sql_shift_entries("coin_position")}, 1::BIGINT AS v FROM t, g
UNION ALL SELECT 'position_coin', {_sql_shift_entries("position_coin")}, 1 FROM t, g"""
)
def w_shift_operator(spark: SparkSession, folder: str) -> DataFrame:
    """The move matrix of a torus with broken edges, in both index orders."""
    grid = supplier_grid(spark, folder, "natural_torus")
    moves = grids.transition(spark, grid, supplier_edges(spark, folder, grid))
    parts = [
        grids.shift_entries(moves, grid, order).select(F.lit(order).alias("representation"), "*") for order in ORDERS
    ]
    return parts[0].unionByName(parts[1])
