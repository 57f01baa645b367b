"""Walk operators over flat state indices, written out as matrices or only applied to vectors.

An operator has as many columns as the grid has states, however few of them a vector fills.
``apply_*`` make an operator's cells only in the columns where the vector has some, and
where they are multiplied: no table of the grid's size is made, moved or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.functions.complexnum import product
from gridwave.functions.indexing import (
    COIN_POSITION,
    check_order,
    check_space,
    digit,
    one_particle_index,
    split_one_particle,
)
from gridwave.operators.matrix import MatrixTable, cast_to, clear, kron_identity, matmul
from gridwave.sources.coins import Coin, entries
from gridwave.sources.grids import Grid, at_pos, moved, pos_of, shift_entries, transition


def _check_coin(coin: Coin, grid: Grid) -> None:
    if coin.size != grid.coins:
        raise ValueError(f"a coin of size {coin.size} does not fit a grid with {grid.coins} coin values")


def coin_operator(spark: SparkSession, coin: Coin, grid: Grid, order: str = COIN_POSITION) -> MatrixTable:
    """The coin at every position: coin (x) I or I (x) coin, depending on the order."""
    check_order(order)
    _check_coin(coin, grid)
    pos = F.col("id")
    rows = spark.range(grid.sites).select(pos, F.inline(entries(coin)))
    cells = rows.select(
        one_particle_index(F.col("ci"), pos, grid.coins, grid.sites, order).alias("row"),
        one_particle_index(F.col("cj"), pos, grid.coins, grid.sites, order).alias("col"),
        "re",
        "im",
    )
    n = grid.coins * grid.sites
    return clear(MatrixTable(cells, (n, n), "complex"))


def shift_operator(
    spark: SparkSession, grid: Grid, broken: DataFrame | None = None, order: str = COIN_POSITION
) -> MatrixTable:
    """The moves of the grid as a permutation matrix."""
    n = grid.coins * grid.sites
    return MatrixTable(shift_entries(transition(spark, grid, broken), grid, order), (n, n), "int", n)


def evolution_operator(
    spark: SparkSession, coin: Coin, grid: Grid, broken: DataFrame | None = None, order: str = COIN_POSITION
) -> MatrixTable:
    """Move after coin, as one matrix. A row of either factor has few cells, so none is cut."""
    return matmul(
        shift_operator(spark, grid, broken, order), coin_operator(spark, coin, grid, order), split_hot=False
    )


def lift(operator: MatrixTable, particle: int, particles: int) -> MatrixTable:
    """An operator of one particle on the joint index of all of them."""
    base = operator.shape[0]
    check_space(base, particles)
    if particle:
        operator = kron_identity(operator, base**particle, "left")
    if particle < particles - 1:
        operator = kron_identity(operator, base ** (particles - 1 - particle), "right")
    return operator


def _meets(k: Column, grid: Grid, particles: int, order: str) -> Column:
    """Whether any two particles of the joint index share a position."""
    base = grid.coins * grid.sites
    pos = [split_one_particle(digit(k, base, p, particles), grid.coins, grid.sites, order)[1] for p in range(particles)]
    meets = F.lit(False)
    for a in range(particles):
        for b in range(a + 1, particles):
            meets = meets | (pos[a] == pos[b])
    return meets


def interaction_operator(
    spark: SparkSession, grid: Grid, particles: int, factor: complex, order: str = COIN_POSITION
) -> MatrixTable:
    """Diagonal: ``factor`` where any two particles share a position, else one."""
    size = check_space(grid.coins * grid.sites, particles)
    k = F.col("id")
    cells = spark.range(size).select(k.alias("row"), k.alias("col"), *_factor(_meets(k, grid, particles, order), factor))
    return MatrixTable(cells, (size, size), "complex", size)


def _factor(meets: Column, factor: complex) -> tuple[Column, Column]:
    factor = complex(factor)
    return (
        F.when(meets, F.lit(factor.real)).otherwise(F.lit(1.0)).alias("re"),
        F.when(meets, F.lit(factor.imag)).otherwise(F.lit(0.0)).alias("im"),
    )


# --- applied to vectors -----------------------------------------------------------------------------


def _filled(v: MatrixTable, size: int) -> DataFrame:
    """(k, col, b_re, b_im): the cells of a column vector that an operator of this size has a column for."""
    if v.shape != (size, 1):
        raise ValueError(f"incompatible shapes {(size, size)} and {v.shape}")
    cells = clear(cast_to(v, "complex")).df.where(F.col("row").between(0, size - 1))
    return cells.select(F.col("row").alias("k"), "col", F.col("re").alias("b_re"), F.col("im").alias("b_im"))


def _times(cells: DataFrame, row: Column) -> DataFrame:
    """(row, col, re, im) of an operator's cells (re, im) that are not zero, times what their column meets."""
    re, im = product((F.col("re"), F.col("im")), (F.col("b_re"), F.col("b_im")))
    kept = cells.where((F.col("re") != 0) | (F.col("im") != 0))
    return kept.select(row.alias("row"), "col", re.alias("re"), im.alias("im"))


def _summed(cells: DataFrame, shape: tuple[int, int]) -> MatrixTable:
    sums = cells.groupBy("row", "col").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return clear(MatrixTable(sums, shape, "complex"))


def _coined(v: MatrixTable, coin: Coin, grid: Grid, order: str) -> DataFrame:
    """(coin, pos, col, b_re, b_im, re, im): each cell of the vector with the coin's cells in its column."""
    _check_coin(coin, grid)
    cj, pos = split_one_particle(F.col("k"), grid.coins, grid.sites, order)
    points = _filled(v, grid.coins * grid.sites).select(cj.alias("from"), pos.alias("pos"), "col", "b_re", "b_im")
    return points.select("*", F.inline(entries(coin))).where(F.col("cj") == F.col("from")).withColumnRenamed("ci", "coin")


def apply_coin(v: MatrixTable, coin: Coin, grid: Grid, order: str = COIN_POSITION) -> MatrixTable:
    """``coin_operator`` times a column vector."""
    row = one_particle_index(F.col("coin"), F.col("pos"), grid.coins, grid.sites, order)
    return _summed(_times(_coined(v, coin, grid, order), row), v.shape)


def apply_evolution(v: MatrixTable, coin: Coin, grid: Grid, order: str = COIN_POSITION) -> MatrixTable:
    """``evolution_operator`` of a whole grid times a column vector."""
    at = [a.alias(n) for a, n in zip(at_pos(grid, F.col("pos")), grid.axes)]
    points = _coined(v, coin, grid, order).select("coin", *at, "col", "b_re", "b_im", "re", "im")
    to = pos_of(grid, [F.col(f"dst_{n}") for n in grid.axes])
    row = one_particle_index(F.col("dst_coin"), to, grid.coins, grid.sites, order)
    return _summed(_times(moved(points, grid), row), v.shape)


def apply_interaction(
    v: MatrixTable, grid: Grid, particles: int, factor: complex, order: str = COIN_POSITION
) -> MatrixTable:
    """``interaction_operator`` times a column vector; a diagonal moves nothing."""
    size = check_space(grid.coins * grid.sites, particles)
    cells = _filled(v, size).select("*", *_factor(_meets(F.col("k"), grid, particles, order), factor))
    return clear(MatrixTable(_times(cells, F.col("k")), v.shape, "complex"))
