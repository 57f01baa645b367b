"""Distributions: measured from walk states or counted from facts.

A distribution has columns for what it ranges over and ``p``. Walk distributions carry
``walk_id`` as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwave.functions.complexnum import abs_squared
from gridwave.functions.ranges import repeat_over_range
from gridwave.operators.matrix import MAX_LOCAL_CELLS, ROUND_DIGITS
from gridwave.sources.grids import Grid, at_pos
from gridwave.sources.states import State, position_keys

# --- from states ------------------------------------------------------------------------------


def joint(state: State) -> DataFrame:
    """(walk_id, positions of all particles, p)."""
    return _by_position(state, range(state.particles))


def marginal(state: State, particle: int) -> DataFrame:
    """(walk_id, position of one particle, p)."""
    if not 0 <= particle < state.particles:
        raise ValueError(f"particle {particle} is none of the {state.particles}")
    return _by_position(state, [particle])


def _by_position(state: State, particles) -> DataFrame:
    keys = ["walk_id"] + [k for p in particles for k in position_keys(state.grid, p)]
    return state.df.groupBy(*keys).agg(F.sum(abs_squared(F.col("re"), F.col("im"))).alias("p"))


def collisions(joint_df: DataFrame, grid: Grid, particles: int) -> DataFrame:
    """(walk_id, x[, y], p): the joint cells where all particles share a site, as they are."""
    if particles < 2:
        raise ValueError("a collision takes at least two particles")
    same = F.lit(True)
    for p in range(1, particles):
        for a, b in zip(position_keys(grid, 0), position_keys(grid, p)):
            same = same & (F.col(a) == F.col(b))
    place = [F.col(k).alias(k[0]) for k in position_keys(grid, 0)]
    return joint_df.where(same).select("walk_id", *place, "p")


def centered(distribution: DataFrame, grid: Grid) -> DataFrame:
    """Positions shifted to the coordinates of the axes (negative ones on lines and lattices)."""
    shifts = dict(zip(grid.axes, grid.axis_start))
    return distribution.select(
        *[
            (F.col(c) + F.lit(shifts[c[0]])).alias(c) if c[0] in shifts and c[1:].isdigit() else F.col(c)
            for c in distribution.columns
        ]
    )


def check_total(distribution: DataFrame, by: list[str]) -> None:
    """One action; ValueError unless the probabilities of each group sum to one."""
    totals = distribution.groupBy(*by).agg(F.sum("p").alias("p"))
    if not totals.where(F.round("p", ROUND_DIGITS) != F.lit(1.0)).isEmpty():
        raise ValueError("there is a group whose p do not add up to 1")


# --- from facts ---------------------------------------------------------------------------------


def empirical(facts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, p): share of the facts per combination of the columns.

    Counts are taken once; the total is the sum of the counts, not another pass over facts.
    """
    counts = facts.groupBy(*by).agg(F.count("*").alias("n"))
    everything = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("p", F.col("n") / everything)


def weighted(facts: DataFrame, by: list[str], over: list[str], weight: Column) -> DataFrame:
    """(by, over, p): each cell's share of the weight of its group, summed from the facts in one aggregate.

    Cells without weight are left out. A group whose shares do not sum to one (negative or
    not finite weights, or a sum of zero) fails while the plan runs.
    """
    cells = facts.groupBy(*by, *over).agg(F.sum(weight).cast("double").alias("_w")).where(F.col("_w") != 0)
    totals = cells.groupBy(*by).agg(F.sum("_w").alias("_whole"), F.min("_w").alias("_least"), F.max("_w").alias("_most"))
    # Shares of a finite whole that is not zero sum to one; none is negative where all weights have its sign.
    finite = F.abs("_whole") < float("inf")
    wrong = ~finite | F.col("_whole").isNull() | (F.col("_whole") == 0) | (F.col("_least") / F.col("_whole") < 0) | (F.col("_most") / F.col("_whole") < 0)
    whole = F.when(F.coalesce(wrong, F.lit(True)), _not_one()).otherwise(F.col("_whole"))
    return _with_totals(cells, totals.select(*by, whole.alias("_whole")), by).select(*by, *over, (F.col("_w") / F.col("_whole")).alias("p"))


def checked(distribution: DataFrame, by: list[str]) -> DataFrame:
    """``distribution`` as it is; reading it fails if the shares of a group are negative or do not sum to one.

    Sums are taken before groups meet. What they may be off grows with the number of cells.
    """
    totals = distribution.groupBy(*by).agg(F.sum("p").alias("_whole"), F.min("p").alias("_least"), F.count("*").alias("_n"))
    off = F.abs(F.col("_whole") - 1) > 10.0**-ROUND_DIGITS + 1e-16 * F.col("_n")
    wrong = F.isnan("_whole") | F.col("_whole").isNull() | off | (F.col("_least") < 0)
    told = totals.select(*by, F.when(wrong, _not_one()).otherwise(F.lit(1.0)).alias("_one"))
    joined = _with_totals(distribution, told, by)
    return joined.select(*[(F.col("p") * F.col("_one")).alias(c) if c == "p" else F.col(c) for c in distribution.columns])


def _not_one() -> Column:
    return F.raise_error(F.lit("shares of a group do not make up one")).cast("double")


def _with_totals(cells: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Cells with the row of their group (null keys are a group too); cells of a large group stay spread, adaptive joins split it."""
    kept = totals.columns
    totals = totals.select(*[F.col(c).alias(f"_{c}_by") if c in by else F.col(c) for c in kept])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_by"))
    return cells.join(totals, same)


def marginals(facts: DataFrame, over: list[str], weight: Column, sets: list[list[str]]) -> DataFrame:
    """(over, grouping, p): the shares of several marginals of a distribution of facts, in one pass over them.

    ``sets`` lists which of the columns each marginal keeps; the others are null there, and
    ``grouping`` has a bit for each of those, the last column's the lowest. All shares are of
    the weight of all facts.
    """
    if any(c not in over for kept in sets for c in kept):
        raise ValueError("a marginal keeps columns of the distribution")
    every = [[F.col(c) for c in kept] for kept in sets]
    whole = [] in sets
    cells = facts.select(*over, weight.cast("double").alias("_w")).groupingSets(every if whole else [*every, []], *[F.col(c) for c in over])
    sums = cells.agg(F.sum("_w").alias("_w"), F.grouping_id(*over).cast("long").alias("grouping"))
    everything = sums.where(F.col("grouping") == 2 ** len(over) - 1).agg(F.sum("_w")).scalar()
    out = sums.withColumn("p", F.col("_w") / everything).drop("_w")
    return out if whole else out.where(F.col("grouping") != 2 ** len(over) - 1)


def co_located(distribution: DataFrame, places: list[list[str]]) -> DataFrame:
    """The cells in which all places (lists of columns, one per particle or party) agree, as they are."""
    if len(places) < 2:
        raise ValueError("give two places at least")
    same = F.lit(True)
    for place in places[1:]:
        for a, b in zip(places[0], place, strict=True):
            same = same & (F.col(a) == F.col(b))
    return distribution.where(same)


def marginal_of(distribution: DataFrame, by: list[str]) -> DataFrame:
    """A joint distribution summed over everything but ``by``."""
    return distribution.groupBy(*by).agg(F.sum("p").alias("p"))


# --- figures of a distribution ------------------------------------------------------------------


def _present(distribution: DataFrame) -> DataFrame:
    return distribution.where(F.col("p") != 0)


def _grouped(distribution: DataFrame, by: list[str], value) -> DataFrame:
    return distribution.groupBy(*by).agg(value) if by else distribution.agg(value)


def total(distribution: DataFrame, by: list[str]) -> DataFrame:
    return _grouped(_present(distribution), by, F.coalesce(F.sum("p"), F.lit(0.0)).alias("total"))


def norm(distribution: DataFrame, by: list[str]) -> DataFrame:
    squares = F.coalesce(F.sum(F.col("p") * F.col("p")), F.lit(0.0))
    return _grouped(_present(distribution), by, F.sqrt(squares).alias("norm"))


def largest(distribution: DataFrame, by: list[str]) -> DataFrame:
    return _grouped(distribution, by, F.max("p").alias("max_p"))


def largest_at(distribution: DataFrame, by: list[str], over: list[str]) -> DataFrame:
    """(by, max_p, over): the largest p and where it is, the first place of equal ones."""
    order = F.struct((-F.col("p")).alias("_p"), *over)
    best = _grouped(distribution, by, F.min(order).alias("_m"))
    return best.select(*by, (-F.col("_m._p")).alias("max_p"), *[F.col(f"_m.{c}").alias(c) for c in over])


def smallest(distribution: DataFrame, by: list[str]) -> DataFrame:
    return _grouped(distribution, by, F.min("p").alias("min_p"))


def ensemble_average(distribution: DataFrame, over: list[str], runs: int) -> DataFrame:
    """(over, p): the mean of p over ``runs`` runs, absent cells counting as zero."""
    if runs < 1:
        raise ValueError("an average takes at least one run")
    return distribution.groupBy(*over).agg((F.sum("p") / F.lit(float(runs))).alias("p"))


def average_over(distribution: DataFrame, over: list[str], run: list[str]) -> DataFrame:
    """(over, p): the mean of p over the runs that occur, absent cells counting as zero."""
    runs = distribution.select(*run).distinct().agg(F.count("*").cast("double")).scalar()
    return distribution.groupBy(*over).agg(F.sum("p").alias("p")).withColumn("p", F.col("p") / runs)


# --- dense ----------------------------------------------------------------------------------------


def dense(distribution: DataFrame, walks: DataFrame, grid: Grid, particles: int = 1) -> DataFrame:
    """Every (walk, positions) cell of the grid, with p = 0 where nothing was measured."""
    every = repeat_over_range(walks.select("walk_id").distinct(), grid.sites**particles, "_cell")
    positions = []
    rest = F.col("_cell")
    for p in reversed(range(particles)):
        at = at_pos(grid, F.pmod(rest, F.lit(grid.sites)))
        positions = [a.cast("long").alias(n) for a, n in zip(at, position_keys(grid, p))] + positions
        rest = F.call_function("div", rest, F.lit(grid.sites))
    keys = ["walk_id"] + [k for p in range(particles) for k in position_keys(grid, p)]
    cells = every.select("walk_id", *positions)
    return cells.join(distribution, keys, "left").select(*keys, F.coalesce("p", F.lit(0.0)).alias("p"))


def to_ndarray(distribution: DataFrame, grid: Grid, particles: int = 1, max_cells: int = MAX_LOCAL_CELLS):
    """A numpy array of one walk's distribution over the axes, for grids of few enough cells."""
    import numpy as np

    shape = grid.shape * particles
    if grid.sites**particles > max_cells:
        raise ValueError(f"{grid.sites**particles} cells exceed the limit of {max_cells} for a local array")
    keys = [k for p in range(particles) for k in position_keys(grid, p)]
    # As many rows as the grid has cells, and one more, which would be one too many.
    rows = distribution.select("walk_id", *keys, "p").limit(grid.sites**particles + 1).collect()
    if len({r["walk_id"] for r in rows}) > 1:
        raise ValueError("a local array holds one walk; choose it first")
    if len({tuple(r[k] for k in keys) for r in rows}) < len(rows):
        raise ValueError("a cell has several rows; sum them first")
    result = np.zeros(shape)
    for r in rows:
        result[tuple(r[k] for k in keys)] = r["p"]
    return result
