"""Start states: one row per (walk, coin and position of every particle), amplitude re + i*im.

Columns are ``walk_id``, then ``c0, x0[, y0]``, ``c1, x1[, y1]`` ... and ``re, im``. The key
stays structured, so any number of particles fits; the flat index is for import and export.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwave.functions.complexnum import product
from gridwave.functions.indexing import (
    COIN_POSITION,
    check_space,
    digit,
    join_digits,
    one_particle_index,
    split_one_particle,
)
from gridwave.sources.grids import Grid, at_pos, pos_of


@dataclass(frozen=True)
class State:
    df: DataFrame
    grid: Grid
    particles: int
    tags: tuple[str, ...] = ()  # further key columns a plan carries along

    def keys(self, particle: int) -> list[str]:
        return particle_keys(self.grid, particle)

    @property
    def all_keys(self) -> list[str]:
        return ["walk_id", *self.tags] + [k for p in range(self.particles) for k in self.keys(p)]

    @property
    def positions(self) -> list[str]:
        return [k for p in range(self.particles) for k in position_keys(self.grid, p)]

    def with_df(self, df: DataFrame) -> State:
        return State(df, self.grid, self.particles, self.tags)

    def tagged(self, df: DataFrame, *tags: str) -> State:
        return State(df, self.grid, self.particles, tags)


def position_keys(grid: Grid, particle: int) -> list[str]:
    return [f"{a}{particle}" for a in grid.axes]


def particle_keys(grid: Grid, particle: int) -> list[str]:
    return [f"c{particle}"] + position_keys(grid, particle)


def initial_state(starts: DataFrame, grid: Grid, coin_state: list[tuple] | DataFrame) -> State:
    """One particle per row of ``starts`` (walk_id, x[, y]).

    ``coin_state`` lists (coin, re, im) for all walks; re and im are numbers or columns of
    ``starts``, so each walk may have its own amplitudes. Or it is a table (walk_id, coin, re,
    im). Starts outside the grid fail the job.
    """
    inside = F.lit(True)
    for name, n in zip(grid.axes, grid.shape):
        inside = inside & F.col(name).between(0, n - 1)
    position = [
        F.when(inside, F.col(name)).otherwise(F.raise_error(F.lit("position out of grid boundaries")))
        .cast("long").alias(f"{name}0")
        for name in grid.axes
    ]
    if isinstance(coin_state, DataFrame):
        amplitudes = coin_state.select(
            "walk_id", F.col("coin").cast("long").alias("c0"), _double(F.col("re")).alias("re"), _double(F.col("im")).alias("im")
        )
        df = starts.select("walk_id", *position).join(amplitudes, "walk_id")
    else:
        structs = [
            F.struct(F.lit(c).cast("long").alias("c0"), _double(re).alias("re"), _double(im).alias("im"))
            for c, re, im in coin_state
        ]
        df = starts.select("walk_id", *position, F.inline(F.array(*structs)))
    df = df.where((F.col("re") != 0) | (F.col("im") != 0))
    return State(df.select("walk_id", *particle_keys(grid, 0), "re", "im"), grid, 1)


def _double(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("double")


def join_particles(a: State, b: State) -> State:
    """The product state: per walk, every entry of ``a`` times every entry of ``b``.

    An equi-join on walk_id; the result has that many entries by definition.
    """
    if a.grid != b.grid:
        raise ValueError("particles must be on the same grid")
    renamed = b.df.withColumnsRenamed(
        {k: f"{k[0]}{int(k[1:]) + a.particles}" for k in b.all_keys if k != "walk_id"}
        | {"re": "_re", "im": "_im"}
    )
    joined = a.df.join(renamed, "walk_id")
    re, im = product((F.col("re"), F.col("im")), (F.col("_re"), F.col("_im")))
    result = State(joined, a.grid, a.particles + b.particles)
    return result.with_df(joined.select(*result.all_keys, re.alias("re"), im.alias("im")))


def decode(flat: DataFrame, grid: Grid, particles: int, order: str = COIN_POSITION) -> State:
    """(walk_id, k, re, im) with the flat index k into structured keys."""
    base = grid.coins * grid.sites
    check_space(base, particles)
    columns = []
    for p in range(particles):
        coin, pos = split_one_particle(digit(F.col("k"), base, p, particles), grid.coins, grid.sites, order)
        columns.append(coin.cast("long").alias(f"c{p}"))
        columns += [a.cast("long").alias(n) for a, n in zip(at_pos(grid, pos), position_keys(grid, p))]
    return State(flat.select("walk_id", *columns, "re", "im"), grid, particles)


def encode(state: State, order: str = COIN_POSITION) -> DataFrame:
    """(walk_id, k, re, im): the state by flat index."""
    grid = state.grid
    base = grid.coins * grid.sites
    check_space(base, state.particles)
    digits = [
        one_particle_index(
            F.col(f"c{p}"),
            pos_of(grid, [F.col(n) for n in position_keys(grid, p)]),
            grid.coins,
            grid.sites,
            order,
        )
        for p in range(state.particles)
    ]
    return state.df.select("walk_id", join_digits(digits, base).alias("k"), "re", "im")
