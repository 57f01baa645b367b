"""Tiles: which rows of a walk are kept together, and for how many steps.

A walker moves at most one site per dimension and step, so after k steps the amplitudes inside
a stretch of the grid depend only on rows that started within k sites of it. A tile is a box of
stretches, one per position column. Rows are copied to every tile whose stretch is within k
sites, all copies evolve for k steps without an exchange, and rows outside their own tile are
dropped. What is kept is exact; nothing is estimated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from gridwave.sources.states import State

TILE = "_tile"
# Rows a task may hold for one tile of one walk.
TILE_ROWS = 65_536
# Copies per row, on average, that saving exchanges is worth.
MAX_COPIES = 1.6
MAX_STEPS = 10


@dataclass(frozen=True)
class Tiling:
    """``kind`` is "walk" (whole walks), "tile" (stretches of ``width`` sites) or "key" (neither).

    ``steps`` is the number of steps between exchanges, None for no limit.
    """

    kind: str
    width: int = 0
    steps: int | None = None


def choose_tiling(state: State, local_moves: bool = True, tile_rows: int = TILE_ROWS) -> Tiling:
    """Whole walks where they are small; tiles where moves are local and borders narrow."""
    grid, particles = state.grid, state.particles
    if (grid.coins * grid.sites) ** particles <= tile_rows:
        return Tiling("walk")
    dims = len(state.positions)
    width = int((tile_rows / grid.coins**particles) ** (1 / dims))
    steps = min(MAX_STEPS, int(width / 2 * (MAX_COPIES ** (1 / dims) - 1)))
    return Tiling("tile", width, steps) if local_moves and steps >= 2 else Tiling("key")


def _stretches(state: State, width: int) -> list[tuple[str, int, int]]:
    """(column, sites, number of stretches); the last stretch takes the remainder."""
    sizes = list(state.grid.shape) * state.particles
    return [(name, n, max(1, n // width)) for name, n in zip(state.positions, sizes)]


def _stretch_of(position: str, width: int, count: int) -> str:
    return f"least(({position}) div {width}, {count - 1})"


def spread(state: State, tiling: Tiling, steps: int, partitions: int) -> State:
    """The state partitioned for ``steps`` steps, with copies at the borders of tiles."""
    if tiling.kind == "key":
        return state
    if tiling.kind == "walk":
        return state.with_df(state.df.repartition(partitions, "walk_id"))
    if steps > tiling.width:
        raise ValueError("a tile must be at least as wide as the steps between exchanges")
    df, number = state.df, "0L"
    for name, n, count in _stretches(state, tiling.width):
        if count == 1:
            continue
        around = [_stretch_of(f"pmod({name} + {d}, {n})", tiling.width, count) for d in (-steps, 0, steps)]
        df = df.withColumn(f"_{name}", F.expr(f"explode(array_distinct(array({', '.join(around)})))"))
        number = f"({number}) * {count} + _{name}"
    df = df.selectExpr("walk_id", f"{number} AS {TILE}", *state.all_keys[1:], "re", "im")
    return state.tagged(df.repartition(partitions, "walk_id", TILE), TILE)


def gather(state: State, tiling: Tiling) -> State:
    """The rows that lie in their own tile."""
    if tiling.kind != "tile":
        return state
    number = "0L"
    for name, _, count in _stretches(state, tiling.width):
        if count > 1:
            number = f"({number}) * {count} + {_stretch_of(name, tiling.width, count)}"
    own = state.df.where(f"{TILE} = {number}")
    return state.tagged(own.drop(TILE))
