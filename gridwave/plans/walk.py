"""Coined walks over whole tables of walks.

Every row carries ``walk_id``, so one job advances all walks together. One step applies the
interaction, then each particle's coin and move in particle order.

A particle's step is written to shuffle as little as possible. The coin mixes the amplitudes
that share everything but that particle's coin value, so the state is folded to one row per
such place, with one amplitude column pair per coin value (one aggregate); coin and move are
then projections, because a move sends each (coin, place) to exactly one other.

Partitioning. A walk holds at most (coins * sites)^particles rows, a number known up front.
When it is small, walks are partitioned by walk_id and steps need no further exchange. A larger
walk is cut into tiles of the grid (see ``tiles``): each tile also gets a copy of the rows
within k steps of it, runs k steps on its own, and keeps what lies inside it, which costs one
exchange per k steps. Where tiles would be mostly border, every fold shuffles by its full key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwave.functions.complexnum import abs_squared, number, scaled_terms, total
from gridwave.functions.draws import happens
from gridwave.operators.matrix import ROUND_DIGITS
from gridwave.plans.tiles import Tiling, choose_tiling, gather, spread
from gridwave.session import cut_lineage
from gridwave.sources.coins import Coin
from gridwave.sources.grids import BROADCAST_EDGES, Grid, edge_crossed, mark_broken, move, validate_transition
from gridwave.sources.states import State, position_keys

# Rows a task should hold, and the most partitions worth scheduling for it.
TASK_ROWS = 2_000_000
MAX_PARTITIONS = 100_000


@dataclass(frozen=True)
class RandomEdges:
    """Each edge broken with this probability, drawn anew per walk and step."""

    probability: float
    seed: int


@dataclass(frozen=True)
class Rules:
    """What happens in a step.

    ``coins`` has one coin per particle. Moves are those of the grid, with ``broken`` (a table)
    or ``random`` edges, or those of a table ``transition`` of one's own. Before them comes the
    factor for meeting particles, or any ``interaction`` from state to state.
    """

    coins: tuple[Coin, ...]
    broken: DataFrame | None = None
    random: RandomEdges | None = None
    transition: DataFrame | None = None
    meeting_factor: complex | None = None
    interaction: Callable[[State], State] | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.broken, self.random, self.transition)) > 1:
            raise ValueError("moves come from one of broken, random and transition")
        if self.meeting_factor is not None and self.interaction is not None:
            raise ValueError("give a meeting factor or an interaction of your own")


def norms(state: State) -> DataFrame:
    """(walk_id, norm, is_unit) per walk."""
    squared = F.sum(abs_squared(F.col("re"), F.col("im")))
    return (
        state.df.groupBy("walk_id")
        .agg(F.sqrt(squared).alias("norm"))
        .withColumn("is_unit", F.round("norm", ROUND_DIGITS) == F.lit(1.0))
    )


def check_norm(state: State, when: str) -> int:
    """One job: the number of walks; ValueError if any walk's amplitudes do not have norm one."""
    found = norms(state).agg(F.count("*").alias("walks"), F.count_if(~F.col("is_unit")).alias("bad")).first()
    if found["bad"]:
        raise ValueError(f"the {when} state does not have unit norm in {found['bad']} walks")
    return found["walks"]


def meeting(state: State) -> str:
    """SQL for whether any two particles share their position."""
    places = [position_keys(state.grid, p) for p in range(state.particles)]
    pairs = [
        " AND ".join(f"{u} = {v}" for u, v in zip(a, b)) for i, a in enumerate(places) for b in places[i + 1 :]
    ]
    return " OR ".join(pairs)


def apply_interaction(state: State, factor: complex) -> State:
    """Amplitudes of meeting particles times ``factor`` (once, however many meet)."""
    re, im = scaled_terms(complex(factor), "re", "im")
    meets = meeting(state)
    return state.with_df(
        state.df.selectExpr(
            *state.all_keys, f"if({meets}, {total(re)}, re) AS re", f"if({meets}, {total(im)}, im) AS im"
        )
    )


def apply_coin(state: State, coin: Coin, particle: int = 0) -> State:
    """The coin on one particle: one fold, then one row per coin value with an amplitude."""
    if coin.size != state.grid.coins:
        raise ValueError(f"a coin of size {coin.size} does not fit a grid with {state.grid.coins} coin values")
    return state.with_df(mix(state.df, coin, f"c{particle}", [k for k in state.all_keys if k != f"c{particle}"]))


def mix(df: DataFrame, coin: Coin, slot: str, keys: list[str]) -> DataFrame:
    """Vectors over ``slot`` (0 .. size-1), one per ``keys``, times the coin matrix."""
    size = coin.size
    amplitudes = [
        F.expr(f"sum(if({slot} = {j}, {name}, {number(0.0)})) AS _{name}{j}") for j in range(size) for name in ("re", "im")
    ]
    folded = df.groupBy(*keys).agg(*amplitudes)
    outcomes = []
    for i in range(size):
        terms = [scaled_terms(coin.rows[i][j], f"_re{j}", f"_im{j}") for j in range(size)]
        re, im = (total(t for part in terms for t in part[side]) for side in (0, 1))
        outcomes.append(f"named_struct('{slot}', {i}L, 're', {re}, 'im', {im})")
    mixed = folded.selectExpr(*keys, f"inline(array({', '.join(outcomes)}))")
    return mixed.where("re <> 0 OR im <> 0")


def apply_move(state: State, rules: Rules, step: int, particle: int = 0) -> State:
    """The move of one particle: a projection, with a join only for a table of broken edges."""
    grid, keys = state.grid, state.keys(particle)
    coin, at = keys[0], keys[1:]
    df, is_broken = state.df, None
    if rules.broken is not None:
        broken = rules.broken
        if "step" in broken.columns:
            broken = broken.where(F.col("step") == step).drop("step")
        df = mark_broken(df.selectExpr("*", f"{edge_crossed(grid, coin, at)} AS edge"), broken, grid)
        is_broken = "is_broken"
    elif rules.random is not None:
        draw = ("walk_id", str(step), edge_crossed(grid, coin, at))
        is_broken = happens(rules.random.probability, rules.random.seed, *draw)
    if rules.transition is not None:
        names = ["coin", *grid.axes]
        table = rules.transition
        if grid.coins * grid.sites <= BROADCAST_EDGES:
            table = F.broadcast(table)
        df = df.join(table, [F.col(k) == F.col(f"src_{n}") for k, n in zip(keys, names)])
        new_coin, *new_at = [f"dst_{n}" for n in names]
    else:
        new_coin, new_at = move(grid, coin, at, is_broken)
    moved = dict(zip(keys, [new_coin, *new_at]))
    columns = [f"CAST({moved[k]} AS BIGINT) AS {k}" if moved.get(k, k) != k else k for k in state.all_keys]
    return state.with_df(df.selectExpr(*columns, "re", "im"))


def one_step(state: State, rules: Rules, step: int = 1) -> State:
    if len(rules.coins) != state.particles:
        raise ValueError(f"{state.particles} particles need as many coins, not {len(rules.coins)}")
    if rules.interaction is not None:
        state = rules.interaction(state)
    elif rules.meeting_factor is not None and state.particles > 1:
        state = apply_interaction(state, rules.meeting_factor)
    for particle, coin in enumerate(rules.coins):
        state = apply_move(apply_coin(state, coin, particle), rules, step, particle)
    return state


def check_transition(transitions: DataFrame, grid: Grid) -> None:
    """One job; ValueError unless the table moves every coin and position to a distinct one."""
    found = validate_transition(transitions).first()
    if not found["is_permutation"] or found["n"] != grid.coins * grid.sites:
        raise ValueError("a transition table is a permutation of all coins and positions")


def rows_reached(state: State, steps: int) -> int:
    """Most rows one walk of particles that start on one site can have after ``steps`` steps."""
    sites = math.prod(min(n, 2 * steps + 1) for n in state.grid.shape)
    return (state.grid.coins * sites) ** state.particles


def walk(
    state: State,
    rules: Rules,
    steps: int,
    *,
    cut_every: int = 10,
    verify: bool = True,
    tiling: Tiling | None = None,
    partitions: int | None = None,
) -> State:
    """The state after ``steps`` steps of every walk.

    ``verify`` checks that each walk has norm one before and after, as two small jobs. The
    history is cut every ``cut_every`` steps. ``tiling`` overrides how walks are partitioned.
    Without ``partitions`` there are as many as the session sets, or more where the number of
    walks (known from the first check) would make them too large.
    """
    if rules.transition is not None:
        check_transition(rules.transition, state.grid)
    walks = check_norm(state, "initial") if verify else 1
    local_moves = rules.transition is None and rules.interaction is None
    tiling = tiling or choose_tiling(state, local_moves)
    if partitions is None:
        configured = int(state.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        needed = -(-walks * rows_reached(state, steps) // TASK_ROWS)
        partitions = max(configured, min(needed, MAX_PARTITIONS))
    done = 0
    while done < steps:
        span = min(cut_every, steps - done, tiling.steps or cut_every)
        state = spread(state, tiling, span, partitions)
        for step in range(done + 1, done + span + 1):
            state = one_step(state, rules, step)
        state = gather(state, tiling)
        before, done = done, done + span
        if done == steps:
            if verify:
                state = state.with_df(cut_lineage(state.df))
        elif done // cut_every > before // cut_every:
            state = state.with_df(cut_lineage(state.df))
    if verify:
        check_norm(state, "final")
    return state
