from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gridwave.functions.complexnum import phase_factor
from gridwave.functions.indexing import ORDERS
from gridwave.operators import matrix as mx
from gridwave.operators import measure
from gridwave.plans import operator_tables as ot
from gridwave.plans import walk as wk
from gridwave.plans.tiles import Tiling, choose_tiling
from gridwave.plans.walk import RandomEdges, Rules
from gridwave.sources import grids
from gridwave.sources.coins import fourier, grover, hadamard
from gridwave.sources.grids import Grid
from gridwave.sources.states import State, decode, encode, initial_state, join_particles
from gridwave.workload import all_queries

HALF = 1 / math.sqrt(2)
ZERO, BALANCED = [(0, 1.0, 0.0)], [(0, HALF, 0.0), (1, 0.0, HALF)]
PLANE = [(0, 0.5, 0.0), (1, 0.0, 0.5), (2, 0.0, -0.5), (3, 0.5, 0.0)]
SIGN = phase_factor(1j * math.pi)


def start(spark, grid: Grid, coin_state, *at: int, walks: int = 1) -> State:
    place = [f"{x}L AS {n}" for x, n in zip(at or grid.center, grid.axes)]
    return initial_state(spark.range(walks).selectExpr("id AS walk_id", *place), grid, coin_state)


def edge_set(spark, *edges: int):
    return spark.createDataFrame([(e,) for e in edges], "edge long")


def amplitudes(state: State) -> dict:
    return {tuple(r[k] for k in state.all_keys): complex(r["re"], r["im"]) for r in state.df.collect()}


def distance(a: State, b: State) -> float:
    u, v = amplitudes(a), amplitudes(b)
    return max(abs(u.get(k, 0) - v.get(k, 0)) for k in u.keys() | v.keys())


# Expected distributions of short walks from the centre, by position.
GOLDEN_1D = {
    "plain": ("line", 9, ZERO, None, [0.0625, 0, 0.125, 0, 0.125, 0, 0.625, 0, 0.0625]),
    "balanced": ("line", 9, BALANCED, None, [0.0625, 0, 0.375, 0, 0.125, 0, 0.375, 0, 0.0625]),
    "none broken": ("line", 9, ZERO, [], [0.0625, 0, 0.625, 0, 0.125, 0, 0.125, 0, 0.0625]),
    "one broken": ("line", 9, ZERO, [5], [0.0625, 0.0625, 0.625, 0.125, 0.125, 0, 0, 0, 0]),
    "cycle": ("cycle", 5, ZERO, None, [0.125, 0.0625, 0.125, 0.0625, 0.625]),
    "segment": ("segment", 5, ZERO, None, [0.625, 0.0625, 0.125, 0.0625, 0.125]),
}


@pytest.mark.parametrize("name", GOLDEN_1D)
def test_one_dimensional_goldens(spark, name):
    kind, n, coin_state, broken, expected = GOLDEN_1D[name]
    grid = Grid(kind, (n,))
    rules = Rules((hadamard(1),), broken=None if broken is None else edge_set(spark, *broken))
    p = measure.to_ndarray(measure.joint(wk.walk(start(spark, grid, coin_state), rules, 4)), grid)
    assert p == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize(
    "style, corners, centre_ring",
    [
        ("diagonal", [(x, y) for x in (0, 4) for y in (0, 4)], [(0, 2), (2, 0), (2, 4), (4, 2)]),
        ("natural", [(0, 2), (2, 0), (2, 4), (4, 2)], [(1, 1), (1, 3), (3, 1), (3, 3)]),
    ],
)
def test_two_dimensional_goldens(spark, style, corners, centre_ring):
    grid = grids.lattice(2, style)
    state = wk.walk(start(spark, grid, PLANE), Rules((hadamard(2),)), 2)
    p = measure.to_ndarray(measure.joint(state), grid)
    expected = {c: 0.0625 for c in corners} | {c: 0.125 for c in centre_ring} | {(2, 2): 0.25}
    for x in range(5):
        for y in range(5):
            assert p[x, y] == pytest.approx(expected.get((x, y), 0), abs=1e-12)


@pytest.mark.parametrize(
    "factor, meeting, marginal",
    [
        (None, [0.015625, 0, 0.015625, 0, 0.390625, 0, 0.015625], [0.125, 0, 0.125, 0, 0.625, 0, 0.125]),
        (SIGN, [0.015625, 0, 0.390625, 0, 0.015625, 0, 0.015625], [0.125, 0, 0.625, 0, 0.125, 0, 0.125]),
    ],
)
def test_two_particle_goldens(spark, factor, meeting, marginal):
    grid = grids.line(3)
    one = start(spark, grid, ZERO)
    state = wk.walk(join_particles(one, one), Rules((hadamard(1),) * 2, meeting_factor=factor), 3)
    joint = measure.joint(state)
    met = {r["x"]: r["p"] for r in measure.collisions(joint, grid, 2).collect()}
    assert [met.get(x, 0) for x in range(7)] == pytest.approx(meeting, abs=1e-12)
    assert measure.to_ndarray(measure.marginal(state, 0), grid) == pytest.approx(marginal, abs=1e-12)
    summed = measure.marginal_of(joint, ["walk_id", "x1"])
    same = summed.join(measure.marginal(state, 1).withColumnRenamed("p", "q"), ["walk_id", "x1"])
    assert same.where("abs(p - q) > 1e-12").isEmpty() and same.count() == summed.count()
    measure.check_total(joint, ["walk_id"])


def test_hundred_steps(spark):
    grid = grids.line(100)
    state = wk.walk(start(spark, grid, BALANCED), Rules((hadamard(1),)), 100)
    d = measure.centered(measure.joint(state), grid)
    f = d.agg(
        F.sum("p").alias("total"),
        F.sum(F.col("x0") * F.col("p")).alias("mean"),
        F.sqrt(F.sum(F.col("x0") * F.col("x0") * F.col("p"))).alias("std"),
        F.max("p").alias("top"),
    ).first()
    assert f["total"] == pytest.approx(1) and f["mean"] == pytest.approx(0, abs=1e-9)
    assert f["std"] == pytest.approx(54.1241381529) and f["top"] == pytest.approx(0.0760989505)
    assert measure.norm(d, []).first()["norm"] == pytest.approx(0.1701087757)
    assert {r["x0"] for r in d.where(F.abs(F.col("p") - f["top"]) < 1e-12).collect()} == {-68, 68}


CASES = {
    "cycle": (Grid("cycle", (11,)), BALANCED, hadamard(1)),
    "segment": (Grid("segment", (13,)), BALANCED, hadamard(1)),
    "natural box": (Grid("natural_box", (7, 9)), PLANE, grover(4)),
    "diagonal torus": (Grid("diagonal_torus", (8, 7)), PLANE, fourier(2)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("noise", [None, RandomEdges(0.2, 5)], ids=["quiet", "noisy"])
def test_tiles_change_nothing(spark, name, noise):
    grid, coin_state, coin = CASES[name]
    state = start(spark, grid, coin_state, *[1] * grid.ndim, walks=2)
    rules = Rules((coin,), random=noise)
    by_key, by_walk, by_tile = (
        wk.walk(state, rules, 5, tiling=t, verify=t.kind == "key")
        for t in (Tiling("key"), Tiling("walk"), Tiling("tile", 3, 2))
    )
    assert distance(by_key, by_walk) < 1e-12
    assert distance(by_key, by_tile) < 1e-12
    assert by_tile.all_keys == by_key.all_keys


def test_tiles_of_two_particles(spark):
    one = start(spark, Grid("cycle", (11,)), BALANCED)
    state, rules = join_particles(one, one), Rules((hadamard(1),) * 2, meeting_factor=SIGN)
    by_key, by_tile = (wk.walk(state, rules, 4, verify=False, tiling=t) for t in (Tiling("key"), Tiling("tile", 4, 3)))
    assert distance(by_key, by_tile) < 1e-12


def test_choice_of_tiling(spark):
    def chosen(grid, particles=1):
        return choose_tiling(State(spark.range(0), grid, particles))

    assert chosen(Grid("cycle", (1000,))).kind == "walk"
    assert chosen(Grid("cycle", (10**9,))) == Tiling("tile", 32768, 10)
    assert chosen(Grid("natural_torus", (10**5, 10**5))).kind == "tile"
    assert chosen(grids.lattice(7), 2).kind == "key"


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("kind, shape", [("line", (5,)), ("segment", (6,)), ("natural_torus", (4, 3)), ("diagonal_box", (3, 4))])
def test_operator_tables_do_a_step(spark, order, kind, shape):
    """The walk's own step equals multiplying the flat state by the evolution operator."""
    grid = Grid(kind, shape)
    coin = hadamard(grid.ndim)
    state = start(spark, grid, BALANCED if grid.ndim == 1 else PLANE)
    n = grid.coins * grid.sites
    flat = encode(state, order).selectExpr("k AS row", "0L AS col", "re", "im")
    stepped = mx.matvec(ot.evolution_operator(spark, coin, grid, order=order), mx.MatrixTable(flat, (n, 1), "complex"))
    back = decode(stepped.df.selectExpr("0L AS walk_id", "row AS k", "re", "im"), grid, 1, order)
    assert distance(back, wk.one_step(state, Rules((coin,)))) < 1e-12


def test_lifted_operators_do_a_step_of_three_particles(spark):
    grid = Grid("cycle", (3,))
    one = start(spark, grid, BALANCED)
    state = join_particles(join_particles(one, one), one)
    rules = Rules((hadamard(1),) * 3, meeting_factor=SIGN)
    v = mx.MatrixTable(encode(state).selectExpr("k AS row", "0L AS col", "re", "im"), (6**3, 1), "complex")
    v = mx.matvec(ot.interaction_operator(spark, grid, 3, SIGN), v)
    single = ot.evolution_operator(spark, hadamard(1), grid)
    for p in range(3):
        v = mx.matvec(ot.lift(single, p, 3), v)
    back = decode(v.df.selectExpr("0L AS walk_id", "row AS k", "re", "im"), grid, 3)
    assert distance(back, wk.one_step(state, rules)) < 1e-12


def test_index_round_trip_and_overflow(spark):
    grid = Grid("natural_torus", (4, 3))
    state = join_particles(start(spark, grid, PLANE, 1, 2), start(spark, grid, PLANE, 3, 0))
    for order in ORDERS:
        flat = encode(state, order)
        assert flat.select("k").distinct().count() == 16
        assert distance(decode(flat, grid, 2, order), state) == 0
    huge = Grid("cycle", (10**9,))
    with pytest.raises(OverflowError):
        encode(State(state.df, huge, 3))
    with pytest.raises(ValueError):
        encode(state, "sideways")


def test_permanent_and_random_breaks_agree_when_all_edges_break(spark):
    grid = Grid("natural_box", (4, 3))
    state = start(spark, grid, PLANE)
    every = spark.range(grid.edges).withColumnRenamed("id", "edge")
    a = wk.walk(state, Rules((hadamard(2),), broken=every), 3)
    b = wk.walk(state, Rules((hadamard(2),), random=RandomEdges(1.0, 1)), 3)
    assert distance(a, b) < 1e-12
    assert {k[2:] for k in amplitudes(a)} == {grid.center}


def test_breaks_per_walk_and_step_match_a_drawn_table(spark):
    grid = Grid("cycle", (6,))
    state = start(spark, grid, BALANCED, walks=3)
    keys = spark.range(3).selectExpr("id AS walk_id", "explode(array(1L, 2L, 3L)) AS step")
    drawn = grids.random_edges(grid, keys, 0.5, 11)
    a = wk.walk(state, Rules((hadamard(1),), broken=drawn), 3)
    b = wk.walk(state, Rules((hadamard(1),), random=RandomEdges(0.5, 11)), 3)
    assert distance(a, b) < 1e-12


def test_errors(spark):
    grid = Grid("cycle", (5,))
    state = start(spark, grid, ZERO)
    with pytest.raises(ValueError, match="initial state"):
        wk.walk(start(spark, grid, [(0, 0.5, 0.0)]), Rules((hadamard(1),)), 1)
    with pytest.raises(ValueError, match="final state"):
        wk.walk(state, Rules((fourier(1),)), 4)
    with pytest.raises(ValueError):
        wk.walk(state, Rules((hadamard(2),)), 1)
    with pytest.raises(ValueError):
        wk.walk(state, Rules((hadamard(1),) * 2), 1)
    with pytest.raises(ValueError):
        Rules((hadamard(1),), broken=edge_set(spark, 1), random=RandomEdges(0.1, 1))
    with pytest.raises(Exception, match="out of grid boundaries"):
        start(spark, grid, ZERO, 5).df.collect()
    with pytest.raises(ValueError):
        join_particles(state, start(spark, Grid("cycle", (6,)), ZERO))
    with pytest.raises(ValueError):
        measure.marginal(state, 1)
    with pytest.raises(ValueError):
        measure.collisions(measure.joint(state), grid, 1)
    with pytest.raises(ValueError):
        measure.check_total(measure.joint(start(spark, grid, [(0, 0.5, 0.0)])), ["walk_id"])


def test_a_custom_coin(spark):
    from gridwave.sources.coins import Coin

    swap = Coin("swap", ((0j, 1 + 0j), (1 + 0j, 0j)))
    state = wk.walk(start(spark, Grid("cycle", (5,)), ZERO), Rules((swap,)), 2)
    assert amplitudes(state) == {(0, 0, 2): 1 + 0j}
    with pytest.raises(ValueError):
        Coin("ragged", ((1j,), (1j, 0j)))


def test_dense_and_average(spark):
    grid = Grid("natural_torus", (3, 4))
    d = measure.joint(wk.one_step(start(spark, grid, PLANE, walks=2), Rules((hadamard(2),))))
    walks = spark.range(3).withColumnRenamed("id", "walk_id")
    whole = measure.dense(d, walks, grid)
    assert whole.count() == 36 and whole.where("walk_id = 2 AND p <> 0").isEmpty()
    mean = measure.ensemble_average(d, ["x0", "y0"], 2)
    assert mean.join(d.where("walk_id = 0").withColumnRenamed("p", "q"), ["x0", "y0"]).where("abs(p - q) > 1e-12").isEmpty()
    assert measure.total(d.where("false"), []).first()[0] == 0.0
    with pytest.raises(ValueError):
        measure.to_ndarray(d, Grid("cycle", (10**7,)))


def test_a_transition_table_of_ones_own(spark):
    grid = Grid("segment", (6,))
    state, table = start(spark, grid, BALANCED), grids.transition(spark, grid)
    a = wk.walk(state, Rules((hadamard(1),), transition=table), 3)
    assert distance(a, wk.walk(state, Rules((hadamard(1),)), 3)) < 1e-12
    with pytest.raises(ValueError, match="permutation"):
        wk.walk(state, Rules((hadamard(1),), transition=table.where("src_x > 0")), 1)
    with pytest.raises(ValueError):
        Rules((hadamard(1),), transition=table, random=RandomEdges(0.1, 1))
    assert choose_tiling(State(state.df, Grid("cycle", (10**9,)), 1), local_moves=False).kind == "key"


def test_an_interaction_of_ones_own(spark):
    one = start(spark, grids.line(2), ZERO)
    state = join_particles(one, one)
    own = Rules((hadamard(1),) * 2, interaction=lambda s: wk.apply_interaction(s, SIGN))
    a = wk.walk(state, own, 2)
    assert distance(a, wk.walk(state, Rules((hadamard(1),) * 2, meeting_factor=SIGN), 2)) < 1e-12


def test_coin_states_from_a_table(spark):
    starts = spark.range(2).selectExpr("id AS walk_id", "id + 1 AS x")
    coins = spark.sql("SELECT * FROM VALUES (0L, 1, 1.0D, 0.0D), (1L, 0, 0.6D, 0.0D), (1L, 1, 0.0D, 0.8D) AS t(walk_id, coin, re, im)")
    state = initial_state(starts, Grid("cycle", (4,)), coins)
    assert amplitudes(state) == {(0, 1, 1): 1, (1, 0, 2): 0.6, (1, 1, 2): 0.8j}


def test_partitions_grow_with_the_walks(spark, monkeypatch):
    grid = grids.line(3)
    state = start(spark, grid, BALANCED, walks=40)
    monkeypatch.setattr(wk, "TASK_ROWS", 20)
    assert wk.rows_reached(state, 3) == 14 and wk.rows_reached(state, 1) == 6
    tiled = []
    spread = wk.spread
    monkeypatch.setattr(wk, "spread", lambda s, t, n, p: tiled.append(p) or spread(s, t, n, p))
    wk.walk(state, Rules((hadamard(1),)), 3)
    assert tiled == [28]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("kind, shape", [("line", (5,)), ("segment", (6,)), ("natural_torus", (4, 3)), ("diagonal_box", (3, 4))])
def test_applied_operators_equal_their_tables(spark, order, kind, shape):
    """Also on cells that are zero or null, and on rows that no column meets."""
    grid = Grid(kind, shape)
    coin = fourier(grid.ndim)
    n = grid.coins * grid.sites

    def vector(size):
        df = spark.range(size + 2).selectExpr(
            "nullif(id - 1, 1L) AS row", "0L AS col", "nullif(double(id % 4), 3D) AS re", "if(id % 4 = 0, 0D, double(id % 5)) AS im"
        )
        return mx.MatrixTable(df, (size, 1), "complex")

    def cells(m):
        return {(r["row"], r["col"]): (round(r["re"], 9), round(r["im"], 9)) for r in m.df.collect() if r["re"] is not None}

    v = vector(n)
    assert cells(ot.apply_coin(v, coin, grid, order)) == cells(mx.matvec(ot.coin_operator(spark, coin, grid, order), v))
    assert cells(ot.apply_evolution(v, coin, grid, order)) == cells(mx.matvec(ot.evolution_operator(spark, coin, grid, order=order), v))
    v = vector(n * n)
    assert cells(ot.apply_interaction(v, grid, 2, SIGN, order)) == cells(mx.matvec(ot.interaction_operator(spark, grid, 2, SIGN, order), v))


def test_operators_applied_on_a_huge_grid(spark):
    """No table of the grid's size is made: these have 4 * 10**12 states, or 10**18 pairs of them."""
    plane, ring = Grid("diagonal_torus", (10**6, 10**6)), Grid("cycle", (5 * 10**8,))

    def vector(size):
        return mx.MatrixTable(spark.sql("SELECT 7L AS row, 0L AS col, 2D AS re, 0D AS im"), (size, 1), "complex")

    for applied in (ot.apply_coin, ot.apply_evolution):
        assert applied(vector(4 * 10**12), hadamard(2), plane).df.selectExpr("count(*)", "round(sum(re * re), 9)").first() == (4, 4.0)
    assert ot.apply_interaction(vector(10**18), ring, 2, SIGN).df.first()[:3] == (7, 0, 2.0)


def test_queries_make_no_table_of_the_grid(spark, folder):
    """The operators' columns come from the facts, not from a range over all states."""
    for name in ("w_coin_operator", "w_evolution_operator", "w_interaction_operator"):
        plan = all_queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "Range (" not in plan, name
