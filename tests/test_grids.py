from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gridwave.functions.draws import happens
from gridwave.sources import grids
from gridwave.sources.coins import coin_table, fourier, grover, hadamard
from gridwave.sources.grids import Grid

ONE = [Grid("line", (9,)), Grid("cycle", (5,)), Grid("segment", (6,))]
TWO = [
    Grid(f"{style}_{form}", shape)
    for style in ("diagonal", "natural")
    for form, shapes in (("lattice", [(5, 7), (5, 5)]), ("torus", [(6, 4), (4, 6)]), ("box", [(6, 4), (4, 6)]))
    for shape in shapes
]


def test_coin_entries():
    r = 1 / math.sqrt(2)
    assert hadamard(1).rows == ((r, r), (r, -r))
    assert [[round(v.real * 2) for v in row] for row in hadamard(2).rows] == [
        [1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1],
    ]
    assert grover(4).rows == tuple(tuple(-0.5 if i == j else 0.5 for j in range(4)) for i in range(4))
    i = 1j
    assert [[v * 2 for v in row] for row in fourier(2).rows] == [
        [1, 1, 1, 1], [1, i, -1, -i], [1, -1, 1, -1], [1, -i, -1, i],
    ]


def test_coin_table(spark):
    rows = coin_table(spark, fourier(2)).collect()
    assert len(rows) == 16
    assert all(complex(r["re"], r["im"]) == fourier(2).rows[r["ci"]][r["cj"]] for r in rows)


@pytest.mark.parametrize("grid", ONE + TWO, ids=str)
@pytest.mark.parametrize("broken", [None, [], [1, 3]], ids=["plain", "empty", "broken"])
def test_moves_are_permutations(spark, grid, broken):
    edges = None if broken is None else spark.createDataFrame([(e,) for e in broken], "edge long")
    moves = grids.transition(spark, grid, edges)
    result = grids.validate_transition(moves).first()
    assert result["n"] == grid.sites * grid.coins and result["is_permutation"]


def test_a_table_that_is_no_permutation(spark):
    bad = spark.sql("SELECT * FROM VALUES (0L, 0L, 0L, 1L), (0L, 1L, 0L, 1L) AS t(src_coin, src_x, dst_coin, dst_x)")
    assert grids.validate_transition(bad).first() == (2, 2, 1, False)


def test_orientation(spark):
    """Coin 0 goes up on a plain grid; coin 1 does where moves can be blocked."""
    def dst(grid, broken=None):
        return {(r["src_coin"], r["src_x"]): (r["dst_coin"], r["dst_x"]) for r in grids.transition(spark, grid, broken).collect()}

    none = spark.createDataFrame([], "edge long")
    cycle = Grid("cycle", (5,))
    assert dst(cycle)[0, 4] == (0, 0) and dst(cycle)[1, 0] == (1, 4)
    assert dst(cycle, none)[1, 4] == (1, 0) and dst(cycle, none)[0, 0] == (0, 4)
    segment = dst(Grid("segment", (5,)))
    assert segment[1, 4] == (0, 4) and segment[0, 0] == (1, 0) and segment[1, 3] == (1, 4)


def test_line(spark):
    g = grids.line(10)
    assert (g.shape, g.sites, g.edges, g.center_site, g.center_coordinate, g.axis_start) == ((21,), 21, 21, 10, (0,), (-10,))
    assert Grid("segment", (10,)).center_site == 4
    with pytest.raises(ValueError):
        Grid("line", (10,))


def test_plane_figures():
    box = Grid("natural_box", (20, 10))
    assert (box.sites, box.edges, box.center, box.center_site) == (200, 400, (9, 4), 89)
    lattice = Grid("diagonal_lattice", (41, 21))
    assert (lattice.sites, lattice.edges, lattice.center, lattice.center_coordinate) == (861, 861, (20, 10), (0, 0))
    assert lattice.center_site == 430 and lattice.axis_start == (-20, -10)
    for kind, shape in (("torus", (3, 3)), ("natural_box", (3,)), ("cycle", (3, 3)), ("cycle", (0,)), ("cycle", (2.0,))):
        with pytest.raises(ValueError):
            Grid(kind, shape)


@pytest.mark.parametrize("grid", ONE + TWO, ids=str)
def test_sites_and_coordinates_agree(spark, grid):
    names = [f"a{n}" for n in grid.axes]
    sites = grids.sites(spark, grid)
    back = sites.select(
        "site",
        grids.to_site(grid, [F.col(n) for n in names]).alias("again"),
        *[c.alias(f"b{n}") for c, n in zip(grids.to_coordinate(grid, F.col("site")), grid.axes)],
        *names,
    ).collect()
    assert len(back) == grid.sites
    for r in back:
        assert r["again"] == r["site"]
        assert all(r[f"b{n}"] == r[f"a{n}"] for n in grid.axes)
    assert [r["site"] for r in sites.where("is_center").collect()] == [grid.center_site]


def test_outside_the_grid(spark):
    g = Grid("natural_torus", (4, 6))
    points = spark.sql("SELECT -1L AS site, 4L AS x, 0L AS y")
    assert points.select(grids.to_site(g, [F.col("x"), F.col("y")])).first()[0] is None
    assert points.select(grids.to_coordinate(g, F.col("site"))[0]).first()[0] is None
    for strict in (grids.to_site(g, [F.col("x"), F.col("y")], True), grids.to_coordinate(g, F.col("site"), True)[0]):
        with pytest.raises(Exception, match="no (point|site) of this grid"):
            points.select(strict).collect()


def test_edges_of_a_natural_plane(spark):
    """Horizontal edges count along x, vertical ones from W*H along y within each column."""
    ends = {r["edge"]: tuple(r)[1:] for r in grids.edges(spark, Grid("natural_torus", (5, 5))).collect()}
    assert len(ends) == 50
    assert ends[0] == (4, 0, 0, 0) and ends[1] == (0, 0, 1, 0) and ends[6] == (0, 1, 1, 1)
    assert ends[25] == (0, 4, 0, 0) and ends[26] == (0, 0, 0, 1) and ends[31] == (1, 0, 1, 1)


@pytest.mark.parametrize("grid", ONE + TWO, ids=str)
def test_a_broken_edge_blocks_exactly_its_ends(spark, grid):
    edge = 2
    broken = grids.permanent_edges(grid, spark.createDataFrame([(edge,), (edge,)], "edge long"))
    none = spark.createDataFrame([], "edge long")
    changed = grids.transition(spark, grid, broken).exceptAll(grids.transition(spark, grid, none)).collect()
    places = {tuple(r[f"src_{n}"] for n in grid.axes) for r in changed}
    ends = set()
    for r in grids.edges(spark, grid).where(F.col("edge") == edge).collect():
        ends |= {tuple(r[f"{n}_a"] for n in grid.axes), tuple(r[f"{n}_b"] for n in grid.axes)}
    assert places <= ends and (grid.reflective or places == ends)
    assert all(r["dst_coin"] == grid.coins - 1 - r["src_coin"] for r in changed)


def test_permanent_edges_are_checked(spark):
    g = Grid("cycle", (5,))
    for bad in ([5], [-1], []):
        with pytest.raises(ValueError):
            grids.permanent_edges(g, spark.createDataFrame([(e,) for e in bad], "edge long"))


def test_seeded_draws(spark):
    drawn = spark.range(9).where(happens(0.3, 7, "id")).collect()
    assert [r["id"] for r in drawn] == [3, 6]
    for p in (0, 1.5, -1):
        with pytest.raises(ValueError):
            happens(p, 7, "id")


def test_random_edges_cover_wide_grids(spark):
    """More edges than one block of the expansion, each drawn once."""
    g = Grid("cycle", (10_000,))
    walks = spark.range(2).selectExpr("id AS walk_id", "1L AS step")
    every = grids.random_edges(g, walks, 1.0, 3)
    assert every.count() == every.distinct().count() == 20_000
    share = grids.random_edges(g, walks, 0.2, 3).count() / 20_000
    assert 0.18 < share < 0.22


def test_wide_broken_sets_are_left_to_the_planner(spark, monkeypatch):
    g, broken = Grid("cycle", (64,)), spark.range(0, 64, 5).withColumnRenamed("id", "edge")
    small = grids.transition(spark, g, broken)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(grids, "BROADCAST_EDGES", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = grids.transition(spark, g, broken)
        assert "SortMergeJoin" in wide._jdf.queryExecution().executedPlan().toString()
        assert wide.exceptAll(small).isEmpty() and wide.count() == 128
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("edge", [99, -3])
def test_edges_that_are_none_are_told_where_they_are_used(spark, edge):
    ring, bad = Grid("cycle", (4,)), spark.createDataFrame([(edge,)], "edge long")
    with pytest.raises(Exception, match="no such edge"):
        grids.transition(spark, ring, bad).collect()
