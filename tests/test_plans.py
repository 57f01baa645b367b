"""Plans: what is read, where exchanges are, and that lineage is cut in the shared folder."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from gridwave.operators import matrix as mx
from gridwave.operators import measure
from gridwave.plans import walk as wk
from gridwave.plans.tiles import Tiling
from gridwave.plans.walk import Rules
from gridwave.session import cut_lineage, ensure_checkpoint_dir
from gridwave.sources import sinks, tables
from gridwave.sources.coins import hadamard
from gridwave.sources.grids import Grid
from gridwave.sources.states import initial_state, join_particles

HALF = 1 / math.sqrt(2)
BALANCED = [(0, HALF, 0.0), (1, 0.0, HALF)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def customers(spark, folder, grid, particles=1):
    starts = tables.read(spark, folder, "customer", "c_custkey").selectExpr("c_custkey AS walk_id", "c_custkey % 5 AS x")
    state = one = initial_state(starts, grid, BALANCED)
    for _ in range(particles - 1):
        state = join_particles(state, one)
    return state


def test_small_walks_exchange_once(spark, folder):
    grid = Grid("cycle", (25,))
    state = wk.walk(customers(spark, folder, grid), Rules((hadamard(1),)), 6, verify=False)
    text = plan(measure.joint(state))
    assert text.count("Exchange") == 1 and "Python" not in text


def test_keyed_steps_exchange_once_each(spark, folder):
    grid = Grid("cycle", (25,))
    state = wk.walk(customers(spark, folder, grid), Rules((hadamard(1),)), 4, verify=False, tiling=Tiling("key"))
    assert plan(state.df).count("Exchange") == 4


def test_tiled_steps_exchange_once_per_span(spark, folder):
    grid = Grid("cycle", (10_000,))
    state = wk.walk(customers(spark, folder, grid), Rules((hadamard(1),)), 8, verify=False, tiling=Tiling("tile", 100, 4))
    assert plan(state.df).count("Exchange") == 2


def test_broken_edges_add_no_exchange_of_walks(spark, folder):
    grid = Grid("cycle", (25,))
    broken = spark.range(3).withColumnRenamed("id", "edge")
    state = wk.walk(customers(spark, folder, grid), Rules((hadamard(1),), broken=broken), 3, verify=False)
    text = plan(state.df)
    assert len(re.findall(r"Exchange hashpartitioning\(walk_id", text)) == 1
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_scans_read_only_what_they_need(spark, folder):
    text = plan(tables.part_supplier(spark, folder, (200, 10)).df)
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in text
    assert text.count("Exchange") == 1
    filtered = tables.read(spark, folder, "lineitem", "l_partkey", "l_returnflag").where("l_returnflag = 'R'")
    assert "EqualTo(l_returnflag,R)" in plan(filtered)


def test_matrix_vector_exchanges(spark, folder):
    """With nothing small enough to broadcast: one exchange to key the matrix, one to sum."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = tables.part_supplier(spark, folder, (200, 10))
        v = tables.supplier_vector(spark, folder, 10)
        text = plan(mx.matvec(t, v).df)
        assert text.count("Exchange hashpartitioning") == 4 and "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lineage_is_cut_in_the_configured_folder(spark):
    where = ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or configured.rstrip("/") in where
    df = cut_lineage(spark.range(10).withColumn("y", F.col("id") * 2))
    assert "ExistingRDD" in plan(df) and df.agg(F.sum("y")).first()[0] == 90


def test_a_long_walk_has_a_short_plan(spark, folder):
    grid = Grid("cycle", (25,))
    state = wk.walk(customers(spark, folder, grid), Rules((hadamard(1),)), 12, cut_every=5, verify=False)
    assert plan(state.df).count("Generate") == 2
    assert wk.norms(state).where("not is_unit").isEmpty()


# --- sinks -----------------------------------------------------------------------------------------


def test_lines_are_written_in_parts_and_appended(spark, tmp_path):
    m = mx.diagonal(spark, 100, 1.5)
    target = str(tmp_path / "lines")
    sinks.write_lines(sinks.matrix_lines(m, ";"), target)
    sinks.write_lines(sinks.matrix_lines(m, ";"), target, append=True)
    lines = [r["value"] for r in spark.read.text(target).collect()]
    assert len(lines) == 200 and set(lines) == {f"{i};{i};1.5" for i in range(100)}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_lines(sinks.matrix_lines(m), target)
    packed = str(tmp_path / "packed")
    sinks.write_lines(sinks.matrix_lines(m), packed, codec="gzip")
    assert spark.read.text(packed).count() == 100
    assert any(p.name.endswith(".gz") for p in (tmp_path / "packed").iterdir())


def test_complex_and_state_lines(spark):
    z = mx.diagonal(spark, 1, 1 - 2j)
    assert sinks.matrix_lines(z).first()["line"] == "0 0 (1.0-2.0j)"
    grid = Grid("line", (5,))
    starts = spark.sql("SELECT 0L AS walk_id, 2L AS x")
    two = join_particles(initial_state(starts, grid, [(1, 1.0, 0.0)]), initial_state(starts, grid, [(0, 0.0, -1.0)]))
    by = lambda f, **k: f(two, **k).first()["line"]
    assert by(sinks.state_lines_by_index, digits=2) == "72 0 (0.00-1.00j)"
    assert by(sinks.state_lines_by_index, order="position_coin", digits=2) == "54 0 (0.00-1.00j)"
    assert by(sinks.state_lines_by_coordinate, digits=1) == "1 0 0 0 (0.0-1.0j)"
    plane = Grid("diagonal_lattice", (3, 5))
    at = spark.sql("SELECT 0L AS walk_id, 2L AS x, 0L AS y")
    one = initial_state(at, plane, [(2, 1.0, 0.0)])
    assert sinks.state_lines_by_coordinate(one, digits=1).first()["line"] == "1 0 1 -2 (1.0+0.0j)"
    assert sinks.state_lines_by_coordinate(one, "position_coin", ",", 1).first()["line"] == "1,-2,1,0,(1.0+0.0j)"


def test_metrics(spark, tmp_path):
    m = mx.diagonal(spark, 4, 3.0)
    row = sinks.measured("diagonal", m.df, m.size, F.col("v") * F.col("v"))
    table = sinks.metrics_table(spark, [row])
    assert table.first()[:4] == ("diagonal", 16, 4, 6.0) and table.first()["building_seconds"] > 0
    sinks.write_metrics(table, str(tmp_path / "metrics"))
    assert spark.read.option("header", True).csv(str(tmp_path / "metrics")).first()["num_elements"] == "4"


def test_iterated_products_read_the_facts_once(spark, folder):
    from gridwave.workload.algebra import matrix_q

    q = matrix_q(spark, folder)
    start = mx.from_cells(spark.range(q.shape[1]).selectExpr("id AS row", "0L AS col", "1D AS v"), (q.shape[1], 1), "float")
    assert "FileScan" in plan(q.df)
    assert "FileScan" not in plan(mx.propagate([q, mx.transpose(q)], start, steps=6, cut_every=5).df)
