"""Transforms against their matrices, tiles, Kronecker products that are not formed, marginals at once."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwave.operators import matrix as mx
from gridwave.operators import measure, tiled, transforms
from gridwave.sources import coins


def table(spark, a, dtype="float"):
    a = np.asarray(a)
    rows = [(int(i), int(j), *((a[i, j].real.item(), a[i, j].imag.item()) if dtype == "complex" else (a[i, j].item(),))) for i, j in zip(*np.nonzero(a))]
    values = "re double, im double" if dtype == "complex" else "v double" if dtype == "float" else "v long"
    return mx.from_cells(spark.createDataFrame(rows, f"row long, col long, {values}"), a.shape, dtype)


def facts(spark, size, groups=3):
    draw = random.Random(size)
    rows = [(g, j, draw.uniform(-2, 2)) for g in range(groups) for j in range(size) if draw.random() < 0.6 for _ in range(2)]
    want = np.zeros((groups, size))
    for g, j, v in rows:
        want[g, j] += v
    rows += [(0, size, 9.0), (0, -1, 9.0), (0, None, 9.0), (0, 0, None)]
    return transforms.arrays(spark.createDataFrame(rows, "g int, j int, v double"), ["g"], F.col("j"), F.col("v"), size), want


def gathered(df, n, size, *fields):
    out = np.zeros((n, size), complex)
    for r in df.collect():
        out[r.g, r.i] = complex(r.re, r.im) if fields else r.v
    return out


def matrix_of(coin):
    return np.array(coin.rows)


@pytest.mark.parametrize("m", [0, 1, 2, 6])
def test_hadamard(spark, m):
    x, want = facts(spark, 2**m)
    got = gathered(transforms.elements(x, ["g"], transforms.hadamard("x", m)), 3, 2**m)
    np.testing.assert_allclose(got, want @ matrix_of(coins.hadamard(m)).T, atol=1e-12)


@pytest.mark.parametrize("size", [1, 4, 5, 100])
def test_grover(spark, size):
    x, want = facts(spark, size)
    got = gathered(transforms.elements(x, ["g"], transforms.grover("x")), 3, size)
    np.testing.assert_allclose(got, want @ matrix_of(coins.grover(size)).T, atol=1e-12)


@pytest.mark.parametrize("m, order", [(1, 4), (2, 4), (6, 4)])
def test_fourier(spark, m, order):
    x, want = facts(spark, 2**m)
    got = gathered(transforms.elements(x, ["g"], transforms.fourier("x", order), "re", "im"), 3, 2**m, "re", "im")
    np.testing.assert_allclose(got, want @ matrix_of(coins.fourier(m)).T, atol=1e-12)


@pytest.mark.parametrize("size", [3, 8])
def test_fourier_of_any_order(spark, size):
    x, want = facts(spark, size)
    got = gathered(transforms.elements(x, ["g"], transforms.fourier("x", size), "re", "im"), 3, size, "re", "im")
    np.testing.assert_allclose(got, np.conj(np.fft.fft(want, norm="ortho")), atol=1e-12)


def test_no_facts(spark):
    empty = spark.createDataFrame([], "g int, j int, v double")
    assert transforms.arrays(empty, ["g"], F.col("j"), F.col("v"), 4).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (8, 8), (9, 17)])
@pytest.mark.parametrize("dtype", ["int", "float", "complex"])
def test_tiles(spark, shape, dtype):
    draw = np.random.default_rng(shape[1])
    a = draw.integers(-3, 4, shape) * (draw.random(shape) < 0.3)
    a = a.astype({"int": int, "float": float, "complex": complex}[dtype])
    if dtype == "complex":
        a = a + 1j * draw.integers(0, 2, shape)
    m = table(spark, a, dtype)
    cut = tiled.tiles(m.df, shape, m.values, side=4)
    assert cut.count() == -(-shape[0] // 4) * -(-shape[1] // 4)
    rows = tiled.cells_of(cut, shape, m.values, side=4).collect()
    assert len(rows) == len({(r["row"], r["col"]) for r in rows}) == a.size
    assert all((complex(r.re, r.im) if dtype == "complex" else r.v) == a[r["row"], r["col"]] for r in rows)
    whole = mx.dense(m)
    assert whole.df.schema[m.values[0]].dataType == m.df.schema[m.values[0]].dataType and whole.df.count() == a.size


def test_dense_moves_stored_cells_and_tiles_alone(spark):
    m = mx.from_cells(spark.range(10).selectExpr("id AS row", "id AS col", "1D AS v"), (1 << 20, 1 << 20), "float")
    text = mx.dense(m).df._jdf.queryExecution().executedPlan().toString()
    # The range over tiles has 2^28 rows, not 2^40, and nothing is exchanged once tiles are open.
    assert "Range (0, 268435456" in text and text.index("Generate") < text.index("Exchange")


def test_kron_apply(spark):
    draw = np.random.default_rng(3)
    for dtype in ("float", "complex"):
        a, b = (draw.integers(-2, 3, s).astype(dtype) for s in ((4, 3), (2, 5)))
        v = draw.integers(-3, 4, (15, 1)).astype(dtype)
        if dtype == "complex":
            a = a * 1j + 1
        got = mx.to_ndarray(mx.kron_apply(*(table(spark, x, dtype) for x in (a, b, v))))
        np.testing.assert_allclose(got, np.kron(a, b) @ v)
    with pytest.raises(ValueError):
        mx.kron_apply(table(spark, a, dtype), table(spark, b, dtype), table(spark, v[:14], dtype))
    same = mx.as_vector(mx.as_matrix(table(spark, v, dtype), 5))
    np.testing.assert_allclose(mx.to_ndarray(same), v)


def test_products_move_the_vector_alone(spark):
    """Four products of stored operators: no exchange above an operator, one of partial sums for each."""
    cells = spark.range(2000).selectExpr("id % 50 AS row", "id % 37 AS col", "double(id % 7) AS v").groupBy("row", "col").agg(F.sum("v").alias("v"))
    a = mx.from_cells(cells, (50, 37), "float")
    start = mx.from_cells(spark.range(37).selectExpr("id AS row", "0L AS col", "1D AS v"), (37, 1), "float")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mx.propagate([a, mx.transpose(a)], start, steps=2)
        text = out.df._jdf.queryExecution().executedPlan().toString()
        # One for the first vector, one for each of four sums.
        assert text.count("Exchange hashpartitioning") == 5 and text.count("Scan ExistingRDD") == 4
        got = mx.to_ndarray(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    d = mx.to_ndarray(a)
    np.testing.assert_allclose(got, d.T @ d @ d.T @ d @ np.ones((37, 1)))


def test_marginals(spark):
    rows = [("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 5.0), (None, 1, 0.5), ("b", 1, 1.5)]
    df = spark.createDataFrame(rows, "k string, n int, w double")
    got = {(r.k, r.n, r.grouping): r.p for r in measure.marginals(df, ["k", "n"], F.col("w"), [["k", "n"], ["n"]]).collect()}
    assert got == {("a", 1, 0): 2 / 12, ("a", 2, 0): 3 / 12, ("b", 1, 0): 6.5 / 12, (None, 1, 0): 0.5 / 12, (None, 1, 2): 9 / 12, (None, 2, 2): 3 / 12}
    with pytest.raises(ValueError):
        measure.marginals(df, ["k"], F.col("w"), [["n"]])


def test_shares_have_no_window(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 2.0), ("b", 1, -3.0), ("b", 2, -1.0)], "g string, x int, w double")
    shares = measure.weighted(df, ["g"], ["x"], F.col("w"))
    assert {(r.g, r.x): r.p for r in shares.collect()} == {(None, 1): 0.5, (None, 2): 0.5, ("b", 1): 0.75, ("b", 2): 0.25}
    assert "Window" not in shares._jdf.queryExecution().executedPlan().toString()
    assert measure.checked(shares, ["g"]).count() == 4
    with pytest.raises(Exception, match="make up one"):
        measure.checked(shares.withColumn("p", F.col("p") * 1.001), ["g"]).collect()
