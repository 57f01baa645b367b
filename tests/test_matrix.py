from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwave.operators import matrix as mx
from gridwave.operators import skew
from gridwave.operators.matrix import MatrixTable


def table(spark, array) -> MatrixTable:
    array = np.asarray(array)
    kind = {"i": "int", "f": "float", "c": "complex"}[array.dtype.kind]
    rows = []
    for i, j in zip(*array.nonzero()):
        v = array[i, j]
        rows.append((int(i), int(j), float(v.real), float(v.imag)) if kind == "complex" else (int(i), int(j), v.item()))
    schema = {
        "int": "row long, col long, v long",
        "float": "row long, col long, v double",
        "complex": "row long, col long, re double, im double",
    }[kind]
    return MatrixTable(spark.createDataFrame(rows, schema), array.shape, kind)


def random_array(seed: int, shape, kind: str):
    rng = np.random.default_rng(seed)
    kept = rng.random(shape) < 0.4
    if kind == "complex":
        return np.where(kept, rng.integers(-4, 5, shape) + 1j * rng.integers(-4, 5, shape), 0)
    whole = np.where(kept, rng.integers(-4, 5, shape), 0)
    return whole if kind == "int" else whole * 0.5


KINDS = ("int", "float", "complex")


@pytest.mark.parametrize("kind_a", KINDS)
@pytest.mark.parametrize("kind_b", KINDS)
def test_against_numpy(spark, kind_a, kind_b):
    a, b = random_array(1, (5, 4), kind_a), random_array(2, (5, 4), kind_b)
    ta, tb = table(spark, a), table(spark, b)
    for got, want in (
        (mx.add(ta, tb), a + b),
        (mx.subtract(ta, tb), a - b),
        (mx.matmul(ta, mx.transpose(tb)), a @ b.T),
        (mx.kron(ta, tb), np.kron(a, b)),
    ):
        assert got.dtype == mx.wider(kind_a, kind_b)
        assert got.shape == want.shape
        assert np.array_equal(mx.to_ndarray(got), want)


@pytest.mark.parametrize("kind", KINDS)
def test_scalars(spark, kind):
    a = random_array(3, (4, 6), kind)
    t = table(spark, a)
    for factor in (1, 0, 3, 2.5, 2 - 1j):
        assert np.array_equal(mx.to_ndarray(mx.scale(t, factor)), a * factor)
        assert np.array_equal(mx.to_ndarray(mx.add(t, factor)), a + factor)
        assert np.array_equal(mx.to_ndarray(mx.subtract(t, factor)), a - factor)
    for divisor in (1, 4, 0.5, 1j):
        assert np.allclose(mx.to_ndarray(mx.divide(t, divisor)), a / divisor)
    with pytest.raises(ZeroDivisionError):
        mx.divide(t, 0)
    with pytest.raises(NotImplementedError):
        mx.divide(t, t)
    with pytest.raises(TypeError):
        mx.scale(t, True)


def test_division_of_whole_numbers_is_not_whole(spark):
    assert mx.divide(table(spark, np.array([[3]])), 2).df.first()["v"] == 1.5


def test_cancelled_cells_disappear(spark):
    t = table(spark, random_array(4, (5, 5), "float"))
    assert mx.subtract(t, t).df.isEmpty()
    assert mx.scale(t, 0).df.isEmpty() and mx.scale(t, 0).nelem == 0
    with_zero = MatrixTable(t.df.unionByName(spark.sql("SELECT 9L row, 9L col, 0.0D v")), (10, 10))
    assert mx.clear(with_zero).df.count() == t.df.count()


@pytest.mark.parametrize("kind", KINDS)
def test_figures(spark, kind):
    a, b = random_array(5, (6, 6), kind), random_array(6, (6, 6), kind)
    t = table(spark, a)
    r = mx.trace(t).first()
    assert (complex(*r) if kind == "complex" else r[0]) == np.trace(a)
    assert mx.norm(t).first()[0] == pytest.approx(np.linalg.norm(a))
    left, right = mx.trace(mx.matmul(t, table(spark, b))).first(), mx.trace(mx.matmul(table(spark, b), t)).first()
    assert left == right
    row, col = a[:1, :], b[:, :1]
    r = mx.dot(table(spark, row), table(spark, col)).first()
    assert (complex(*r) if kind == "complex" else r[0]) == (row @ col)[0, 0]


def test_empty_figures_are_zero(spark):
    empty = mx.zeros(spark, (3, 3))
    assert mx.trace(empty).first()[0] == 0.0
    assert mx.norm(empty).first()[0] == 0.0
    assert mx.dot(mx.zeros(spark, (1, 3)), mx.zeros(spark, (3, 1))).first()[0] == 0.0
    assert mx.describe(empty).first().asDict() == {"nelem": 0, "size": 9, "sparsity": 1.0, "in_shape": True}


def test_constructors(spark):
    assert np.array_equal(mx.to_ndarray(mx.eye(spark, 4)), np.eye(4))
    assert np.array_equal(mx.to_ndarray(mx.diagonal(spark, 3, 2j)), 2j * np.eye(3))
    assert mx.diagonal(spark, 3, 0).df.isEmpty()
    for dtype in KINDS:
        assert np.array_equal(mx.to_ndarray(mx.ones(spark, (2, 3), dtype)), np.ones((2, 3)))
        assert mx.zeros(spark, (2, 3), dtype).df.isEmpty()


def test_identity_products(spark):
    a = random_array(7, (3, 2), "float")
    t = table(spark, a)
    assert np.array_equal(mx.to_ndarray(mx.kron_identity(t, 4, "left")), np.kron(np.eye(4), a))
    assert np.array_equal(mx.to_ndarray(mx.kron_identity(t, 4, "right")), np.kron(a, np.eye(4)))
    wide = mx.kron_identity(mx.eye(spark, 2), 10_000, "right")
    assert wide.df.agg(F.count("*"), F.countDistinct("row"), F.max("row"), F.max("col")).first() == (20_000, 20_000, 19_999, 19_999)


def test_product_rules(spark):
    a, b, c, d = (random_array(s, (3, 3), "int") for s in (8, 9, 10, 11))
    ta, tb, tc, td = (table(spark, m) for m in (a, b, c, d))
    left = mx.matmul(mx.kron(ta, tb), mx.kron(tc, td))
    right = mx.kron(mx.matmul(ta, tc), mx.matmul(tb, td))
    assert np.array_equal(mx.to_ndarray(left), mx.to_ndarray(right))
    transposed = mx.matmul(mx.transpose(tb), mx.transpose(ta))
    assert np.array_equal(mx.to_ndarray(mx.transpose(mx.matmul(ta, tb))), mx.to_ndarray(transposed))


def test_kron_wants_one_small_factor(spark, monkeypatch):
    monkeypatch.setattr(mx, "BROADCAST_CELLS", 3)
    a, b = random_array(12, (4, 5), "int"), random_array(13, (3, 4), "complex")
    with pytest.raises(ValueError, match="smaller factor"):
        mx.kron(table(spark, a), table(spark, b))


def test_stored_zeros_make_no_products(spark):
    zeros = spark.range(40).selectExpr("id AS row", "0L AS col", "IF(id = 3, 2L, 0L) AS v")
    many = spark.range(40).selectExpr("0L AS row", "id AS col", "IF(id = 5, NULL, IF(id = 7, 4L, 0L)) AS v")
    a, b = MatrixTable(zeros, (40, 1), "int"), MatrixTable(many, (1, 40), "int")
    assert [tuple(r) for r in mx.matmul(a, b).df.collect()] == [(3, 7, 8)]
    left, right = spark.sql("SELECT 0L AS row, id AS col, IF(id = 0, 1L, -1L) AS v FROM range(2)"), spark.sql(
        "SELECT id AS row, 0L AS col, 1L AS v FROM range(2)"
    )
    assert mx.matmul(MatrixTable(left, (1, 2), "int"), MatrixTable(right, (2, 1), "int")).df.count() == 0


def test_repeated_cells_are_told(spark):
    twice = MatrixTable(spark.sql("SELECT 0L AS row, 0L AS col, 1L AS v FROM range(2)"), (1, 1), "int")
    with pytest.raises(Exception, match="several rows"):
        mx.unique_cells(twice).df.collect()


def skewed(spark):
    """Two matrices with a third of the cells of each on one inner key."""
    left = spark.range(600).selectExpr("id AS row", "if(id % 3 = 0, 7, id % 97) AS col", "id % 5 + 1 AS v")
    right = spark.range(300).selectExpr("if(id % 3 = 0, 7, id % 89) AS row", "id AS col", "id % 4 + 1 AS v")
    return MatrixTable(left, (600, 100), "int"), MatrixTable(right, (100, 300), "int")


def test_frequent_keys_are_found(spark, monkeypatch):
    a, b = skewed(spark)
    left = a.df.select(F.col("col").alias("k"), "row", "v")
    right = b.df.select(F.col("row").alias("k"), "col", "v")
    found = lambda n: skew.hot_keys(left, right, "k", F.col("v") != 0, F.col("v") != 0, n).collect()
    n_left, n_right = left.where("k = 7").count(), right.where("k = 7").count()
    assert n_left > 200 and n_right > 100
    assert [tuple(r) for r in found(10_000)] == [(7, -(-n_left // 100), -(-n_right // 100))]
    assert found(n_left * n_right) == []
    # A side shorter than the edge of a piece stays whole.
    assert [tuple(r) for r in found(18_000)] == [(7, 2, 1)]
    # No more keys than allowed, whatever the size of pieces.
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 3)
    assert [r["k"] for r in found(1)] == [7]


@pytest.mark.parametrize("piece_pairs", [1, 100, 5_000, 10_000_000])
def test_split_products_equal_plain_ones(spark, piece_pairs):
    a, b = skewed(spark)
    split = mx.matmul(a, b, piece_pairs=piece_pairs)
    plain = mx.matmul(a, b, split_hot=False)
    assert split.df.count() == plain.df.count() > 0
    assert split.df.exceptAll(plain.df).isEmpty()


def test_frequent_key_is_spread_over_tasks(spark):
    """The rows of the hot key meet in many join groups, none of them holding all."""
    a, b = skewed(spark)
    joined = skew.split_join(
        a.df.select("row", F.col("col").alias("k"), F.col("v").alias("a")),
        b.df.select(F.col("row").alias("k"), "col", F.col("v").alias("b")),
        "k", F.col("a") != 0, F.col("b") != 0, ["row"], ["col"], piece_pairs=400,
    )
    n_left, n_right = (m.df.where(f"{k} = 7").count() for m, k in ((a, "col"), (b, "row")))
    hot = joined.where("k = 7")
    assert hot.count() == n_left * n_right
    pieces = hot.groupBy(F.pmod(F.xxhash64("row"), F.lit(11)), F.pmod(F.xxhash64("col"), F.lit(6))).count()
    assert pieces.count() > 30


def test_propagation(spark):
    a = random_array(14, (5, 5), "int")
    v = np.arange(1, 6).reshape(5, 1)
    got = mx.propagate([table(spark, a)], table(spark, v), steps=3, cut_every=2)
    assert np.array_equal(mx.to_ndarray(got), np.linalg.matrix_power(a, 3) @ v)


def test_layouts(spark):
    t = table(spark, np.array([[0, 2], [3, 0]]))
    assert mx.layout(t, "default").columns == ["row", "col", "v"]
    as_set = lambda df: {(r["key"], tuple(r["value"])) for r in df.collect()}
    assert as_set(mx.layout(t, "multiplier")) == {(1, (0, 2)), (0, (1, 3))}
    assert as_set(mx.layout(t, "multiplicand")) == {(0, (1, 2)), (1, (0, 3))}
    assert {(tuple(r["key"]), r["value"]["v"]) for r in mx.layout(t, "indexed").collect()} == {((0, 1), 2), ((1, 0), 3)}
    with pytest.raises(ValueError):
        mx.layout(t, "rowwise")


def test_shape_errors(spark):
    a, b = mx.ones(spark, (2, 3)), mx.ones(spark, (2, 2))
    for f in (mx.add, mx.subtract, mx.dot):
        with pytest.raises(ValueError):
            f(a, b)
    with pytest.raises(ValueError):
        mx.matmul(a, b)
    with pytest.raises(TypeError):
        mx.trace(a)
    for shape in ((0, 2), (2,), (2, -1), (2.0, 2), (True, 2)):
        with pytest.raises(ValueError):
            mx.zeros(spark, shape)
    with pytest.raises(ValueError):
        mx.to_ndarray(mx.ones(spark, (2000, 2000)))


def test_types():
    order = ("int", "float", "complex")
    for i, a in enumerate(order):
        for j, b in enumerate(order):
            assert mx.wider(a, b) == order[max(i, j)]
    for value in (True, "a", None, [1]):
        with pytest.raises(TypeError):
            mx.scalar_dtype(value)


def test_unit_norm(spark):
    assert mx.has_unit_norm(table(spark, np.array([[0.6], [0.8]]))).first()["is_unit"]
    assert not mx.has_unit_norm(table(spark, np.array([[0.6], [0.7]]))).first()["is_unit"]


def test_many_products_of_a_sparse_result_are_spread_by_number(spark, monkeypatch):
    """No partial sums where they cannot shrink anything; the same sums, zeros, nulls and hot keys included."""
    cells = spark.range(400).selectExpr("id div 8 AS row", "pmod(id * 7, 40) AS col", "nullif(double(id % 5), 3D) AS v")
    hot = spark.range(60).selectExpr("id AS row", "39L AS col", "1D AS v")
    a = mx.MatrixTable(cells.unionByName(hot).groupBy("row", "col").agg(F.sum("v").alias("v")), (1000, 40))
    b = mx.transpose(a)

    def summed(m):
        return sorted((r["row"], r["col"], r["v"]) for r in m.df.collect())

    usual = mx.matmul(a, b, piece_pairs=50)
    monkeypatch.setattr(mx, "SUMMED_PER_TASK", 100)
    monkeypatch.setattr(mx, "FORMED_PER_TASK", 300)
    spread = mx.matmul(a, b, piece_pairs=50)
    plan = spread.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3
    assert "RepartitionByExpression" not in usual.df._jdf.queryExecution().optimizedPlan().toString()
    assert summed(spread) == summed(usual)
    # A shape with fewer cells than products keeps its partial sums.
    small = mx.matmul(mx.MatrixTable(a.df.where("row < 10"), (10, 40)), mx.MatrixTable(b.df.where("col < 10"), (40, 10)))
    assert "RepartitionByExpression" not in small.df._jdf.queryExecution().optimizedPlan().toString()
