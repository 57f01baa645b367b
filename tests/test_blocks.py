"""Products by pairs of blocks: the whole result, whatever the keys, without moving products."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwave.operators import blocks
from gridwave.operators import matrix as mx
from gridwave.operators.matrix import MatrixTable
from gridwave.session import shared_folder
from test_matrix import random_array, table

KINDS = ("int", "float", "complex")


def plan(m) -> str:
    return m.df._jdf.queryExecution().executedPlan().toString()


def rows(m):
    return sorted(tuple(map(str, r)) for r in m.df.collect())


@pytest.fixture
def tiny(monkeypatch):
    """Blocks of a few cells, for results of any size."""
    monkeypatch.setattr(mx, "SUMMED_PER_TASK", 10)
    monkeypatch.setattr(mx, "MOVED_PER_CELL", 0)
    monkeypatch.setattr(blocks, "PRODUCTS_PER_PAIR", 60)
    monkeypatch.setattr(blocks, "CELLS_PER_PACK", 7)


def wide(m: MatrixTable) -> MatrixTable:
    return MatrixTable(m.df, tuple(10**6 if n > 35 else n for n in m.shape), m.dtype)


@pytest.mark.parametrize("kind_a", KINDS)
@pytest.mark.parametrize("kind_b", KINDS)
def test_products_stay_where_they_are_formed(spark, tiny, kind_a, kind_b):
    a, b = random_array(21, (40, 30), kind_a), random_array(22, (30, 50), kind_b)
    product = mx.matmul(wide(table(spark, a)), wide(table(spark, b)))
    assert "Exchange" not in plan(product)
    assert product.dtype == mx.wider(kind_a, kind_b)
    assert np.array_equal(mx.to_ndarray(MatrixTable(product.df, (40, 50), product.dtype)), a @ b)
    assert product.df.groupBy("row", "col").count().where("count > 1").isEmpty()


def test_only_blocks_stay_in_the_shared_folder(spark, tiny):
    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.glob("table-*"))
    t = wide(table(spark, random_array(26, (40, 30), "int")))
    assert mx.matmul(t, mx.transpose(t)).df.count() > 0
    assert set(root.glob("table-*")) == before


def test_a_block_has_one_partition(spark, tiny):
    a = wide(table(spark, random_array(23, (40, 30), "int"))).df.withColumnRenamed("col", "_k")
    packs = blocks.packed(a, "row", "_k", [F.col("v")], 5, 3)
    where = packs.select(F.spark_partition_id().alias("p"), "_block").distinct().collect()
    assert sorted((r["p"], r["_block"]) for r in where) == [(i, i) for i in range(5)]


def test_blocks_keep_null_and_repeated_keys_and_odd_values(spark, monkeypatch, request):
    left = spark.sql(
        "SELECT IF(id % 11 = 0, NULL, id % 7) AS row, IF(id % 13 = 0, NULL, id % 5) AS col, "
        "CASE WHEN id = 17 THEN double('NaN') WHEN id = 18 THEN double('inf') WHEN id = 19 THEN NULL ELSE double(id % 4 - 1) END AS v FROM range(200)"
    )
    right = left.select(F.col("col").alias("row"), (F.col("row") - 9_000_000_000_000_000_000).alias("col"), "v")
    a, b = MatrixTable(left, (10**5, 5)), MatrixTable(right, (5, 10**5))
    moved = mx.matmul(a, b)
    assert "Exchange" in plan(moved)
    want = rows(moved)
    request.getfixturevalue("tiny")
    product = mx.matmul(a, b)
    assert "Exchange" not in plan(product)
    assert rows(product) == want and any(r[0] == "None" for r in want) and any(r[2] == "nan" for r in want)
    part_null = spark.sql("SELECT id AS row, id % 5 AS col, IF(id % 3 = 0, NULL, double(id)) AS re, IF(id % 4 = 0, NULL, 2D) AS im FROM range(60)")
    z = MatrixTable(part_null, (10**5, 5), "complex")
    in_blocks = mx.matmul(z, mx.transpose(z))
    monkeypatch.undo()
    assert "Exchange" not in plan(in_blocks)
    assert rows(in_blocks) == rows(mx.matmul(z, mx.transpose(z)))


def test_a_frequent_key_meets_in_many_tasks(spark, tiny):
    a = MatrixTable(spark.range(120).selectExpr("id AS row", "7L AS col", "id % 5 + 1 AS v"), (10**5, 9), "int")
    product = mx.matmul(a, mx.transpose(a))
    assert "Exchange" not in plan(product)
    tasks = product.df.groupBy(F.spark_partition_id()).count().collect()
    assert product.df.count() == 120 * 120 and len(tasks) > 50 and max(r["count"] for r in tasks) < 2_000
    wrong = product.df.where("v != (row % 5 + 1) * (col % 5 + 1)")
    assert wrong.isEmpty()


def test_large_whole_numbers_are_exact(spark, tiny):
    big = 3_000_000_000

    def pair(values):
        a = spark.createDataFrame([(i, k, v) for i in range(8) for k, v in enumerate(values)], "row long, col long, v long")
        b = spark.createDataFrame([(k, j, big) for k in range(len(values)) for j in range(5)], "row long, col long, v long")
        return mx.matmul(MatrixTable(a, (10**4, len(values)), "int"), MatrixTable(b, (len(values), 10**4), "int"))

    # The sums of some orders pass 64 bits, the results do not.
    exact = pair([big, big + 5, -big, -big - 1])
    assert "Exchange" not in plan(exact)
    assert {r["v"] for r in exact.df.collect()} == {4 * big} and exact.df.count() == 40
    with pytest.raises(Exception, match="(?i)large|overflow|convert|range"):
        pair([big, big, big]).df.collect()


def test_sums_settle_as_they_grow(monkeypatch):
    monkeypatch.setattr(blocks, "WAITING", 30)
    monkeypatch.setattr(blocks, "ROWS_PER_BATCH", 9)
    monkeypatch.setattr(blocks, "FORMED_AT_ONCE", 5)
    draw = np.random.default_rng(24)
    a, b = draw.integers(-2, 3, (12, 6)), draw.integers(-2, 3, (6, 9))
    sums = blocks.Cells("int")
    for k in range(6):
        (i,), (j,) = a[:, k].nonzero(), b[k].nonzero()
        if len(i) and len(j):
            key = lambda x, k=k: np.full(len(x), k)
            sums.add({"key": key(i), "index": i, "v": a[i, k]}, {"key": key(j), "index": j, "v": b[k, j]})
    found = np.zeros((12, 9), np.int64)
    parts = list(sums.batches(["v"]))
    for p in parts:
        r, c, v = (x.to_numpy() for x in p.columns)
        assert (found[r, c] == 0).all() and (v != 0).all()
        found[r, c] = v
    assert len(parts) > 3 and np.array_equal(found, a @ b)


def test_pairs_of_equal_keys():
    draw = np.random.default_rng(25)
    for n, m, most in ((0, 5, 3), (5, 0, 3), (40, 30, 1), (40, 30, 7), (40, 30, 10**6)):
        a, b = np.sort(draw.integers(0, 9, n)), np.sort(draw.integers(3, 12, m))
        found = [(x, y) for i, j in blocks.matched(a, b, most) for x, y in zip(i.tolist(), j.tolist())]
        assert sorted(found) == [(i, j) for i in range(n) for j in range(m) if a[i] == b[j]]


def test_grid_reads_few_cells():
    assert blocks.grid(1, 10, 10) == (1, 1)
    high, wide = blocks.grid(100 * blocks.PRODUCTS_PER_PAIR, 4_000, 1_000)
    assert high * wide >= 100 and (high, wide) == (20, 5)
    assert blocks.grid(10, 1_000, 1_000, least=9) == (3, 3)
    high, wide = blocks.grid(64 * blocks.PRODUCTS_PER_PAIR, 1, 10**6)
    assert high == 1 and wide == 64


def test_runs_are_cut_at_changes_of_place():
    places, keys = [0] * 5 + [2] * 7 + [3], list(range(13, 0, -1))
    batch = pa.RecordBatch.from_pydict({"_place": pa.array(places, pa.int64()), "key": pa.array(keys, pa.int64())})
    parts = list(blocks._runs(iter([batch.slice(0, 3), batch.slice(3, 0), batch.slice(3, 5), batch.slice(8)]), 4))
    assert [(at, p.num_rows) for at, p in parts] == [(0, 5), (2, 7), (3, 1)]
    assert all(p.column("key").to_pylist() == sorted(p.column("key").to_pylist()) for _, p in parts)
    assert [(at, p.num_rows) for at, p in blocks._runs(iter([batch.slice(k, 1) for k in range(13)]), 3)] == [(0, 3), (0, 2), (2, 3), (2, 3), (2, 1), (3, 1)]
