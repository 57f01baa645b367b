"""Distributions of facts, and local arrays of distributions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwave.operators import measure
from gridwave.sources.grids import Grid


def test_weighted_shares(spark):
    facts = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 0, 1, 1.0), ("b", 1, 1, 5.0), ("b", 2, 2, 0.0)], "g string, x long, y long, w double")
    got = {tuple(r)[:3]: r.p for r in measure.weighted(facts, ["g"], ["x", "y"], F.col("w")).collect()}
    assert got == {("a", 0, 0): 0.25, ("a", 0, 1): 0.75, ("b", 1, 1): 1.0}
    for bad in (-1.0, float("nan")):
        with pytest.raises(Exception, match="make up one"):
            measure.weighted(facts.withColumn("w", F.when(F.col("y") == 0, bad).otherwise(F.col("w"))), ["g"], ["x", "y"], F.col("w")).collect()


def test_averages_count_the_runs_that_occur(spark):
    d = spark.createDataFrame([(3, 0, 0.5), (3, 1, 0.5), (9, 1, 1.0)], "run long, x long, p double")
    assert sorted(map(tuple, measure.average_over(d, ["x"], ["run"]).collect())) == [(0, 0.25), (1, 0.75)]
    best = sorted(map(tuple, measure.largest_at(d, ["run"], ["x"]).collect()))
    assert best == [(3, 0.5, 0), (9, 1.0, 1)]
    same = measure.co_located(d.withColumn("y", F.lit(1)), [["x"], ["y"]])
    assert {r.run for r in same.collect()} == {3, 9}


def test_local_arrays_hold_one_walk(spark):
    ring = Grid("cycle", (3,))
    d = spark.createDataFrame([(1, 0, 0.5), (1, 2, 0.5), (2, 0, 1.0)], "walk_id long, x0 long, p double")
    assert np.array_equal(measure.to_ndarray(d.where("walk_id = 1"), ring), [0.5, 0, 0.5])
    with pytest.raises(ValueError, match="one walk"):
        measure.to_ndarray(d, ring)
    with pytest.raises(ValueError, match="several rows"):
        measure.to_ndarray(d.where("walk_id = 2").unionAll(d.where("walk_id = 2")), ring)
