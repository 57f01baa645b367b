"""Coin transforms of any size, on arrays and by aggregates.

The matrices have size**2 entries and are never written out: the Hadamard transform is
m rounds of butterflies, the Grover one a reflection about the mean, the Fourier one, whose
phase is a root of unity, a sum by phase class. ``spectra`` collects the facts of a group
into an array of its size first, zeros where there are none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwave.operators.tiled import scatter


def arrays(facts: DataFrame, by: list[str], index: Column, value: Column, size: int) -> DataFrame:
    """(by, x): for each group the sums of ``value`` by ``index`` (0 .. size - 1) as an array of ``size`` doubles.

    Facts are summed before they move; rows whose index or value is null or out of range are left out.
    """
    rows = facts.select(*by, index.cast("long").alias("at"), value.cast("double").alias("v"))
    rows = rows.where((F.col("at") >= 0) & (F.col("at") < size) & F.col("v").isNotNull())
    sums = rows.groupBy(*by, "at").agg(F.sum("v").alias("v"))
    # At most ``size`` entries a group.
    held = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("e"))
    return held.select(*by, F.expr(scatter("e", str(size), "0D")).alias("x"))


def hadamard(x: str, m: int) -> Column:
    """The Hadamard transform of an array of 2^m doubles, in m rounds over the array."""
    turn = "if(i & shiftleft(1, k) = 0, a[i] + a[i ^ shiftleft(1, k)], a[i ^ shiftleft(1, k)] - a[i])"
    rounds = f"aggregate(sequence(0, {m - 1}), {x}, (a, k) -> transform(sequence(0, {2**m - 1}), i -> {turn}))" if m else x
    return F.expr(f"transform({rounds}, v -> v * {1 / math.sqrt(2**m)!r}D)")


def grover(x: str) -> Column:
    """The Grover transform of an array of doubles of any size: twice the mean less each value."""
    mean = f"aggregate({x}, 0D, (s, v) -> s + v) / size({x})"
    return F.expr(f"transform(array(2 * ({mean})), t -> transform({x}, v -> t - v))[0]")


def fourier(x: str, order: int = 4) -> Column:
    """The Fourier transform of an array of doubles, phase exp(2 pi i / order): an array of (re, im).

    The entry at (i, j) is the phase to the power of i * j, so it hangs on both modulo ``order``
    alone: values are summed by class, and an element is a sum over the classes.
    """
    turn = [2 * math.pi * k / order for k in range(order)]
    # Exact where the phase is on an axis.
    cos, sin = ([round(f(t), 15) + 0.0 if order in (1, 2, 4) else f(t) for t in turn] for f in (math.cos, math.sin))
    listed = {name: "array({})".format(", ".join(f"{v!r}D" for v in part)) for name, part in (("c", cos), ("s", sin))}
    classes = f"transform(sequence(0, {order - 1}), c -> aggregate(filter({x}, (v, j) -> j % {order} = c), 0D, (t, v) -> t + v))"
    parts = {
        part: f"aggregate(sequence(0, {order - 1}), 0D, (t, c) -> t + q[c] * {listed[k]}[int(i * c % {order})]) / sqrt(double(size({x})))"
        for part, k in (("re", "c"), ("im", "s"))
    }
    per_class = f"transform(sequence(0, {order - 1}), i -> struct({parts['re']} AS re, {parts['im']} AS im))"
    spread = f"transform({x}, (v, i) -> y[i % {order}])"
    return F.expr(f"transform(array({classes}), q -> transform(array({per_class}), y -> {spread})[0])[0]")


def elements(df: DataFrame, by: list[str], y: Column, *fields: str) -> DataFrame:
    """(by, i, v) of each element of an array column, or (by, i, fields) of an array of structs."""
    open_ = df.select(*by, F.posexplode(y).alias("i", "v"))
    values = [F.col(f"v.{f}").alias(f) for f in fields] or ["v"]
    return open_.select(*by, F.col("i").cast("long").alias("i"), *values)
