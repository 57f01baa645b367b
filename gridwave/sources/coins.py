"""Coins: small dense complex matrices over the 2^ndim coin values.

A coin has 4 entries in one dimension and 16 in two, so it is held as numbers and folded
into projections; ``coin_table`` gives it as a DataFrame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.functions.complexnum import power


@dataclass(frozen=True)
class Coin:
    name: str
    rows: tuple[tuple[complex, ...], ...]

    def __post_init__(self) -> None:
        if not self.rows or any(len(r) != len(self.rows) for r in self.rows):
            raise ValueError("a coin is a square matrix")

    @property
    def size(self) -> int:
        return len(self.rows)


def coin(name: str, size: int, entry) -> Coin:
    """A coin of a given size whose entries come from ``entry(i, j)``."""
    return Coin(name, tuple(tuple(complex(entry(i, j)) for j in range(size)) for i in range(size)))


def hadamard(ndim: int) -> Coin:
    size = 2**ndim
    return coin("hadamard", size, lambda i, j: (-1) ** (i & j).bit_count() / math.sqrt(size))


def grover(size: int) -> Coin:
    return coin("grover", size, lambda i, j: 2 / size - (1 if i == j else 0))


def fourier(ndim: int, phase: complex = 1j) -> Coin:
    size = 2**ndim
    return coin("fourier", size, lambda i, j: power(complex(phase), i * j) / math.sqrt(size))


def entries(c: Coin) -> Column:
    """The entries as one array of (ci, cj, re, im) structs."""
    return F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("ci"),
                F.lit(j).cast("long").alias("cj"),
                F.lit(v.real).alias("re"),
                F.lit(v.imag).alias("im"),
            )
            for i, row in enumerate(c.rows)
            for j, v in enumerate(row)
        ]
    )


def coin_table(spark: SparkSession, c: Coin) -> DataFrame:
    return spark.range(1).select(F.inline(entries(c)))
