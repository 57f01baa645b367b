"""Complex numbers as pairs of DOUBLE columns.

Products of columns are built as columns. What a walk repeats in every step is built as SQL
text instead, because one text per projection is far quicker to hand to Spark than one call
per operator.
"""

from __future__ import annotations

import cmath
from collections.abc import Iterable

from pyspark.sql import Column

Pair = tuple[Column, Column]


def product(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def abs_squared(re: Column, im: Column) -> Column:
    return re * re + im * im


def number(value: float) -> str:
    """A DOUBLE literal in SQL."""
    return f"{value!r}D"


def total(terms: Iterable[str]) -> str:
    """SQL for a sum; 0 when there are no terms."""
    return " + ".join(terms) or number(0.0)


def scaled_terms(factor: complex, re: str, im: str) -> tuple[list[str], list[str]]:
    """SQL terms of the real and imaginary part of factor * (re + i im), zero terms left out."""
    a, b = factor.real, factor.imag
    real = [f"{number(a)} * {re}"] if a else []
    imag = [f"{number(a)} * {im}"] if a else []
    if b:
        real.append(f"{number(-b)} * {im}")
        imag.append(f"{number(b)} * {re}")
    return real, imag


def power(base: complex, exponent: int) -> complex:
    """base**exponent, exact when the base is one of 1, i, -1, -i."""
    turns = (1 + 0j, 1j, -1 + 0j, -1j)
    if base in turns:
        return turns[turns.index(base) * exponent % 4]
    return base**exponent


def phase_factor(phase: complex) -> complex:
    """exp(phase); pass i * angle for a rotation, i * pi for a change of sign."""
    return cmath.exp(phase)
