"""Seeded draws that repeat on every run, task retry and engine."""

from __future__ import annotations


def uniform(seed: int, *keys: str) -> str:
    """SQL for a number in [0, 1) fixed by the seed and the key expressions.

    It is made of the first 32 bits of the MD5 of ``seed:key:key...``.
    """
    text = f"concat_ws(':', '{int(seed)}', {', '.join(keys)})"
    return f"CAST(conv(substring(md5({text}), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0D"


def happens(probability: float, seed: int, *keys: str) -> str:
    """SQL for whether a draw falls below the probability."""
    if not 0 < probability <= 1:
        raise ValueError("probability must be above 0 and at most 1")
    return f"({uniform(seed, *keys)} < {float(probability)!r}D)"
