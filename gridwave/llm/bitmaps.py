"""Bitmaps of hashes: which keys may be among many, in a broadcast of fixed size.

A bitmap never misses a key it was made of. How many others it lets pass grows with the
number of keys, its size does not, so it only ever saves work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 4096 pieces of 32768 bits: 16 MB whatever the data.
PIECES, BITS = 4096, 32768
# Bytes that a row is joined with.
_PART = 64


def place(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PIECES * BITS).cast("long"))


def bitmap(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(_piece, _map): which hashes the rows have."""
    return rows.select(place(keys).alias("_p")).groupBy(F.expr(f"_p div {BITS}").alias("_piece")).agg(
        F.bitmap_construct_agg(F.col("_p") % BITS).alias("_map")
    )


def marked(rows: DataFrame, keys: Sequence[str], bits: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: true for all rows whose keys the bitmap was made of, and for some others."""
    # A row is joined with the few bytes around its bit, not with a whole piece; bytes without any bit need not be there.
    parts = bits.select("_piece", "_map", F.explode(F.expr(f"sequence(0, {BITS // 8 // _PART - 1})")).alias("_n"))
    parts = parts.select(
        F.expr(f"_piece * {BITS // 8 // _PART} + _n").alias("_part"), F.expr(f"substring(_map, _n * {_PART} + 1, {_PART})").alias("_map")
    ).where(F.col("_map") != F.lit(bytes(_PART)))
    # As numbers, so that a bit is found without making strings for each row.
    half = "CAST(conv(hex(substring(_map, 8 * j + {} + 1, 4)), 16, 10) AS BIGINT)"
    words = f"transform(sequence(0, {_PART // 8 - 1}), j -> shiftleft({half.format(0)}, 32) | {half.format(4)})"
    parts = parts.select("_part", F.expr(words).alias("_words"))
    placed = rows.withColumn("_p", place(keys)).withColumn("_part", F.expr(f"_p div {8 * _PART}"))
    found = placed.join(F.broadcast(parts), "_part", "left")
    bit = F.expr(f"shiftright(_words[int(_p % {8 * _PART} div 64)], int(56 - _p % 64 div 8 * 8 + _p % 8)) & 1") == 1
    return found.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias("_maybe"))


def likely(rows: DataFrame, keys: Sequence[str], of: DataFrame) -> DataFrame:
    """The rows that may be among those of ``of`` by these keys: none of them is missed."""
    return marked(rows, keys, bitmap(of, keys)).where("_maybe").drop("_maybe")


def gathered(pieces: DataFrame) -> bytes:
    """Pieces (_piece, _map) as bytes on the driver, for Python tasks: bit p % 8 of byte p div 8."""
    out = bytearray(PIECES * BITS // 8)
    for r in pieces.collect():  # PIECES rows at most
        start = r["_piece"] * BITS // 8
        out[start : start + len(r["_map"])] = r["_map"]
    return bytes(out)


def local_bitmap(of: DataFrame, keys: Sequence[str]) -> bytes:
    return gathered(bitmap(of, keys))
