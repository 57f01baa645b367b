"""Joins on keys of which some may hold a large share of both sides.

A join of two matrices on their inner dimension emits, per key, every left entry with every
right entry. Keys that are frequent on both sides are far more work than their bytes suggest,
so adaptive execution does not see them. Here they are cut into pieces: the left rows of a key
fall into pieces by a hash, likewise its right rows, and each left piece meets each right piece
once. Every pair is still formed exactly once.

Which keys are cut follows from exact counts. A key is cut when it makes more pairs than
``W = max(PIECE_PAIRS, all pairs / MAX_HOT_KEYS)``. So at most MAX_HOT_KEYS keys are cut, which
bounds the table of them that is broadcast, and no group of the join makes more than about W
pairs, which bounds the longest task relative to the whole job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 100_000
PIECE_PAIRS = 1_000_000


def _pairs(left: DataFrame, right: DataFrame, key: str, left_counted: Column, right_counted: Column) -> DataFrame:
    """(key, _l, _r, _pairs): the rows of either side that matter for each key, and the pairs they make."""

    def counts(df: DataFrame, counted: Column, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(counted).cast("double").alias(name))

    pairs = counts(left, left_counted, "_l").join(counts(right, right_counted, "_r"), key)
    return pairs.withColumn("_pairs", F.col("_l") * F.col("_r"))


def count_pairs(left: DataFrame, right: DataFrame, key: str, left_counted: Column, right_counted: Column) -> int:
    """The number of pairs that a join on ``key`` makes, by a job of its own."""
    pairs = _pairs(left, right, key, left_counted, right_counted)
    return int(pairs.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0))).first()[0])


def hot_keys(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_counted: Column,
    right_counted: Column,
    piece_pairs: int = PIECE_PAIRS,
) -> DataFrame:
    """(key, _pieces_left, _pieces_right) for the keys to cut.

    ``*_counted`` say which rows matter. They should refer to the value columns: then counting
    needs the same columns as the join does, and a shuffle behind a side is read by both.
    """

    pairs = _pairs(left, right, key, left_counted, right_counted)
    everything = pairs.agg(F.coalesce(F.sum("_pairs"), F.lit(0.0))).scalar()
    sized = pairs.withColumn("_w", F.greatest(F.lit(float(piece_pairs)), everything / F.lit(MAX_HOT_KEYS)))
    # Pieces are square where both sides are long; a side shorter than that stays whole.
    edge, needed = F.sqrt("_w"), F.ceil(F.col("_pairs") / F.col("_w"))
    left_short, right_short = F.col("_l") <= edge, F.col("_r") <= edge
    return sized.where(F.col("_pairs") > F.col("_w")).select(
        key,
        F.when(left_short, 1).when(right_short, needed).otherwise(F.ceil(F.col("_l") / edge)).cast("int").alias("_pieces_left"),
        F.when(right_short, 1).when(left_short, needed).otherwise(F.ceil(F.col("_r") / edge)).cast("int").alias("_pieces_right"),
    )


def split_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_counted: Column,
    right_counted: Column,
    left_spread: list[str],
    right_spread: list[str],
    piece_pairs: int = PIECE_PAIRS,
    partitions: int | None = None,
) -> DataFrame:
    """Inner equi-join on ``key`` with frequent keys cut into pieces, in so many partitions if they are given.

    ``*_spread`` name the columns whose hash picks a row's piece; they should tell the rows of
    one key apart. The hash depends on the row alone, so a retried task cuts the same way.
    """
    hot = F.broadcast(hot_keys(left, right, key, left_counted, right_counted, piece_pairs))

    def cut(df: DataFrame, spread: list[str], own: str, other: str) -> DataFrame:
        own_pieces = F.coalesce(f"_pieces_{own}", F.lit(1))
        other_pieces = F.coalesce(f"_pieces_{other}", F.lit(1))
        return (
            df.join(hot, key, "left")
            .withColumn(f"_{own}", F.pmod(F.xxhash64(*spread), own_pieces).cast("int"))
            .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), other_pieces - 1)))
            .drop("_pieces_left", "_pieces_right")
        )

    cut_left = cut(left, left_spread, "left", "right")
    cut_right = cut(right, right_spread, "right", "left")
    on = [key, "_left", "_right"]
    if partitions:
        cut_left, cut_right = cut_left.repartition(partitions, *on), cut_right.repartition(partitions, *on)
    return cut_left.join(cut_right, on).drop("_left", "_right")
