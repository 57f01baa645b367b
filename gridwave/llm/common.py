"""What the operators share: reading, Arrow maps over texts, lineage."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from gridwave.session import cut_lineage, keep_table, shared_folder, ship_package  # noqa: F401

# Rows handed to Python at a time; a batch is also cut where its texts pass BATCH_BYTES.
BATCH_ROWS = 512
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most so many rows and about so many bytes of the column."""
    for batch in batches:
        start, size = 0, 0
        values = batch.column(column)
        if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
            lengths = pa.compute.multiply(pa.compute.list_value_length(values), 4)
        else:
            lengths = pa.compute.binary_length(values)
        lengths = lengths.fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or size + n > most):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def mixers(n: int, turns: int, seed: int) -> list[tuple[int, int]]:
    """``n`` pairs (bits to turn a hash by, constant to xor it with), each an order of hashes of its own.

    The smallest of ``turn(h) ^ c`` is the hash nearest to a random point; turned by other
    bits, other hashes are near each other, so the orders do not share their ties.
    """
    draw = random.Random(seed)
    return [(64 // turns * (k % turns), draw.getrandbits(64) - (1 << 63)) for k in range(n)]


def turned(column: str, bits: int) -> str:
    """SQL of a 64-bit number turned left by so many bits."""
    return f"shiftleft({column}, {bits}) | shiftrightunsigned({column}, {64 - bits})" if bits else column


def map_arrow(
    df: DataFrame, column: str, schema: str, function: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> DataFrame:
    """``function`` over bounded Arrow batches of ``df``; ``column`` is what makes rows large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            out = function(part)
            if out is not None and out.num_rows:
                yield out

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost nothing before it."""
    return cut_lineage(df)
