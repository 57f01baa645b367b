"""Many rows per row without wide arrays or cross joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def repeat_over_range(df: DataFrame, n: int, name: str) -> DataFrame:
    """Each row of ``df`` once per ``name`` in 0 .. n-1.

    Up to BLOCK copies come from one array. Beyond that the range is cut into blocks, the
    (row, block) pairs are spread over the cluster, and each pair expands on its own, so no
    array and no task holds all copies of a row.
    """
    if n <= BLOCK:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    blocks = -(-n // BLOCK)
    keys = [F.col(c) for c in df.columns]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    ).repartition(partitions, F.xxhash64(*keys, F.col("_block")))
    start = F.col("_block") * F.lit(BLOCK)
    stop = F.least(start + F.lit(BLOCK - 1), F.lit(n - 1).cast("long"))
    return spread.withColumn(name, F.explode(F.sequence(start, stop))).drop("_block")
