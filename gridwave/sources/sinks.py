"""Text lines, files and metric tables.

Files are written by the tasks that hold the rows. There is no single-file mode that gathers a
table in one place: ``append=True`` adds part files to the same folder instead.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridwave.functions.indexing import COIN_POSITION, check_order, div
from gridwave.operators.matrix import MatrixTable, clear
from gridwave.sources.grids import Grid
from gridwave.sources.states import State, encode, position_keys


def _number(value: Column, digits: int | None) -> Column:
    """Text of a number: as Spark prints it, or with a fixed number of decimals."""
    if digits is None:
        return value.cast("string")
    return F.format_string(f"%.{digits}f", F.round(value, digits) + F.lit(0.0))


def _complex_text(re: Column, im: Column, digits: int | None) -> Column:
    """(re+imj), the sign of the imaginary part always written."""
    sign = F.when((im < 0), F.lit("")).otherwise(F.lit("+"))
    if digits is not None:
        sign = F.when(F.round(im, digits) < 0, F.lit("")).otherwise(F.lit("+"))
    return F.concat(F.lit("("), _number(re, digits), sign, _number(im, digits), F.lit("j)"))


def matrix_lines(m: MatrixTable, glue: str = " ", digits: int | None = None) -> DataFrame:
    """(line): ``row glue col glue value`` for every non-zero cell."""
    m = clear(m)
    if m.dtype == "complex":
        value = _complex_text(F.col("re"), F.col("im"), digits)
    else:
        value = _number(F.col("v"), digits if m.dtype == "float" else None)
    return m.df.select(_line(glue, [F.col("row"), F.col("col")], value))


def _line(glue: str, keys: list[Column], value: Column) -> Column:
    return F.concat_ws(glue, *[k.cast("string") for k in keys], value).alias("line")


def state_lines_by_index(
    state: State, order: str = COIN_POSITION, glue: str = " ", digits: int | None = None
) -> DataFrame:
    """(walk_id, line): ``k glue 0 glue value`` per amplitude."""
    flat = encode(state, order).where((F.col("re") != 0) | (F.col("im") != 0))
    value = _complex_text(F.col("re"), F.col("im"), digits)
    return flat.select("walk_id", _line(glue, [F.col("k"), F.lit(0)], value))


def state_lines_by_coordinate(
    state: State, order: str = COIN_POSITION, glue: str = " ", digits: int | None = None
) -> DataFrame:
    """(walk_id, line): coin digits and coordinates of every particle, then the value.

    Coins come first in coin-position order, positions first in position-coin order.
    """
    grid, keys = state.grid, []
    for p in range(state.particles):
        coin = F.col(f"c{p}")
        bits = [coin] if grid.ndim == 1 else [div(coin, 2), F.pmod(coin, F.lit(2))]
        at = [F.col(n) + F.lit(s) for n, s in zip(position_keys(grid, p), grid.axis_start)]
        keys += bits + at if check_order(order) == COIN_POSITION else at + bits
    value = _complex_text(F.col("re"), F.col("im"), digits)
    present = state.df.where((F.col("re") != 0) | (F.col("im") != 0))
    return present.select("walk_id", _line(glue, keys, value))


def write_lines(lines: DataFrame, path: str, codec: str | None = None, append: bool = False) -> None:
    """The ``line`` column as part files of text, one line per row."""
    writer = lines.select("line").write.mode("append" if append else "errorifexists")
    if codec:
        writer = writer.option("compression", codec)
    writer.text(path)


# --- metrics ---------------------------------------------------------------------------------------


def measured(name: str, df: DataFrame, size: int, squares: Column) -> tuple[str, int, int, float, float]:
    """Run ``df`` once and note its rows, norm and time, gathered in that same pass."""
    seen = Observation(name)
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("n"), F.sqrt(F.coalesce(F.sum(squares), F.lit(0.0))).alias("norm")
    )
    started = time.monotonic()
    watched.write.format("noop").mode("overwrite").save()
    figures = seen.get
    return name, size, figures["n"], figures["norm"], time.monotonic() - started


def metrics_table(spark: SparkSession, rows: list[tuple[str, int, int, float, float]]) -> DataFrame:
    """(name, size, num_elements, norm, building_seconds), one row per measured table."""
    schema = "name string, size long, num_elements long, norm double, building_seconds double"
    return spark.createDataFrame(rows, schema)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").option("header", True).csv(path)


def state_size(grid: Grid, particles: int) -> int:
    return (grid.coins * grid.sites) ** particles
