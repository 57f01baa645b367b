"""Dense tables in tiles: one row for a square of cells, zeros made where they lie.

A tile holds its cells as an array, in order of rows. Only stored cells move, to their
tile; the tiles themselves come from a range, so a dense table of r x c cells costs a
shuffle of its stored cells and of r x c / SIDE**2 tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwave.functions.indexing import div

SIDE = 64


def scatter(entries: str, size: str, zero: str) -> str:
    """SQL of an array of ``size`` zeros with the values of ``entries``, an array of (at, v) in order of at.

    The array is put together from the stretches of zeros before each entry and after the last, once.
    """
    before = f"array_repeat({zero}, int(entry.at - if(nth = 0, -1, {entries}[nth - 1].at) - 1))"
    parts = f"transform({entries}, (entry, nth) -> concat({before}, array(entry.v)))"
    after = f"array_repeat({zero}, int({size} - 1 - if(size({entries}) = 0, -1, element_at({entries}, -1).at)))"
    return f"concat(flatten({parts}), {after})"


def tiles(cells: DataFrame, shape: tuple[int, int], values: list[str], side: int = SIDE) -> DataFrame:
    """(tile_row, tile_col, values...) of every tile of cells (row, col, values), one row a cell; each value an array.

    Tiles at the edges are cut to the shape. Cells outside of it are left out.
    """
    spark = cells.sparkSession
    types = {c: cells.schema[c].dataType.simpleString() for c in values}
    inside = (F.col("row") >= 0) & (F.col("row") < shape[0]) & (F.col("col") >= 0) & (F.col("col") < shape[1])
    high, wide = -(-shape[0] // side), -(-shape[1] // side)
    placed = cells.where(inside).select(
        (div(F.col("row"), side) * wide + div(F.col("col"), side)).alias("tile"),
        (F.pmod("row", F.lit(side)) * _width(F.col("col"), shape, side) + F.pmod("col", F.lit(side))).alias("at"),
        *values,
    )
    # At most side**2 entries a tile.
    stored = placed.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("at", *values))).alias("e"))
    every = spark.range(high * wide).withColumnRenamed("id", "tile").join(stored, "tile", "left")
    tile_row, tile_col = div(F.col("tile"), wide), F.pmod("tile", F.lit(wide))
    height = F.least(F.lit(side), F.lit(shape[0]) - tile_row * side)
    width = F.least(F.lit(side), F.lit(shape[1]) - tile_col * side)
    every = every.select(tile_row.alias("tile_row"), tile_col.alias("tile_col"), (height * width).alias("n"), "e")
    entries = {c: f"transform(coalesce(e, CAST(array() AS {every.schema['e'].dataType.simpleString()})), s -> struct(s.at AS at, s.{c} AS v))" for c in values}
    every = every.select("tile_row", "tile_col", "n", *[F.expr(q).alias(f"e_{c}") for c, q in entries.items()])
    arrays = [F.expr(scatter(f"e_{c}", "n", f"CAST(0 AS {types[c]})")).alias(c) for c in values]
    return every.select("tile_row", "tile_col", *arrays)


def _width(col: Column, shape: tuple[int, int], side: int) -> Column:
    """The width of the tile that a column lies in."""
    return F.least(F.lit(side), F.lit(shape[1]) - div(col, side) * side)


def cells_of(tiled: DataFrame, shape: tuple[int, int], values: list[str], side: int = SIDE) -> DataFrame:
    """(row, col, values) of every cell of tiles, zeros included; nothing moves."""
    first, *others = values
    open_ = tiled.select("tile_row", "tile_col", *others, F.posexplode(first).alias("_at", first))
    width = F.least(F.lit(side), F.lit(shape[1]) - F.col("tile_col") * side)
    row = F.col("tile_row") * side + div(F.col("_at").cast("long"), width)
    col = F.col("tile_col") * side + F.pmod("_at", width)
    rest = [F.get(c, F.col("_at")).alias(c) for c in others]
    return open_.select(row.alias("row"), col.alias("col"), first, *rest)
