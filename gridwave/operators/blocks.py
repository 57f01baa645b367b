"""Large sparse products by pairs of blocks: factors move and are read again, products never move.

Shuffled by cell, a product of two sparse matrices costs disk for every single product, and
there may be far more of them than cells of the factors. Here the left factor is cut into
blocks of rows and the right one into blocks of columns, by a hash. Every pair of blocks is one
task, which forms all products of its cells and sums them where they are. A factor moves once,
to its blocks; what grows with the number of pairs is only how often a block is read.

Within a block, cells lie in packs by a hash of the inner key, so a task joins packs of the same
class one after the other and holds sums, not products. Packs are written to the checkpoint
folder, a file for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwave.session import cut_lineage, freed_shuffles, ship_package

# Products of a pair of blocks, and cells of a block, if rows and columns are alike.
PRODUCTS_PER_PAIR = 4_000_000
CELLS_PER_BLOCK = 4_000_000
# Cells of a pack, usually and at most.
CELLS_PER_PACK = 100_000
# Products formed at a time, and such as wait to be summed.
FORMED_AT_ONCE = 1_000_000
WAITING = 1_500_000
ROWS_PER_BATCH = 100_000
# Stands for a null row or column inside of a task; tables that hold it are not cut into blocks.
NO_INDEX = -(2**63)


def grid(made: float, n_left: int, n_right: int, least: int = 1) -> tuple[int, int]:
    """Blocks of rows and of columns: as many pairs as the products need, with the fewest cells read.

    Every block of rows is read once for each block of columns and the other way round.
    """
    pairs = max(-(-int(made) // PRODUCTS_PER_PAIR), least, 1)
    high = max(1, round(math.sqrt(pairs * n_left / max(n_right, 1))), -(-n_left // CELLS_PER_BLOCK))
    wide = max(1, -(-pairs // high), -(-n_right // CELLS_PER_BLOCK))
    return min(high, pairs), min(wide, pairs)


def packed(cells: DataFrame, index: str, key: str, values: list[Column], blocks: int, classes: int) -> DataFrame:
    """(block, class, cells): the cells (key, index, values) in packs, one partition and file a block.

    ``cells`` of a pack are compressed Arrow columns in order of the key.
    """
    keyed = cells.select(
        F.pmod(F.xxhash64(index), F.lit(blocks)).cast("int").alias("_block"),
        F.pmod(F.xxhash64(key), F.lit(classes)).cast("int").alias("_class"),
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(index).cast("long"), F.lit(NO_INDEX)).alias("index"),
        *values,
    )
    # One number to sort by, whose prefix is all of it.
    place = (F.col("_block").cast("long") * classes + F.col("_class")).alias("_place")
    placed = keyed.select("_block", place, *keyed.columns[2:]).repartitionById(blocks, F.col("_block")).drop("_block")
    most = 2 * CELLS_PER_PACK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, part in _runs(batches, most):
            yield pa.RecordBatch.from_pydict(
                {"_block": pa.array([place // classes], pa.int32()), "_class": pa.array([place % classes], pa.int32()), "cells": pa.array([_written(part)], pa.binary())}
            )

    ship_package(cells.sparkSession)
    with freed_shuffles(cells.sparkSession):
        return cut_lineage(placed.sortWithinPartitions("_place").mapInArrow(pack, "_block int, _class int, cells binary"))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(place, rows) for each stretch of rows of the same place, cut at ``most`` rows or a little more."""
    held, n, at = [], 0, None
    for batch in batches:
        places = batch.column("_place").to_numpy()
        rest = batch.drop_columns(["_place"])
        bounds = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(bounds, bounds[1:]):
            if stop == start:
                continue
            if held and (places[start] != at or n >= most):
                yield at, _joined(held)
                held, n = [], 0
            at = int(places[start])
            held.append(rest.slice(start, stop - start))
            n += stop - start
    if held:
        yield at, _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts).combine_chunks()
    order = np.argsort(whole.column("key").to_numpy(), kind="stable")
    return whole.take(pa.array(order)).combine_chunks().to_batches()[0]


def _written(part: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(part)
    return out.getvalue().to_pybytes()


def _read(pack: pa.Scalar) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(pack.as_buffer()).read_next_batch()
    return {name: column.to_numpy() for name, column in zip(batch.schema.names, batch.columns)}


def matched(a: np.ndarray, b: np.ndarray, most: int = FORMED_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of equal keys of two ordered arrays, about ``most`` pairs at a time."""
    first = np.flatnonzero(np.diff(b, prepend=b[:1] - 1) != 0) if len(b) else np.empty(0, np.int64)
    if not len(a) or not len(first):
        return
    length = np.diff(first, append=len(b))
    at = np.minimum(np.searchsorted(b[first], a), len(first) - 1)
    met = np.flatnonzero(b[first][at] == a)
    start, times = first[at[met]], length[at[met]]
    upto = np.cumsum(times)
    done = 0
    while done < len(met):
        before = upto[done - 1] if done else 0
        stop = max(int(np.searchsorted(upto, before + most, side="right")), done + 1)
        n, ends = times[done:stop], upto[done:stop] - before
        within = np.arange(ends[-1]) - np.repeat(ends - n, n)
        yield np.repeat(met[done:stop], n), np.repeat(start[done:stop], n) + within
        done = stop


def summed(rows: np.ndarray, cols: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The same cells, each once."""
    if not len(rows):
        return rows, cols, values
    low, wide = int(cols.min()), int(cols.max()) - int(cols.min()) + 1
    top, high = int(rows.min()), int(rows.max()) - int(rows.min()) + 1
    if wide * high < 2**63:
        cell = (rows - top) * wide
        cell += cols - low
        order = np.argsort(cell)
        cell = cell[order]
        new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    else:  # also where a null row lies with others
        order = np.lexsort((cols, rows))
        r, c = rows[order], cols[order]
        new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1]))))
    kept = order[new]
    return rows[kept], cols[kept], [np.add.reduceat(v[order], new) for v in values]


class Cells:
    """The sums of a pair of blocks. Whole numbers that might pass 64 bits are added as Python's."""

    def __init__(self, dtype: str) -> None:
        self.dtype, self.made, self.bound = dtype, 0, 0
        self.waiting: list[tuple] = []
        self.n = self.n_summed = 0

    def add(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> None:
        whole = self.dtype == "int"
        if whole:
            self.bound = max(self.bound, math.prod(max(abs(int(x["v"].min())), abs(int(x["v"].max()))) for x in (a, b)))
        for i, j in matched(a["key"], b["key"]):
            self.made += len(i)
            if self.dtype == "complex":
                x, y, p, q = a["re"][i], a["im"][i], b["re"][j], b["im"][j]
                values = [x * p - y * q, x * q + y * p]
            elif whole and self.bound * self.made >= 2**63:
                values = [a["v"][i].astype(object) * b["v"][j]]
            else:
                values = [a["v"][i] * b["v"][j]]
            self.waiting.append((a["index"][i], b["index"][j], values))
            self.n += len(i)
            # Half as many wait as are summed, so that a sum is seldom made again.
            if self.n - self.n_summed >= max(WAITING, self.n_summed // 2):
                self.settle()

    def settle(self) -> None:
        if self.n == self.n_summed:
            return
        rows, cols = (np.concatenate([x[k] for x in self.waiting]) for k in (0, 1))
        values = [np.concatenate(x) for x in zip(*[x[2] for x in self.waiting])]
        if self.dtype == "int" and self.bound * self.made >= 2**63:
            values = [v.astype(object) for v in values]
        self.waiting.clear()
        self.waiting.append(summed(rows, cols, values))
        self.n = self.n_summed = len(self.waiting[0][0])

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The cells that are not zero."""
        self.settle()
        if not self.n:
            return
        rows, cols, values = self.waiting.pop()
        kind = pa.int64() if self.dtype == "int" else pa.float64()
        for start in range(0, len(rows), ROWS_PER_BATCH):
            part = slice(start, start + ROWS_PER_BATCH)
            r, c, v = rows[part], cols[part], [x[part] for x in values]
            kept = np.flatnonzero(np.any([x != 0 for x in v], axis=0))
            r, c, v = r[kept], c[kept], [x[kept] for x in v]
            columns = [pa.array(x, pa.int64(), mask=x == NO_INDEX) for x in (r, c)] + [pa.array(x, kind) for x in v]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "col", *names])


def block_product(left: DataFrame, right: DataFrame, names: list[str], dtype: str, made: float, n_left: int, n_right: int, least: int = 1) -> DataFrame:
    """(row, col, values) of left (row, _k, a_*) times right (_k, col, b_*), without zeros; ``made`` products.

    At least ``least`` tasks are made of it.
    """
    high, wide = grid(made, n_left, n_right, least)
    classes = max(1, -(-max(n_left // high, n_right // wide) // CELLS_PER_PACK))
    kind = "long" if dtype == "int" else "double"

    def side(df: DataFrame, index: str, prefix: str, blocks: int) -> DataFrame:
        # A product with a null part is null and adds nothing.
        for c in ["_k", *[f"{prefix}{c}" for c in names]]:
            df = df.where(F.col(c).isNotNull())
        values = [F.col(f"{prefix}{c}").cast(kind).alias(c) for c in names]
        return packed(df, index, "_k", values, blocks, classes)

    a = side(left, "row", "a_", high).withColumnsRenamed({"cells": "a_cells", "_block": "a_block", "_class": "a_class"})
    b = side(right, "col", "b_", wide).withColumnsRenamed({"cells": "b_cells", "_block": "b_block", "_class": "b_class"})
    # Each partition of one side with each of the other.
    pairs = a.hint("shuffle_replicate_nl").join(b, F.col("a_class") == F.col("b_class"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], Cells] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                columns = [batch.column(c) for c in ("a_block", "b_block", "a_cells", "b_cells")]
                for i, j, x, y in zip(*columns):
                    sums.setdefault((i.as_py(), j.as_py()), Cells(dtype)).add(_read(x), _read(y))
            while sums:
                yield from sums.popitem()[1].batches(names)

    schema = ", ".join(["row long", "col long", *[f"{c} {kind}" for c in names]])
    return pairs.select("a_block", "b_block", "a_cells", "b_cells").mapInArrow(multiply, schema)
