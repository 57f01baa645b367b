"""Sparse matrices as tables of non-zero cells.

A real matrix has columns ``row, col, v`` (BIGINT or DOUBLE), a complex one ``row, col, re,
im``. Absent cells are zero. A cell appears at most once. Nothing here collects a matrix or
runs Python per row; each operator is a projection, a join on a key, or an aggregate. Only
large sparse products are formed by pairs of blocks (see ``blocks``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwave.functions.complexnum import abs_squared, product, scaled_terms, total
from gridwave.functions.indexing import div
from gridwave.functions.ranges import repeat_over_range
from gridwave.operators import blocks
from gridwave.operators.skew import PIECE_PAIRS, count_pairs, split_join
from gridwave.operators.tiled import cells_of, tiles
from gridwave.session import freed_shuffles, keep_table, new_table_path, remove_table

ROUND_DIGITS = 10
# A Kronecker factor up to this many cells (32 bytes each) is broadcast.
BROADCAST_CELLS = 100_000
# Cells of either factor that meet in one group otherwise; a group makes at most the square.
PAIRS_PER_TASK = 100_000_000
# Dense results up to this many cells may be brought to the driver on request.
MAX_LOCAL_CELLS = 1_000_000
# Products that one task sums, and that one task forms, where a result is large and sparse.
SUMMED_PER_TASK = 2_000_000
FORMED_PER_TASK = 8_000_000
# Products for each cell of the factors up to which products move; above, the factors move instead.
MOVED_PER_CELL = 2

_ORDER = {"int": 0, "float": 1, "complex": 2}
_SQL_TYPE = {"int": "long", "float": "double"}


@dataclass(frozen=True)
class MatrixTable:
    df: DataFrame
    shape: tuple[int, int]
    dtype: str = "float"
    nelem: int | None = None

    def __post_init__(self) -> None:
        if len(self.shape) != 2 or any(
            isinstance(n, bool) or not isinstance(n, int) or n <= 0 for n in self.shape
        ):
            raise ValueError(f"invalid shape {self.shape}")
        if self.dtype not in _ORDER:
            raise ValueError(f"invalid dtype {self.dtype!r}")

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.dtype == "complex" else ["v"]

    @property
    def size(self) -> int:
        return self.shape[0] * self.shape[1]

    @property
    def is_square(self) -> bool:
        return self.shape[0] == self.shape[1]

    @property
    def is_row_vector(self) -> bool:
        return self.shape[0] == 1

    @property
    def is_column_vector(self) -> bool:
        return self.shape[1] == 1


# --- values ---------------------------------------------------------------------------------


def wider(a: str, b: str) -> str:
    """The type of a result: complex over float over int."""
    return a if _ORDER[a] >= _ORDER[b] else b


def scalar_dtype(value) -> str:
    if isinstance(value, bool) or not isinstance(value, (int, float, complex)):
        raise TypeError(f"a scalar is an int, float or complex, not {type(value).__name__}")
    return type(value).__name__


def cast_to(m: MatrixTable, dtype: str) -> MatrixTable:
    """The same matrix with values of a type at least as wide."""
    if dtype == m.dtype:
        return m
    if _ORDER[dtype] < _ORDER[m.dtype]:
        raise TypeError(f"cannot narrow {m.dtype} to {dtype}")
    if dtype == "complex":
        values = [F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")]
    else:
        values = [F.col("v").cast("double").alias("v")]
    return MatrixTable(m.df.select("row", "col", *values), m.shape, dtype, m.nelem)


def _nonzero(values: list[str]) -> Column:
    """True for a cell worth keeping: present and different from zero."""
    result = F.lit(False)
    for name in values:
        result = result | (F.col(name) != 0)
    return result


def _pair(m: MatrixTable, prefix: str = "") -> tuple[Column, Column]:
    return F.col(prefix + "re"), F.col(prefix + "im")


# --- sources --------------------------------------------------------------------------------


def from_table(df: DataFrame, row: str, col: str, shape: tuple[int, int], dtype: str, **values: Column) -> MatrixTable:
    """A matrix from facts: cells sum the facts that share (row, col).

    ``values`` is ``v=`` for a real matrix, ``re=, im=`` for a complex one. Partial sums are
    taken before the shuffle, so a cell with very many facts costs no more than any other.
    """
    if sorted(values) != (["im", "re"] if dtype == "complex" else ["v"]):
        raise ValueError("give v= for a real matrix, re= and im= for a complex one")
    cast = "double" if dtype == "complex" else _SQL_TYPE[dtype]
    keyed = df.select(
        F.col(row).cast("long").alias("row"),
        F.col(col).cast("long").alias("col"),
        *[value.cast(cast).alias(name) for name, value in values.items()],
    )
    cells = keyed.groupBy("row", "col").agg(*[F.sum(n).alias(n) for n in values])
    return MatrixTable(cells, shape, dtype)


def from_cells(df: DataFrame, shape: tuple[int, int], dtype: str, nelem: int | None = None) -> MatrixTable:
    """A matrix from a table that already has one row per cell; ``unique_cells`` checks that of a table in doubt."""
    m = MatrixTable(df, shape, dtype, nelem)
    return MatrixTable(df.select("row", "col", *m.values), shape, dtype, nelem)


def unique_cells(m: MatrixTable) -> MatrixTable:
    """The same matrix; reading it fails if a cell has several rows."""
    many = F.count("*").over(Window.partitionBy("row", "col")) > 1
    first = m.values[0]
    told = F.when(many, F.raise_error(F.lit("a cell has several rows"))).otherwise(F.col(first))
    return MatrixTable(m.df.withColumn(first, told), m.shape, m.dtype, m.nelem)


def _constant(value, dtype: str) -> list[Column]:
    if dtype == "complex":
        value = complex(value)
        return [F.lit(value.real).alias("re"), F.lit(value.imag).alias("im")]
    return [F.lit(value).cast(_SQL_TYPE[dtype]).alias("v")]


def diagonal(spark: SparkSession, size: int, value) -> MatrixTable:
    dtype = scalar_dtype(value)
    i = F.col("id")
    cells = spark.range(size).select(i.alias("row"), i.alias("col"), *_constant(value, dtype))
    if value == 0:
        return MatrixTable(cells.where(F.lit(False)), (size, size), dtype, 0)
    return MatrixTable(cells, (size, size), dtype, size)


def eye(spark: SparkSession, size: int) -> MatrixTable:
    return diagonal(spark, size, 1.0)


def zeros(spark: SparkSession, shape: tuple[int, int], dtype: str = "float") -> MatrixTable:
    cells = spark.range(0).select(F.col("id").alias("row"), F.col("id").alias("col"), *_constant(0, dtype))
    return MatrixTable(cells, shape, dtype, 0)


def ones(spark: SparkSession, shape: tuple[int, int], dtype: str = "float") -> MatrixTable:
    return filled(spark, shape, 1, dtype)


def filled(spark: SparkSession, shape: tuple[int, int], value, dtype: str) -> MatrixTable:
    """A dense matrix of one value: a single range over the cells, cut evenly by Spark."""
    m = MatrixTable(spark.range(shape[0] * shape[1]), shape, dtype, shape[0] * shape[1])
    k = F.col("id")
    row, col = div(k, shape[1]).alias("row"), F.pmod(k, F.lit(shape[1])).alias("col")
    return MatrixTable(m.df.select(row, col, *_constant(value, dtype)), shape, dtype, m.nelem)


# --- projections and filters ------------------------------------------------------------------

LAYOUTS = ("default", "multiplier", "multiplicand", "indexed")


def layout(m: MatrixTable, name: str) -> DataFrame:
    """The cells in one of four layouts; all but ``default`` are (key, value) pairs."""
    values = [F.col(c) for c in m.values]
    if name == "default":
        return m.df.select("row", "col", *values)
    if name == "multiplier":
        return m.df.select(F.col("col").alias("key"), F.struct("row", *values).alias("value"))
    if name == "multiplicand":
        return m.df.select(F.col("row").alias("key"), F.struct("col", *values).alias("value"))
    if name == "indexed":
        return m.df.select(F.struct("row", "col").alias("key"), F.struct(*values).alias("value"))
    raise ValueError(f"invalid layout {name!r}; expected one of {LAYOUTS}")


def transpose(m: MatrixTable) -> MatrixTable:
    df = m.df.select(F.col("col").alias("row"), F.col("row").alias("col"), *m.values)
    return MatrixTable(df, (m.shape[1], m.shape[0]), m.dtype, m.nelem)


def scale(m: MatrixTable, factor) -> MatrixTable:
    """factor * m; by one the matrix itself, by zero an empty one."""
    dtype = wider(m.dtype, scalar_dtype(factor))
    m = cast_to(m, dtype)
    if factor == 1:
        return m
    if factor == 0:
        return MatrixTable(m.df.where(F.lit(False)), m.shape, dtype, 0)
    if dtype == "complex":
        re, im = scaled_terms(complex(factor), "re", "im")
        df = m.df.selectExpr("row", "col", f"{total(re)} AS re", f"{total(im)} AS im")
    else:
        df = m.df.select("row", "col", (F.col("v") * F.lit(factor)).alias("v"))
    return MatrixTable(df, m.shape, dtype, m.nelem)


def divide(m: MatrixTable, divisor) -> MatrixTable:
    """m / divisor for a scalar; the result is at least float."""
    if isinstance(divisor, MatrixTable):
        raise NotImplementedError("a matrix cannot be divided by a matrix")
    dtype = wider("float", wider(m.dtype, scalar_dtype(divisor)))
    if divisor == 0:
        raise ZeroDivisionError("matrix divided by zero")
    m = cast_to(m, dtype)
    if divisor == 1:
        return m
    if dtype == "complex":
        return scale(m, 1 / complex(divisor))
    df = m.df.select("row", "col", (F.col("v") / F.lit(float(divisor))).alias("v"))
    return MatrixTable(df, m.shape, dtype, m.nelem)


def clear(m: MatrixTable) -> MatrixTable:
    """Without explicit zero and null cells."""
    return MatrixTable(m.df.where(_nonzero(m.values)), m.shape, m.dtype)


# --- sums -----------------------------------------------------------------------------------


def _same_shape(a: MatrixTable, b: MatrixTable) -> None:
    if a.shape != b.shape:
        raise ValueError(f"incompatible shapes {a.shape} and {b.shape}")


def _combine(a: MatrixTable, b: MatrixTable, sign: int) -> MatrixTable:
    """a + sign * b as one aggregate over both tables: one shuffle, no outer join."""
    _same_shape(a, b)
    dtype = wider(a.dtype, b.dtype)
    a, b = cast_to(a, dtype), cast_to(b, dtype)
    signed = b.df if sign > 0 else b.df.select("row", "col", *[(-F.col(c)).alias(c) for c in b.values])
    both = a.df.select("row", "col", *a.values).unionByName(signed)
    cells = both.groupBy("row", "col").agg(*[F.sum(c).alias(c) for c in a.values])
    return clear(MatrixTable(cells, a.shape, dtype))


def add(a: MatrixTable, b) -> MatrixTable:
    return _combine(a, b, 1) if isinstance(b, MatrixTable) else _combine_scalar(a, b, 1)


def subtract(a: MatrixTable, b) -> MatrixTable:
    return _combine(a, b, -1) if isinstance(b, MatrixTable) else _combine_scalar(a, b, -1)


def _combine_scalar(m: MatrixTable, value, sign: int) -> MatrixTable:
    """m + sign * value on every cell, so the result is dense unless value is zero."""
    dtype = wider(m.dtype, scalar_dtype(value))
    m = cast_to(m, dtype)
    if value == 0:
        return m
    whole = dense(m)
    constant = _constant(sign * value, dtype)
    cells = whole.df.select("row", "col", *[(F.col(c) + k).alias(c) for c, k in zip(m.values, constant)])
    return clear(MatrixTable(cells, m.shape, dtype))


def dense(m: MatrixTable) -> MatrixTable:
    """Every cell of the matrix, zeros included: stored cells move to their tiles, zeros are made there."""
    tiled = tiles(clear(m).df, m.shape, m.values)
    return MatrixTable(cells_of(tiled, m.shape, m.values), m.shape, m.dtype, m.size)


def to_ndarray(m: MatrixTable, max_cells: int = MAX_LOCAL_CELLS):
    """A numpy array on the driver, for matrices of at most ``max_cells`` cells."""
    import numpy as np

    if m.size > max_cells:
        raise ValueError(f"{m.size} cells exceed the limit of {max_cells} for a local array")
    result = np.zeros(m.shape, dtype={"int": np.int64, "float": np.float64, "complex": np.complex128}[m.dtype])
    for r in clear(m).df.collect():
        result[r["row"], r["col"]] = complex(r["re"], r["im"]) if m.dtype == "complex" else r["v"]
    return result


# --- products ---------------------------------------------------------------------------------


def matmul(a: MatrixTable, b: MatrixTable, piece_pairs: int = PIECE_PAIRS, split_hot: bool = True) -> MatrixTable:
    """a * b: join on the inner dimension, multiply, sum per cell.

    Inner keys that make many pairs are cut into pieces (see ``skew``); pass ``split_hot=False``
    where each inner key is known to be rare on one side. Products are partially summed before
    the shuffle by (row, col), unless they are fewer than the cells of the shape and too many for
    the usual partitions: then hardly any two in a task share a cell, and a table of partial sums
    would only fill its memory. They are counted first, for which the factors are written to the
    shared folder, and cut into tasks by their number. If they are also many for each cell of the
    factors, they do not move at all (see ``blocks``).
    """
    if a.shape[1] != b.shape[0]:
        raise ValueError(f"incompatible shapes {a.shape} and {b.shape}")
    dtype = wider(a.dtype, b.dtype)
    a, b = cast_to(a, dtype), cast_to(b, dtype)
    # Cells that are zero or null make no product: they go before keys are counted and joined.
    left = a.df.where(_nonzero(a.values)).select("row", F.col("col").alias("_k"), *[F.col(c).alias(f"a_{c}") for c in a.values])
    right = b.df.where(_nonzero(b.values)).select(F.col("row").alias("_k"), "col", *[F.col(c).alias(f"b_{c}") for c in b.values])
    if split_hot:
        counted = _nonzero([f"a_{c}" for c in a.values]), _nonzero([f"b_{c}" for c in b.values])
        spark = left.sparkSession
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        usual, cells, made = SUMMED_PER_TASK * partitions, a.shape[0] * b.shape[1], 0
        if cells > usual:
            kept = new_table_path(spark)
            left, right = keep_table(left, f"{kept}/left"), keep_table(right, f"{kept}/right")
            with freed_shuffles(spark):
                made = count_pairs(left, right, "_k", *counted)
        spread = usual < made < cells
        if spread and made > blocks.PRODUCTS_PER_PAIR:
            sizes = [df.agg(F.count("*"), F.min(c)).first() for df, c in ((left, "row"), (right, "col"))]
            indexed = all(least is None or least > blocks.NO_INDEX for _, least in sizes)
            if indexed and made > MOVED_PER_CELL * sum(n for n, _ in sizes):
                cells = blocks.block_product(left, right, a.values, dtype, made, sizes[0][0], sizes[1][0], partitions)
                remove_table(spark, kept)
                return MatrixTable(cells, (a.shape[0], b.shape[1]), dtype)
        forming = -(-made // FORMED_PER_TASK) if spread else None
        pairs = split_join(left, right, "_k", *counted, ["row"], ["col"], piece_pairs, forming)
    else:
        spread, pairs = False, left.join(right, "_k")
    made_of = product(_pair(a, "a_"), _pair(b, "b_")) if dtype == "complex" else [F.col("a_v") * F.col("b_v")]
    products = pairs.select("row", "col", *[p.alias(c) for p, c in zip(made_of, a.values)])
    if spread:
        products = products.repartition(-(-made // SUMMED_PER_TASK), "row", "col")
    cells = products.groupBy("row", "col").agg(*[F.sum(c).alias(c) for c in a.values]).where(_nonzero(a.values))
    return MatrixTable(cells, (a.shape[0], b.shape[1]), dtype)


def matvec(a: MatrixTable, v: MatrixTable) -> MatrixTable:
    """a * v for a column vector.

    The vector has at most one row per key, so the join multiplies no rows and a frequent
    column of ``a`` is a matter of bytes only, which adaptive skew joins split.
    """
    if v.shape[1] != 1:
        raise ValueError(f"a column vector has one column, not {v.shape[1]}")
    return matmul(a, v, split_hot=False)


def stored_by_column(m: MatrixTable) -> MatrixTable:
    """The matrix without zeros, written once and partitioned by its columns, so that products with vectors do not move it."""
    from gridwave.session import cut_lineage

    conf = m.df.sparkSession.conf
    partitions, adaptive = int(conf.get("spark.sql.shuffle.partitions")), "spark.sql.adaptive.enabled"
    # A plan that may still change has no partitioning that the stored rows could keep.
    before = conf.get(adaptive)
    conf.set(adaptive, "false")
    try:
        stored = cut_lineage(clear(m).df.repartition(partitions, "col"))
    finally:
        conf.set(adaptive, before)
    return MatrixTable(stored, m.shape, m.dtype)


def _times_vector(a: MatrixTable, v: MatrixTable) -> MatrixTable:
    """a * v, summed by row alone: its rows come out partitioned as a matrix stored by column needs its vector."""
    if a.shape[1] != v.shape[0]:
        raise ValueError(f"incompatible shapes {a.shape} and {v.shape}")
    dtype = wider(a.dtype, v.dtype)
    a, v = cast_to(a, dtype), cast_to(v, dtype)
    left = a.df.select("row", "col", *[F.col(c).alias(f"a_{c}") for c in a.values])
    right = v.df.where(_nonzero(v.values)).select(F.col("row").alias("col"), *[F.col(c).alias(f"b_{c}") for c in v.values])
    if dtype == "complex":
        re, im = product(_pair(a, "a_"), _pair(v, "b_"))
        sums = [F.sum(re).alias("re"), F.sum(im).alias("im")]
    else:
        sums = [F.sum(F.col("a_v") * F.col("b_v")).alias("v")]
    rows = left.join(right, "col").groupBy("row").agg(*sums).where(_nonzero(a.values))
    return MatrixTable(rows.select("row", F.lit(0).cast("long").alias("col"), *a.values), (a.shape[0], 1), dtype)


def propagate(operators: list[MatrixTable], v: MatrixTable, steps: int, cut_every: int = 10) -> MatrixTable:
    """v after ``steps`` rounds of v <- operator * v, over the operators in order, for a column vector.

    Operators that are used more than once are written to the checkpoint folder first, without
    their zeros and partitioned by column. A product then moves nothing but partial sums of the
    vector, once: they arrive as the next product needs them. The history of the vector is cut
    every ``cut_every`` products, so plans stay short on long runs.
    """
    from gridwave.session import cut_lineage

    if v.shape[1] != 1:
        raise ValueError(f"a column vector has one column, not {v.shape[1]}")
    if steps > 1:
        operators = [stored_by_column(a) for a in operators]
    done = 0
    for _ in range(steps):
        for a in operators:
            v = _times_vector(a, v) if steps > 1 else matvec(a, v)
            done += 1
            if done % cut_every == 0:
                v = MatrixTable(cut_lineage(v.df), v.shape, v.dtype)
    return v


def as_matrix(v: MatrixTable, columns: int) -> MatrixTable:
    """A column vector over pairs (i, j), index i * columns + j, as the matrix of those pairs."""
    if v.shape[1] != 1 or v.shape[0] % columns:
        raise ValueError(f"a vector of {v.shape[0]} elements has no rows of {columns}")
    df = v.df.select(div(F.col("row"), columns).alias("row"), F.pmod("row", F.lit(columns)).alias("col"), *v.values)
    return MatrixTable(df, (v.shape[0] // columns, columns), v.dtype, v.nelem)


def as_vector(m: MatrixTable) -> MatrixTable:
    """The inverse of ``as_matrix``: the cells of a matrix as one column, row by row."""
    index = (F.col("row") * m.shape[1] + F.col("col")).alias("row")
    return MatrixTable(m.df.select(index, F.lit(0).cast("long").alias("col"), *m.values), (m.size, 1), m.dtype, m.nelem)


def kron_apply(a: MatrixTable, b: MatrixTable, v: MatrixTable) -> MatrixTable:
    """(a (x) b) * v for a column vector, without the Kronecker product.

    The vector is a matrix over pairs of columns, V; the result is that of a * V * b^T. Two
    sparse products, each cut at its hot keys, take the place of as many cells as a and b have
    pairs; factors may be of any size.
    """
    if v.shape != (a.shape[1] * b.shape[1], 1):
        raise ValueError(f"incompatible shapes {a.shape}, {b.shape} and {v.shape}")
    right = matmul(as_matrix(v, b.shape[1]), transpose(b))
    return as_vector(matmul(a, right))


def kron(a: MatrixTable, b: MatrixTable) -> MatrixTable:
    """The Kronecker product: every cell of a with every cell of b, by definition.

    That is a cross join, and the result has as many cells as the product of both counts. The
    smaller factor is counted and broadcast; it may have at most BROADCAST_CELLS cells.
    """
    dtype = wider(a.dtype, b.dtype)
    a, b = cast_to(a, dtype), cast_to(b, dtype)
    n_a, n_b = count_cells(a), count_cells(b)
    left = a.df.select(F.col("row").alias("a_row"), F.col("col").alias("a_col"), *[F.col(c).alias(f"a_{c}") for c in a.values])
    right = b.df.select(F.col("row").alias("b_row"), F.col("col").alias("b_col"), *[F.col(c).alias(f"b_{c}") for c in b.values])
    if min(n_a, n_b) > BROADCAST_CELLS:
        raise ValueError(f"the smaller factor has {min(n_a, n_b)} cells, more than {BROADCAST_CELLS}")
    large, small = (left, right) if n_b <= n_a else (right, left)
    tasks = -(-n_a * n_b // PAIRS_PER_TASK)
    pairs = (large.repartition(tasks) if tasks > 1 else large).crossJoin(F.broadcast(small))
    shape = (a.shape[0] * b.shape[0], a.shape[1] * b.shape[1])
    if dtype == "complex":
        re, im = product(_pair(a, "a_"), _pair(b, "b_"))
        values = [re.alias("re"), im.alias("im")]
    else:
        values = [(F.col("a_v") * F.col("b_v")).alias("v")]
    cells = pairs.select(
        (F.col("a_row") * F.lit(b.shape[0]) + F.col("b_row")).alias("row"),
        (F.col("a_col") * F.lit(b.shape[1]) + F.col("b_col")).alias("col"),
        *values,
    )
    return MatrixTable(cells, shape, dtype, n_a * n_b)


def kron_identity(m: MatrixTable, n: int, side: str) -> MatrixTable:
    """m (x) I_n (side "right") or I_n (x) m (side "left"), without building the identity."""
    if side not in ("left", "right"):
        raise ValueError("side is 'left' or 'right'")
    t = F.col("_t")
    repeated = repeat_over_range(m.df.select("row", "col", *m.values), n, "_t")
    if side == "right":
        row, col = F.col("row") * F.lit(n) + t, F.col("col") * F.lit(n) + t
    else:
        row, col = t * F.lit(m.shape[0]) + F.col("row"), t * F.lit(m.shape[1]) + F.col("col")
    cells = repeated.select(row.alias("row"), col.alias("col"), *m.values)
    nelem = None if m.nelem is None else m.nelem * n
    return MatrixTable(cells, (m.shape[0] * n, m.shape[1] * n), m.dtype, nelem)


# --- aggregates ---------------------------------------------------------------------------------


def count_cells(m: MatrixTable) -> int:
    return m.df.count() if m.nelem is None else m.nelem


def _sums(m: MatrixTable) -> list[Column]:
    kind = "double" if m.dtype == "complex" else _SQL_TYPE[m.dtype]
    return [F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c) for c in m.values]


def trace(m: MatrixTable) -> DataFrame:
    """One row: the sum of the diagonal."""
    if not m.is_square:
        raise TypeError("the trace needs a square matrix")
    return m.df.where(F.col("row") == F.col("col")).agg(*_sums(m))


def _squared(m: MatrixTable) -> Column:
    if m.dtype == "complex":
        return abs_squared(*_pair(m))
    v = F.col("v").cast("double")
    return v * v


def norm(m: MatrixTable) -> DataFrame:
    """One row: the Frobenius norm."""
    return m.df.agg(F.sqrt(F.coalesce(F.sum(_squared(m)), F.lit(0.0))).alias("norm"))


def has_unit_norm(m: MatrixTable, digits: int = ROUND_DIGITS) -> DataFrame:
    """One row: the norm and whether it rounds to one."""
    return norm(m).select("norm", (F.round("norm", digits) == F.lit(1.0)).alias("is_unit"))


def dot(a: MatrixTable, b: MatrixTable) -> DataFrame:
    """One row: row vector times column vector, zero when they do not overlap."""
    if a.shape[0] != 1 or b.shape[1] != 1:
        raise ValueError("the dot product takes a row vector and a column vector")
    if a.shape[1] != b.shape[0]:
        raise ValueError(f"incompatible shapes {a.shape} and {b.shape}")
    return matmul(a, b, split_hot=False).df.agg(*_sums(cast_to(a, wider(a.dtype, b.dtype))))


def describe(m: MatrixTable) -> DataFrame:
    """One row: stored cells, size, sparsity, and whether the cells respect the shape."""
    inside = F.coalesce(
        (F.min("row") >= 0)
        & (F.max("row") < m.shape[0])
        & (F.min("col") >= 0)
        & (F.max("col") < m.shape[1]),
        F.lit(True),
    )
    return m.df.agg(F.count("*").alias("nelem"), inside.alias("in_shape")).select(
        "nelem",
        F.lit(m.size).cast("long").alias("size"),
        (F.lit(1.0) - F.col("nelem") / F.lit(float(m.size))).alias("sparsity"),
        "in_shape",
    )


def shape_flags(m: MatrixTable) -> DataFrame:
    """One row of shape predicates, with emptiness taken from the data."""
    return m.df.agg(F.count("*").alias("nelem")).select(
        F.lit(m.is_square).alias("is_square"),
        F.lit(m.is_row_vector).alias("is_row_vector"),
        F.lit(m.is_column_vector).alias("is_column_vector"),
        (F.col("nelem") == 0).alias("is_empty"),
    )

