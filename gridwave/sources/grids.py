"""Grid graphs as tables of sites, edges and coin-driven moves.

A grid has one or two dimensions. Positions are 0-based ``x`` (and ``y``). Two numberings
exist and are kept apart: ``site = x + W*y`` (x fastest, the public one) and
``pos = x*H + y`` (y fastest, used inside flat state indices).

A move is a rule in SQL: given the names of the coin and position columns it yields expressions
for the coin and the position afterwards. Rules cost no join and no lookup table, so a walk of
any size moves inside code generation; ``transition`` writes a rule out as a table where one is wanted.

Orientation. On a plain cyclic grid coin 0 moves by +1. On a grid that can send a walker
back (reflective borders or a set of broken edges, even an empty one) coin 1 moves by +1,
and a blocked walker keeps its place and flips its coin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.functions.draws import happens
from gridwave.functions.indexing import COIN_POSITION, div, one_particle_index
from gridwave.functions.ranges import repeat_over_range

# Broken-edge sets up to this many edges (8 bytes each) are joined by broadcast.
BROADCAST_EDGES = 1_000_000

ONE_DIM = ("line", "cycle", "segment")
DIAGONAL = ("diagonal_lattice", "diagonal_torus", "diagonal_box")
NATURAL = ("natural_lattice", "natural_torus", "natural_box")


@dataclass(frozen=True)
class Grid:
    kind: str
    shape: tuple[int, ...]

    def __post_init__(self) -> None:
        if self.kind not in ONE_DIM + DIAGONAL + NATURAL:
            raise ValueError(f"unknown grid kind {self.kind!r}")
        if len(self.shape) != (1 if self.kind in ONE_DIM else 2):
            raise ValueError(f"a {self.kind} grid cannot have shape {self.shape}")
        if any(isinstance(n, bool) or not isinstance(n, int) or n <= 0 for n in self.shape):
            raise ValueError(f"invalid shape {self.shape}")
        if self.centered and any(n % 2 == 0 for n in self.shape):
            raise ValueError("a line or lattice has 2 * steps + 1 sites per dimension")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def sites(self) -> int:
        return self.shape[0] * (self.shape[1] if self.ndim == 2 else 1)

    @property
    def edges(self) -> int:
        return 2 * self.sites if self.kind in NATURAL else self.sites

    @property
    def coins(self) -> int:
        return 2**self.ndim

    @property
    def centered(self) -> bool:
        return self.kind == "line" or self.kind.endswith("lattice")

    @property
    def reflective(self) -> bool:
        return self.kind == "segment" or self.kind.endswith("box")

    @property
    def axes(self) -> tuple[str, ...]:
        return ("x", "y")[: self.ndim]

    @property
    def center(self) -> tuple[int, ...]:
        """0-based position of the centre."""
        return tuple((n - 1) // 2 for n in self.shape)

    @property
    def axis_start(self) -> tuple[int, ...]:
        """Coordinate of position 0 per dimension: negative on lines and lattices, else 0."""
        return tuple(-c if self.centered else 0 for c in self.center)

    @property
    def center_coordinate(self) -> tuple[int, ...]:
        return tuple(c + s for c, s in zip(self.center, self.axis_start))

    @property
    def center_site(self) -> int:
        return self.center[0] + (self.shape[0] * self.center[1] if self.ndim == 2 else 0)


def line(steps: int) -> Grid:
    return Grid("line", (2 * steps + 1,))


def lattice(steps: int, style: str = "diagonal") -> Grid:
    return Grid(f"{style}_lattice", (2 * steps + 1, 2 * steps + 1))


# --- positions, sites, coordinates ---------------------------------------------------------


def pos_of(grid: Grid, at: list[Column]) -> Column:
    return at[0] if grid.ndim == 1 else at[0] * F.lit(grid.shape[1]) + at[1]


def at_pos(grid: Grid, pos: Column) -> list[Column]:
    if grid.ndim == 1:
        return [pos]
    return [div(pos, grid.shape[1]), F.pmod(pos, F.lit(grid.shape[1]))]


def at_site(grid: Grid, site: Column) -> list[Column]:
    if grid.ndim == 1:
        return [site]
    return [F.pmod(site, F.lit(grid.shape[0])), div(site, grid.shape[0])]


def has_site(grid: Grid, site: Column) -> Column:
    return (site >= F.lit(0)) & (site < F.lit(grid.sites))


def has_coordinate(grid: Grid, coordinate: list[Column], dim: int | None = None) -> Column:
    """Whether coordinates (of one dimension, or all) lie on the axes of the grid."""
    dims = range(grid.ndim) if dim is None else [dim]
    inside = F.lit(True)
    for d in dims:
        low = grid.axis_start[d]
        inside = inside & coordinate[d].between(low, low + grid.shape[d] - 1)
    return inside


def to_site(grid: Grid, coordinate: list[Column], strict: bool = False) -> Column:
    """Site number of coordinates; outside the grid NULL, or an error when ``strict``."""
    zero_based = [c - F.lit(s) for c, s in zip(coordinate, grid.axis_start)]
    site = zero_based[0] if grid.ndim == 1 else zero_based[0] + F.lit(grid.shape[0]) * zero_based[1]
    return _inside(has_coordinate(grid, coordinate), site, strict, "no point of this grid")


def to_coordinate(grid: Grid, site: Column, strict: bool = False) -> list[Column]:
    """Coordinates of a site number; outside the grid NULL, or an error when ``strict``."""
    inside = has_site(grid, site)
    return [
        _inside(inside, at + F.lit(start), strict, "no site of this grid")
        for at, start in zip(at_site(grid, site), grid.axis_start)
    ]


def _inside(inside: Column, value: Column, strict: bool, message: str) -> Column:
    otherwise = F.raise_error(F.lit(message)) if strict else F.lit(None)
    return F.when(inside, value).otherwise(otherwise)


def sites(spark: SparkSession, grid: Grid) -> DataFrame:
    """(site, pos, x[, y], ax[, ay], is_center): every site with position and coordinates."""
    site = F.col("site")
    at = at_site(grid, site)
    named = [a.alias(n) for a, n in zip(at, grid.axes)]
    coordinates = [
        (a + F.lit(s)).alias(f"a{n}") for a, s, n in zip(at, grid.axis_start, grid.axes)
    ]
    return spark.range(grid.sites).withColumnRenamed("id", "site").select(
        site,
        pos_of(grid, at).alias("pos"),
        *named,
        *coordinates,
        (site == F.lit(grid.center_site)).alias("is_center"),
    )


def axis(spark: SparkSession, grid: Grid) -> DataFrame:
    """(dim, coordinate): the coordinates along each dimension."""
    parts = [
        spark.range(start, start + n).select(F.lit(d).cast("long").alias("dim"), F.col("id").alias("coordinate"))
        for d, (start, n) in enumerate(zip(grid.axis_start, grid.shape))
    ]
    return parts[0] if grid.ndim == 1 else parts[0].unionByName(parts[1])


# --- edges -----------------------------------------------------------------------------------


def edges(spark: SparkSession, grid: Grid) -> DataFrame:
    """(edge, x_a[, y_a], x_b[, y_b]): numbered edges with their two end positions.

    Border edges wrap around. A diagonal edge number stands for the cell between four
    positions and gets one row per diagonal of that cell.
    """
    e = F.col("edge")
    numbered = spark.range(grid.edges).withColumnRenamed("id", "edge")
    width = grid.shape[0]
    if grid.ndim == 1:
        return numbered.select(e, _back(e, width).alias("x_a"), e.alias("x_b"))
    height = grid.shape[1]
    if grid.kind in DIAGONAL:
        x, y = F.pmod(e, F.lit(width)), div(e, width)
        falling = numbered.select(
            e, _back(x, width).alias("x_a"), y.alias("y_a"), x.alias("x_b"), _back(y, height).alias("y_b")
        )
        rising = numbered.select(
            e, _back(x, width).alias("x_a"), _back(y, height).alias("y_a"), x.alias("x_b"), y.alias("y_b")
        )
        return rising.unionByName(falling)
    horizontal = e < F.lit(grid.sites)
    v = e - F.lit(grid.sites)
    x = F.when(horizontal, F.pmod(e, F.lit(width))).otherwise(div(v, height))
    y = F.when(horizontal, div(e, width)).otherwise(F.pmod(v, F.lit(height)))
    return numbered.select(
        e,
        F.when(horizontal, _back(x, width)).otherwise(x).alias("x_a"),
        F.when(horizontal, y).otherwise(_back(y, height)).alias("y_a"),
        x.alias("x_b"),
        y.alias("y_b"),
    )


def _back(a: Column, n: int) -> Column:
    return F.pmod(a - F.lit(1), F.lit(n))


def permanent_edges(grid: Grid, edges_df: DataFrame) -> DataFrame:
    """The distinct broken edges of ``edges_df.edge``, checked to be edges of the grid."""
    bounds = edges_df.agg(F.min("edge").alias("low"), F.max("edge").alias("high")).first()
    if bounds["low"] is None:
        raise ValueError("the set of broken edges is empty")
    if bounds["low"] < 0 or bounds["high"] >= grid.edges:
        raise ValueError(f"this grid has edges 0 to {grid.edges - 1}")
    return edges_df.select(F.col("edge").cast("long")).distinct()


def random_edges(grid: Grid, keys: DataFrame, probability: float, seed: int) -> DataFrame:
    """Every edge broken independently, drawn anew for each row of ``keys`` (walk_id, step)."""
    drawn = repeat_over_range(keys, grid.edges, "edge")
    return drawn.where(happens(probability, seed, *keys.columns, "edge"))


def broken_lookup(broken: DataFrame, grid: Grid) -> DataFrame:
    """The broken set, each edge once (per walk_id and step if it has them), marked ``_hit``.

    A plain set over a small grid has at most ``grid.edges`` rows and is broadcast on that
    ground; for a larger grid, or a set per walk, the join strategy is the planner's.
    """
    on = [c for c in broken.columns if c in ("edge", "walk_id", "step")]
    outside = F.raise_error(F.concat(F.lit("no such edge of this grid: "), F.col("edge").cast("string")))
    edge = F.when(F.col("edge").between(0, grid.edges - 1), F.col("edge").cast("long")).otherwise(outside)
    lookup = broken.select(*[edge.alias(c) if c == "edge" else c for c in on]).distinct().withColumn("_hit", F.lit(True))
    return F.broadcast(lookup) if on == ["edge"] and grid.edges <= BROADCAST_EDGES else lookup


def mark_broken(df: DataFrame, broken: DataFrame, grid: Grid) -> DataFrame:
    """``df`` with ``is_broken``: whether its ``edge`` (and walk_id, step) is in the broken set."""
    lookup = broken_lookup(broken, grid)
    on = [c for c in lookup.columns if c != "_hit"]
    return df.join(lookup, on, "left").withColumn("is_broken", F.coalesce("_hit", F.lit(False))).drop("_hit")


def broken_flags(spark: SparkSession, grid: Grid, broken: DataFrame) -> DataFrame:
    """(edge, is_broken) for every edge of the grid."""
    return mark_broken(spark.range(grid.edges).withColumnRenamed("id", "edge"), broken, grid)


# --- moves, as SQL text over the names of the coin and position columns --------------------


def _bits(grid: Grid, coin: str) -> list[str]:
    """Coin bits per dimension; in two dimensions coin = 2i + j."""
    return [coin] if grid.ndim == 1 else [f"({coin} div 2)", f"pmod({coin}, 2)"]


def _is_vertical(bits: list[str]) -> str:
    """On natural grids equal coin bits mean a move along y."""
    return f"{bits[0]} = {bits[1]}"


def edge_crossed(grid: Grid, coin: str, at: list[str]) -> str:
    """Number of the edge a walker takes when coin bit 1 means +1."""
    bits = _bits(grid, coin)
    # The edge before a position has the position's number, the edge after it the next one.
    sides = [bits[0], bits[0]] if grid.kind in NATURAL else bits
    ahead = [f"pmod({a} + {side}, {n})" for a, side, n in zip(at, sides, grid.shape)]
    if grid.ndim == 1:
        return ahead[0]
    width, height = grid.shape
    if grid.kind in DIAGONAL:
        return f"{ahead[0]} + {width} * {ahead[1]}"
    return (
        f"CASE WHEN {_is_vertical(bits)} THEN {grid.sites} + {at[0]} * {height} + {ahead[1]} "
        f"ELSE {ahead[0]} + {width} * {at[1]} END"
    )


def _deltas(grid: Grid, bits: list[str]) -> list[str]:
    """Displacement per dimension when coin bit 1 means +1."""
    steps = [f"(2 * {b} - 1)" for b in bits]
    if grid.kind not in NATURAL:
        return steps
    return [f"if({_is_vertical(bits)}, 0, {steps[0]})", f"if({_is_vertical(bits)}, {steps[0]}, 0)"]


def move(grid: Grid, coin: str, at: list[str], is_broken: str | None = None) -> tuple[str, list[str]]:
    """(coin, position) after one move; ``is_broken`` tells whether the edge taken is broken."""
    deltas = _deltas(grid, _bits(grid, coin))
    if is_broken is None and not grid.reflective:
        return coin, [f"pmod({a} - {d}, {n})" for a, d, n in zip(at, deltas, grid.shape)]
    reasons = [] if is_broken is None else [is_broken]
    if grid.reflective:
        reasons += [f"{a} + {d} NOT BETWEEN 0 AND {n - 1}" for a, d, n in zip(at, deltas, grid.shape)]
    blocked = f"({' OR '.join(reasons)})"
    return (
        f"if({blocked}, {grid.coins - 1} - {coin}, {coin})",
        [f"if({blocked}, {a}, pmod({a} + {d}, {n}))" for a, d, n in zip(at, deltas, grid.shape)],
    )


def transition(spark: SparkSession, grid: Grid, broken: DataFrame | None = None) -> DataFrame:
    """(src_coin, src_x[, src_y], dst_coin, dst_x[, dst_y]) for every coin and position."""
    k = F.col("id")
    at = at_pos(grid, div(k, grid.coins))
    table = spark.range(grid.sites * grid.coins).select(
        F.pmod(k, F.lit(grid.coins)).alias("src_coin"), *[a.alias(f"src_{n}") for a, n in zip(at, grid.axes)]
    )
    src, is_broken = [f"src_{n}" for n in grid.axes], None
    if broken is not None:
        numbered = table.selectExpr("*", f"{edge_crossed(grid, 'src_coin', src)} AS edge")
        table, is_broken = mark_broken(numbered, broken, grid), "is_broken"
    dst_coin, dst = move(grid, "src_coin", src, is_broken)
    return table.selectExpr(
        "src_coin",
        *src,
        f"CAST({dst_coin} AS BIGINT) AS dst_coin",
        *[f"CAST({d} AS BIGINT) AS dst_{n}" for d, n in zip(dst, grid.axes)],
    )


def moved(points: DataFrame, grid: Grid) -> DataFrame:
    """``points`` (coin, x[, y], more) with dst_coin, dst_x[, dst_y]: where each one's move leads on a whole grid."""
    dst_coin, dst = move(grid, "coin", list(grid.axes))
    return points.selectExpr(
        "*", f"CAST({dst_coin} AS BIGINT) AS dst_coin", *[f"CAST({d} AS BIGINT) AS dst_{n}" for d, n in zip(dst, grid.axes)]
    )


def shift_entries(transitions: DataFrame, grid: Grid, order: str = COIN_POSITION) -> DataFrame:
    """A transition table as matrix entries (row = destination, col = source, v = 1)."""

    def index(side: str) -> Column:
        at = [F.col(f"{side}_{n}") for n in grid.axes]
        return one_particle_index(F.col(f"{side}_coin"), pos_of(grid, at), grid.coins, grid.sites, order)

    return transitions.select(
        index("dst").alias("row"), index("src").alias("col"), F.lit(1).cast("long").alias("v")
    )


def validate_transition(transitions: DataFrame) -> DataFrame:
    """(n, n_src, n_dst, is_permutation) of any transition table, also a user's own."""

    def side(name: str) -> DataFrame:
        keys = [c for c in transitions.columns if c.startswith(name)]
        return transitions.select(F.lit(name).alias("side"), F.struct(*[F.col(c).alias(c[4:]) for c in keys]).alias("key"))

    per_key = side("src").unionByName(side("dst")).groupBy("side", "key").agg(F.count("*").alias("n"))
    def over(name: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == name, value)), F.lit(0).cast("long"))
    counted = per_key.agg(
        over("src", F.col("n")).alias("n"),
        over("src", F.lit(1).cast("long")).alias("n_src"),
        over("dst", F.lit(1).cast("long")).alias("n_dst"),
    )
    return counted.withColumn(
        "is_permutation", (F.col("n") == F.col("n_src")) & (F.col("n") == F.col("n_dst"))
    )
