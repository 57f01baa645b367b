"""Near-duplicate embeddings by randomised-rotation binary codes.

A vector is scaled to length one, turned by a random rotation and kept as the signs
of its coordinates, with the correction factor ``f``: its inner product with its own
code. For another turned vector q, <q, code> / f is an unbiased estimate of the cosine;
it errs by sqrt(1 - f^2) / f * sqrt(1 - cos^2) times a coordinate of a random
direction, which has deviation 1 / sqrt(d - 1) and is never above 1. A pair whose
estimate falls short of the threshold by more than that bound (``SIGMAS`` deviations)
is out; all others are computed again exactly, in double precision, and only that
decides.

Only vectors with equal labels meet. Equal vectors are one until the end, so a vector
copied over a third of the table costs one comparison each. A label's vectors are dealt
into blocks of about ``BLOCK`` rows, and every pair of blocks is one bounded task, which
returns a number of links and one link per vector (to the smallest of its component
there), never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwave.llm.common import keep, map_arrow, ship_package
from gridwave.llm.components import components

THRESHOLD = 0.93
SIGMAS = 6.0
BLOCK = 8192
SEED = 20
_QUERIES = 256
_PAIRS = 1 << 16


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction factors of rows of one length (none zero)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotation(vectors.shape[1]).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def estimates(queries: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Estimated cosines of turned unit vectors with coded ones."""
    d = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    return (queries.astype(np.float32) @ signs.T) / (np.sqrt(d) * factors).astype(np.float32)


def slack(factors: np.ndarray, dimensions: int, threshold: float) -> np.ndarray:
    """By how much an estimate may fall short of the threshold before its pair is out."""
    share = min(1.0, SIGMAS / np.sqrt(max(1, dimensions - 1)))
    off = np.sqrt(np.maximum(0, 1 - factors**2)) / factors
    return off * np.sqrt(1 - threshold**2) * share + 1e-4


def link(
    x: np.ndarray, codes: np.ndarray, factors: np.ndarray, left: np.ndarray, right: np.ndarray, copies: np.ndarray,
    threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows ``left`` and ``right`` (the same rows: each pair once).

    Returns for every row the number of vectors it is linked with, copies counted, and
    the smallest row of its component.
    """
    same = left is right
    d = x.shape[1]
    norms = np.linalg.norm(x, axis=1)
    turned = (x[left] / norms[left, None]) @ rotation(d).T
    least = threshold - slack(factors[right], d, threshold)
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for at in range(0, len(left), _QUERIES):
        rows, cols = np.nonzero(estimates(turned[at : at + _QUERIES], codes[right], factors[right]) >= least)
        if same:
            later = cols > rows + at
            rows, cols = rows[later], cols[later]
        for k in range(0, len(rows), _PAIRS):
            a, b = left[rows[k : k + _PAIRS] + at], right[cols[k : k + _PAIRS]]
            cosine = np.einsum("ij,ij->i", x[a], x[b]) / (norms[a] * norms[b])
            a, b = a[cosine >= threshold], b[cosine >= threshold]
            links += np.bincount(a, copies[b], len(x)).astype(np.int64)
            links += np.bincount(b, copies[a], len(x)).astype(np.int64)
            _join(root, a, b)
    return links, root


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the components of a[i] and b[i]; ``root`` leads straight to the smallest row afterwards."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (up := root[root]) is not None and (up != root).any():
            root[:] = up


def valid(column: str) -> Column:
    """True for vectors that can link: not null, not empty, all components finite, not all zero."""
    return F.coalesce(
        F.expr(
            f"size({column}) > 0 AND forall({column}, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))"
            f" AND exists({column}, v -> v <> 0)"
        ),
        F.lit(False),
    )


def groups(
    vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their vectors have as many components
    and a cosine of at least ``threshold``; n_links counts the other rows so linked. Null or
    zero vectors, vectors with null or non-finite components and rows with a null label or a
    null id link with nothing: n_links 0 and the row's own id as component. Repeated rows link
    with each other. An empty table gives no rows.
    """
    can = valid("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # Positive and negative zero are one; the two hashes name a vector in 128 bits.
    plain = F.expr("transform(embedding, v -> CAST(v AS DOUBLE) + 0D)")
    name = F.concat(F.hex(F.xxhash64("label", "_v")), F.hex(F.xxhash64("_v", "label", F.lit(1))))
    rows = vectors.select("vec_id", "label", F.when(can, plain).alias("_v"))
    rows = keep(rows.select("vec_id", "label", "_v", F.when(F.col("_v").isNotNull(), name).alias("rid")))
    distinct = (
        rows.where("rid IS NOT NULL")
        .groupBy("rid", "label", "_v")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    )
    coded = keep(_coded(distinct))
    found = keep(_compared(coded, threshold, block))
    linked = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    per_vector = found.groupBy("rid").agg(F.sum("links").alias("links"))
    named = (
        coded.select("rid", "copies", "least")
        .join(per_vector, "rid", "left")
        .join(linked.withColumnRenamed("id", "rid"), "rid", "left")
        .select("rid", "least", F.expr("copies - 1 + coalesce(links, 0)").alias("n_links"), F.coalesce("component", "rid").alias("c"))
    )
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(least, "c").select("rid", "n_links", "component_id")
    out = rows.select("vec_id", "rid").join(named, "rid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _coded(distinct: DataFrame) -> DataFrame:
    """``distinct`` with the code and factor of each vector stored beside it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column("_v")
        sizes = pa.compute.list_value_length(values).to_numpy(zero_copy_only=False)
        flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        codes, factors = [b""] * len(sizes), np.zeros(len(sizes))
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            packed, factors[at] = encode(flat[(ends[at] - d)[:, None] + np.arange(d)])
            for i, row in zip(at, packed):
                codes[i] = row.tobytes()
        added = [pa.array(codes, pa.binary()), pa.array(factors)]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "code", "factor"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return map_arrow(distinct, "_v", f"{kinds}, code binary, factor double", run)


def _compared(coded: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rid, links, root) of each pair of blocks in which a vector has links."""
    kinds = coded.withColumn("size", F.size("_v"))
    counts = kinds.groupBy("label", "size").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = kinds.join(counts, ["label", "size"]).withColumn("own", F.expr("int(pmod(xxhash64(rid, 2), blocks))"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select(
        "label", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("second"), "rid", "_v", "code", "factor", "copies",
    )

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("rid")
        size, n = group["size"][0].as_py(), group.num_rows
        x = group["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, size)
        codes = np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(n, -1)
        factors, copies = group["factor"].to_numpy(), group["copies"].to_numpy()
        second = group["second"].to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        if group["i"][0] == group["j"][0]:
            right = left
        links, root = link(x, codes, factors, left, right, copies, threshold)
        at = np.flatnonzero(links)
        names = group["rid"].combine_chunks()
        return pa.table({"rid": names.take(pa.array(at)), "links": pa.array(links[at]), "root": names.take(pa.array(root[at]))})

    ship_package(coded.sparkSession)
    return dealt.groupBy("label", "size", "i", "j").applyInArrow(meet, "rid string, links bigint, root string")
