"""Near-duplicate documents by SimHash fingerprints of 64 bits.

Fingerprints are computed from whole texts in Arrow batches. Only distinct
fingerprints are compared. Two that differ in at most ``MAX_BITS`` bits differ in at
most as many of their 8 bytes, so they share at least ``8 - MAX_BITS`` bytes in their
places. The inverted index lists fingerprints by position and value of bytes. One byte
alone would have 256 values and lists that grow with the table, so an entry is two
pairs of neighbouring bytes: of the four pairs, at least two are the same in any two
fingerprints to be found (two bits touch two pairs at most), hence six entries each
of 32 bits. For candidates that share an entry, the shared positional bytes are
tallied; pairs with the guaranteed number stay and are verified by their bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridwave.llm.common import keep, map_arrow
from gridwave.llm.components import bucket_components

MAX_BITS = 2
SHINGLE = 3
SEED = 42
_BLOCK = 1 << 14


def fingerprint(text: str | None) -> int:
    """Majority bits of the hashes of the word shingles of a text, as a signed number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _BLOCK):
        part = words[start : start + _BLOCK + SHINGLE - 1]
        hashes = [digest(b" ".join(part[i : i + SHINGLE]), SEED) for i in range(min(_BLOCK, n - start))]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """The columns of ``docs`` but the text, and its fingerprint (long); null counts as empty."""
    docs = docs.drop(column)
    names = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = pa.array([fingerprint(t) for t in batch.column(text).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), prints], [*names, column])

    return map_arrow(docs, text, f"{kinds}, `{column}` bigint", run)


def byte_index(prints: DataFrame) -> DataFrame:
    """(key, id) entries of distinct fingerprints ``id``: which bytes of which positions they have."""
    pairs = [f"shiftrightunsigned(id, {16 * k}) & 65535" for k in range(4)]
    entries = ", ".join(
        f"{n << 32}L + ({pairs[i]}) * 65536 + ({pairs[j]})"
        for n, (i, j) in enumerate(combinations(range(4), 2))
    )
    return prints.selectExpr("id", f"explode(array({entries})) AS key")


def close(pairs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The pairs (a, b) with enough shared positional bytes, and few enough bits that differ."""
    shared = " + ".join(
        f"int((shiftrightunsigned(a, {8 * k}) & 255) = (shiftrightunsigned(b, {8 * k}) & 255))" for k in range(8)
    )
    tallied = pairs.withColumn("shared", F.expr(shared)).where(F.col("shared") >= 8 - max_bits)
    return tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    The component is the smallest id reachable over links of at most 2 bits, the document
    itself included. Texts without words have fingerprint 0 and are linked like others. A
    null id takes part and gets its group's smallest id, null if all ids of the group are
    null; repeated rows stay repeated; an empty table gives no rows.
    """
    # Two numbers a document: what Python has computed is written once.
    prints = keep(with_fingerprint(docs.select("doc_id", F.col(text).alias("text"))))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    linked = bucket_components(byte_index(distinct.select(F.col("fingerprint").alias("id"))), close)
    groups = distinct.join(linked, F.col("fingerprint") == F.col("id"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("group")
    )
    least = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "group").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that stay: of each group the one with the smallest id.

    Of several rows with one id, the one with the smallest hash stays; rows without id
    are all kept, as they cannot be told apart.
    """
    stay = classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    first = F.row_number().over(_by_id(docs))
    kept = docs.join(stay, "doc_id").withColumn("_row", first).where("_row = 1").drop("_row")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def _by_id(docs: DataFrame) -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy(F.xxhash64(*[c for c in docs.columns if c != "doc_id"]))
