"""Best-fit packing of documents into sequences, after a reduction by dominance.

Tokenized documents become pieces of at most ``CAPACITY`` tokens, so a piece is one of so
many sizes and the whole instance is how many pieces there are of each: a table of 4096
numbers, whatever the corpus. It is solved in that form. The reduction (Martello and Toth)
takes sizes from the largest: where one small set of pieces that shares a sequence with a
piece of that size dominates all others, that sequence is fixed, as often as the pieces
last, and the instance shrinks. What remains is packed by best fit, largest first, equal
pieces at once. Both give patterns, sizes that share a sequence and how often they do so.

Pieces then find their places by their rank among those of their size. Ranks are counted
in lanes (a hash of the piece), with offsets from counts by lane, so a size that a third
of all pieces have is no task of its own, and no piece meets another.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwave.llm.common import keep_table, ship_package, slices

CAPACITY, END = 4096, 1
# Distinct words whose ids a task remembers, and the longest one it does.
_CACHE, _LONGEST = 500_000, 64
_BLOCK = 500
_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"

Pattern = tuple[tuple[int, int], ...]
"""(size, how many of it) in the order in which they lie in a sequence."""


# --- pieces -----------------------------------------------------------------------------------


class Tokens:
    """Ids of texts by a tokenizer that drops white space and cuts a letter from a mark that follows.

    Nothing in such a tokenizer reaches across white space, or from a letter to one of ``.,;:!?``
    behind it, so texts are cut there, by Arrow, and each distinct part is tokenized once while
    the cache lasts. Parts of plain letters are folded first, which the tokenizer does too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens are ordinary text in a document.
        self.tokenizer.encode_special_tokens = True
        self.zero = self.tokenizer.encode("0", add_special_tokens=False).ids
        # Ids as bytes, four each.
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text closed by END, and how many each text has."""
        marked = pc.replace_substring_regex(texts, r"(\pL)([.,;:!?])", r"\1 \2")
        marked = pc.replace_substring_regex(marked, r"[\n\t\r]", " ")
        # The split leaves an empty last part, which stands for END.
        lists = pc.split_pattern(pc.binary_join_element_wise(marked, "", " "), " ")
        parts = lists.flatten().dictionary_encode()
        words = parts.dictionary.to_pylist()
        found = self.ids_of([w.lower() if w.isascii() else w for w in words])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        starts = np.cumsum(lengths) - lengths
        at = parts.indices.to_numpy().astype(np.int64)
        n = lengths[at]
        # An empty part has no ids; the last part of each text has one, END.
        last = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)) - 1
        n[last] = 1
        ends = np.cumsum(n)
        source = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts[at], n)
        closing = ends[last] - 1
        source[closing] = 0
        ids = flat[source] if len(flat) else np.zeros(len(source), np.uint32)
        ids[closing] = END
        return ids, np.diff(np.r_[0, ends[last]])

    def ids_of(self, words: list[str]) -> list[bytes]:
        cache = self.cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if len(cache) + len(new) > _CACHE:
            cache.clear()
            new = list(dict.fromkeys(words))
        # Words without a 0 are tokenized many at a time, between zeros, whose ids they cannot have.
        plain = [w for w in new if "0" not in w]
        blocks = [plain[i : i + _BLOCK] for i in range(0, len(plain), _BLOCK)]
        (zero,) = self.zero
        told = self.tokenizer.encode_batch_fast([" 0 ".join(b) for b in blocks], add_special_tokens=False)
        for block, e in zip(blocks, told):
            ids = np.array(e.ids, "<u4")
            cuts, data = [-1, *np.flatnonzero(ids == zero).tolist(), len(ids)], ids.tobytes()
            for w, i, j in zip(block, cuts[:-1], cuts[1:], strict=True):
                cache[w] = data[4 * i + 4 : 4 * j]
        odd = [w for w in new if "0" in w]
        told = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        cache.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(odd, told))
        out = [cache[w] for w in words]
        for w in new:
            if len(w) > _LONGEST:
                del cache[w]
        return out


# One for each vocabulary, kept between the tasks of a worker.
_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of rows (doc_id, text): its ids and END, cut where they pass the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridwave.llm.packing import tokens

        encoder = tokens(vocabulary)
        for batch in slices(batches, "text"):
            ids, lengths = encoder.encode(batch.column("text"))
            data, rows, begin = memoryview(ids.astype("<u4").tobytes()), [], 0
            for i, n in enumerate(lengths.tolist()):
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    rows.append((i, k, at, size, zlib.crc32(data[4 * (begin + at) : 4 * (begin + at + size)])))
                begin += n
            places, k, start, length, crc = zip(*rows)
            columns = [batch.column("doc_id").take(pa.array(places)), pa.array(k, pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship_package(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, _PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))


# --- the instance of sizes ----------------------------------------------------------------------


class Sizes:
    """How many pieces of each size remain, with their sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, used: Pattern, times: int) -> None:
        for s, k in used:
            self.n[s] -= k * times
            if not self.n[s]:
                del self.n[s]
                del self.order[bisect_left(self.order, s)]

    def fits(self, room: int, but: int) -> int | None:
        """The largest size up to ``room``; one piece of size ``but`` is not free."""
        i = bisect_right(self.order, room) - 1
        if i >= 0 and self.order[i] == but and self.n[but] == 1:
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest(self, many: int, but: int, above: int = 0, without: int | None = None) -> list[int]:
        """The ``many`` smallest free sizes above ``above``, repeats included, without one piece of ``but`` and of ``without``."""
        out: list[int] = []
        for s in self.order[bisect_right(self.order, above) :]:
            free = self.n[s] - (s == but) - (s == without)
            out += [s] * min(free, many - len(out))
            if len(out) == many:
                break
        return out

    def best_pair(self, room: int, but: int) -> tuple[int, int] | None:
        """Two free pieces a >= b of the largest sum up to ``room``, of equal sums the one with the largest a."""
        best, low = None, 0
        for a in reversed(self.order[: bisect_right(self.order, room)]):
            if best and 2 * a < best[0] + best[1]:
                break
            if self.n[a] - (a == but) < 1:
                continue
            i = bisect_right(self.order, min(a, room - a)) - 1
            while i >= low and self.n[self.order[i]] - (self.order[i] == but) - (self.order[i] == a) < 1:
                i -= 1
            if i >= low and (best is None or a + self.order[i] > best[0] + best[1]):
                best = a, self.order[i]
        return best


def dominating(sizes: Sizes, j: int, capacity: int) -> tuple[int, ...] | None:
    """The set that a piece of size ``j`` shares a sequence with in some best solution, as far as dominance tells.

    If no two others fit beside it, the largest that fits dominates; so does one that fills
    the sequence. If two fit but no three, the largest single one dominates pairs that sum to
    no more, and the best pair dominates if it holds the largest that fits and no pair of
    pieces both larger than its smaller one fits.
    """
    room = capacity - j
    one = sizes.fits(room, j)
    if one is None:
        return (j,)
    least = sizes.smallest(3, j)
    if one == room or len(least) < 2 or least[0] + least[1] > room:
        return j, one
    if len(least) > 2 and sum(least) <= room:
        return None
    a, b = sizes.best_pair(room, j)
    if one >= a + b:
        return j, one
    if one != a:
        return None
    between = sizes.smallest(2, j, above=b, without=a)
    return (j, a, b) if len(between) < 2 or sum(between) > room else None


def _pattern(parts) -> Pattern:
    return tuple(sorted(Counter(parts).items(), reverse=True))


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Patterns that some best solution has, with how often, and the counts that remain."""
    sizes, fixed = Sizes(counts), []
    for j in sorted(counts, reverse=True):
        while sizes.n.get(j):
            parts = dominating(sizes, j, capacity)
            if parts is None:
                break
            pattern = _pattern(parts)
            # Fewer pieces only make a set dominate the more, so it is fixed while its pieces last.
            times = min(sizes.n[s] // k for s, k in pattern)
            fixed.append((pattern, times))
            sizes.take(pattern, times)
    return fixed, sizes.n


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best fit, largest first, sequences that look alike filled at once; the same as one piece after the other."""
    room: dict[int, list[tuple[Pattern, int]]] = {}
    order: list[int] = []

    def put(pattern: Pattern, left: int, times: int) -> None:
        if times:
            if left not in room:
                room[left] = []
                order.insert(bisect_left(order, left), left)
            room[left].append((pattern, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(order, s)
            if i == len(order):
                each = capacity // s
                put(((s, each),), capacity - each * s, n // each)
                if n % each:
                    put(((s, n % each),), capacity - n % each * s, 1)
                break
            left = order[i]
            pattern, times = room[left].pop()
            if not room[left]:
                del room[left]
                del order[i]
            # A sequence that has taken one is the tightest for the next as long as it fits.
            each = min(left // s, n)
            full = min(times, n // each)
            put(pattern, left, times - full)
            put((*pattern, (s, each)), left - each * s, full)
            n -= each * full
    return [p for patterns in room.values() for p in patterns]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they hold every piece once."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


# --- places -------------------------------------------------------------------------------------


def slots(spark: SparkSession, patterns: list[tuple[Pattern, int]]) -> DataFrame:
    """(length, first, last, sequence, each, at): pieces of a size by rank, from first to last, go ``each`` to a sequence.

    Patterns, and sizes in one, are bounded by the capacity, so this table is too.
    """
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        at = 0
        for s, k in pattern:
            rows.append((s, ranks[s], ranks[s] + k * times, sequence, k, at))
            ranks[s] += k * times
            at += s * k
        sequence += times
    return spark.createDataFrame(rows, "length long, first long, last long, sequence long, each long, at long")


def ranked(rows: DataFrame, lanes: int) -> DataFrame:
    """``rows`` with ``rank`` among those of their length, from 0, the same in any partitioning."""
    lane = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes)).alias("lane")
    rows = rows.select("*", lane)
    counts = rows.groupBy("length", "lane").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "lane", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32", "start"))
    rows = rows.withColumn("own", own).join(starts, ["length", "lane"])
    return rows.withColumn("rank", F.col("before") + F.col("own") - 1).drop("own", "before", "lane")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of rows (doc_id, text).

    A null text is empty, and an empty one is its END token alone. Rows of one doc_id, or of
    none, are documents of their own; equal pieces of equal ids may trade places. Other columns
    are not read. Without documents there are no rows.
    """
    spark = docs.sparkSession
    rows = keep_table(pieces(docs, vocabulary, capacity))
    # A row for each size: ``capacity`` rows at most.
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    table = slots(spark, solve(counts, capacity))
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ranked(rows, lanes).alias("r").join(
        F.broadcast(table).alias("s"),
        (F.col("r.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")),
    )
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32",
        (F.col("sequence") + F.call_function("div", nth, F.col("each"))).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("r.length")).alias("offset"),
    )
