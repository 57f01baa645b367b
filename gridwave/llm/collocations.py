"""Phrases whose words keep together, by counting all of them in tries of hash containers.

A task holds a trie over the ids it gives to words: a phrase is found by its first word, and
what follows is a key, the packed ids, in a hash container. A container that grows past BURST
keys bursts into one for each second word. When a task holds more than CAPACITY keys, the
largest subtrees leave it whole, as sorted runs; Spark's shuffle brings the runs of one
first word together, where they are merged one word after the other. Words are cut and numbered by Arrow, a batch at
a time, and a container takes all that a batch has for it at once.

A phrase occurs at least as often as every longer one that holds it. So words are counted
first, then pairs within stretches of frequent words, then longer phrases within chains of
frequent pairs: what is left out occurs too rarely to be part of any candidate. Pairs and
triples are mostly rare even so. Before they are counted they are counted by hash, in a
fixed number of buckets: a pair whose bucket holds less than the least count is rare. Which
words, pairs or buckets are frequent reaches the tasks as bitmaps of fixed size, which may
let rare ones pass but keep back no frequent one; every count that is used is exact.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwave.llm.bitmaps import BITS, PIECES, gathered, local_bitmap
from gridwave.llm.common import keep_table, ship_package, slices

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
BURST, CAPACITY = 16_384, 1_000_000
NO_LANG = "und"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Ids have 16 bits, so that the four that may follow the first fill a 64-bit key; zero is no word.
_ID_BITS, _IDS = 16, (1 << 16) - 1
_KEY_WORDS = 64 // _ID_BITS
# Words or pairs of a language that a task remembers a bitmap's answer to.
_KNOWN = 500_000
# Stands for the end of a piece; no word holds a line end.
_END = "\n"
# As many buckets as a bitmap has bits.
_BUCKET_BITS = (PIECES * BITS).bit_length() - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Buckets that a task holds before it sums them.
_HELD = 6_000_000
# Rows and bytes of text that are cut into words at a time.
_ROWS, _BYTES = 4096, 8 << 20
# Phrases in a row of a run at most.
_RUN = 20_000


def pack(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The keys of what follows the first of ``n`` ids from each start, in the order of the ids."""
    keys = np.zeros(len(starts), np.uint64)
    for j in range(1, n):
        keys |= ids[starts + j].astype(np.uint64) << np.uint64(64 - _ID_BITS * j)
    return keys


def unpack(keys: np.ndarray, j: int) -> np.ndarray:
    """The ``j``-th id (from 0) of keys; zero where they are shorter."""
    return (keys >> np.uint64(64 - _ID_BITS * (j + 1)) & np.uint64(_IDS)).astype(np.int64)


class HatTrie:
    """Counts of sequences of up to five ids: hash containers below the first id, or the first two."""

    def __init__(self, burst: int = BURST):
        self.burst, self.size = burst, 0
        # First id: container of packed ids, or after a burst containers by second id.
        self.root: dict[int, Counter | dict[int, Counter]] = {}
        self.sizes: dict[int, int] = {}

    def add(self, first: np.ndarray, keys: np.ndarray) -> None:
        """Count each (first id, key) once more."""
        order = np.argsort(first, kind="stable")
        first, keys = first[order], keys[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for k, part in zip(first[np.r_[0, cuts]].tolist() if len(first) else [], np.split(keys, cuts)):
            self._add(k, part)

    def _add(self, first: int, keys: np.ndarray) -> None:
        below = self.root.get(first)
        if below is None:
            below = self.root[first] = Counter()
        if isinstance(below, Counter):
            before = len(below)
            below.update(keys.tolist())
            grown = len(below) - before
            if len(below) > self.burst:
                self.root[first] = self._split(below)
        else:
            seconds = unpack(keys, 0)
            order = np.argsort(seconds, kind="stable")
            keys, seconds, grown = keys[order], seconds[order], 0
            cuts = np.flatnonzero(seconds[1:] != seconds[:-1]) + 1
            for k, part in zip(seconds[np.r_[0, cuts]].tolist(), np.split(keys, cuts)):
                container = below.setdefault(k, Counter())
                before = len(container)
                container.update(part.tolist())
                grown += len(container) - before
        self.size += grown
        self.sizes[first] = self.sizes.get(first, 0) + grown

    @staticmethod
    def _split(container: Counter) -> dict[int, Counter]:
        out: dict[int, Counter] = {}
        for key, n in container.items():
            out.setdefault(key >> (64 - _ID_BITS), Counter())[key] = n
        return out

    def take(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys, in order, and counts of all sequences of one first id; the subtree leaves the trie."""
        self.size -= self.sizes.pop(first)
        below = self.root.pop(first)
        containers = [below] if isinstance(below, Counter) else list(below.values())
        n = sum(map(len, containers))
        keys = np.fromiter((k for c in containers for k in c), np.uint64, n)
        counts = np.fromiter((v for c in containers for v in c.values()), np.int64, n)
        order = np.argsort(keys)
        return keys[order], counts[order]

    def largest(self, above: int) -> list[int]:
        """First ids of the largest subtrees, as many as leave at most ``above`` sequences."""
        out, left = [], self.size
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if left <= above:
                break
            out.append(first)
            left -= self.sizes[first]
        return out


class Sieve:
    """Which of a language's keys may be among those a bitmap was made of."""

    def __init__(self, bits: bytes):
        self.bits = bits
        self.known: dict[str, dict[str, int]] = {}

    def __call__(self, lang: str, keys: list[str]) -> np.ndarray:
        known = self.known.setdefault(lang, {})
        if len(known) > _KNOWN:
            known.clear()
        new = [k for k in keys if k not in known]
        if new:
            seed, bits = xxhash.xxh64_intdigest(lang.encode(), 42), self.bits
            for k in new:
                # The remainder of the signed hash: the number of bits is a power of two.
                p = xxhash.xxh64_intdigest(k.encode(), seed) % (PIECES * BITS)
                known[k] = bits[p >> 3] >> (p & 7) & 1
        return np.fromiter(map(known.__getitem__, keys), bool, len(keys))


def buckets_of(lang: str, hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash buckets of the ``n`` words from each start, by the hashes of words: the same in all tasks."""
    code = np.full(len(starts), xxhash.xxh64_intdigest(lang.encode(), n), np.uint64)
    for j in range(n):
        code = (code ^ hashes[starts + j]) * _MIX
        code ^= code >> np.uint64(29)
    return (code * _MIX >> np.uint64(64 - _BUCKET_BITS)).astype(np.uint32)


class Counts:
    """The tries of a task, one for each language, and the words behind their ids (from 1)."""

    def __init__(self, capacity: int = CAPACITY, burst: int = BURST):
        self.capacity, self.burst = capacity, burst
        self.clear()

    def clear(self) -> None:
        self.tries: dict[str, HatTrie] = {}
        self.ids: dict[str, int] = {}
        self.words = [""]

    def room(self, words: list[str]) -> int:
        """How many ids are left once these words have theirs."""
        return _IDS - len(self.words) - sum(w not in self.ids for w in words)

    def number(self, words: list[str]) -> np.ndarray:
        """Ids of distinct words, zero before the first."""
        out = np.zeros(len(words) + 1, np.int64)
        for i, w in enumerate(words, 1):
            k = self.ids.get(w)
            if k is None:
                k = self.ids[w] = len(self.words)
                self.words.append(w)
            out[i] = k
        return out

    def add(self, lang: str, ids: np.ndarray, reach: np.ndarray, least: int, most: int) -> None:
        """Count the phrases of ``ids``; ``reach`` tells how many words from each on may be one phrase."""
        trie = self.tries.setdefault(lang, HatTrie(self.burst))
        for n in range(least, most + 1):
            starts = np.flatnonzero(reach >= n)
            trie.add(ids[starts], pack(ids, starts, n))

    def spill(self, everything: bool = False) -> Iterator[pa.RecordBatch]:
        """Rows (lang, head, rests, counts), sorted runs of whole subtrees, when there is too much to hold."""
        if not everything and sum(t.size for t in self.tries.values()) <= self.capacity:
            return
        share = 0 if everything else self.capacity // (2 * len(self.tries))
        words = pa.array(self.words)
        for lang, trie in self.tries.items():
            held, size = [], 0
            for first in trie.largest(share):
                keys, counts = trie.take(first)
                held += [(first, keys[i : i + _RUN], counts[i : i + _RUN]) for i in range(0, len(keys), _RUN)]
                size += len(keys)
                if size > 5 * _RUN:
                    yield self._runs(lang, words, held)
                    held, size = [], 0
            if held:
                yield self._runs(lang, words, held)
        if everything:
            self.clear()

    def _runs(self, lang: str, words: pa.Array, held: list) -> pa.RecordBatch:
        keys = np.concatenate([h[1] for h in held])
        length = sum((unpack(keys, j) > 0).astype(np.int64) for j in range(_KEY_WORDS))
        rests, order = [], []
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            rests.append(pc.binary_join_element_wise(*[words.take(pa.array(unpack(keys[at], j))) for j in range(n)], " "))
            order.append(at)
        rests = pa.concat_arrays(rests).take(pa.array(np.argsort(np.concatenate(order))))
        offsets = pa.array(np.r_[0, np.cumsum([len(h[1]) for h in held])].astype(np.int32))
        columns = [
            pa.array([lang] * len(held)), words.take(pa.array([h[0] for h in held])), pa.ListArray.from_arrays(offsets, rests),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([h[2] for h in held]))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "head", "rests", "counts"])


def merged(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of runs (lang, head, rests, counts) in order of their heads, where f is ``min_count`` at least."""

    def told(at: tuple[str, str], found: dict[str, int]) -> pa.RecordBatch:
        often = [(f"{at[1]} {rest}", n) for rest, n in found.items() if n >= min_count]
        phrases, counts = (pa.array([o[0] for o in often], pa.string()), pa.array([o[1] for o in often], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(often), pa.string()), phrases, counts], ["lang", "phrase", "f"])

    last, found = None, {}
    for batch in batches:
        for lang, head, rests, counts in zip(*[c.to_pylist() for c in batch.columns]):
            if (lang, head) != last:
                if found:
                    yield told(last, found)
                last, found = (lang, head), {}
            for rest, n in zip(rests, counts):
                found[rest] = found.get(rest, 0) + n
    if found:
        yield told(last, found)


def word_arrays(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Numbers of the words of texts, one after the other, and the words; the end of a piece is the word _END."""
    folded = pc.replace_substring_regex(pc.ascii_lower(texts), r"[.,;:!?\x0a-\x0d]", " \n ")
    folded = pc.binary_join_element_wise(pc.replace_substring(folded, "\t", " "), pa.scalar("\n"), " ")
    found = pc.split_pattern(folded, " ").flatten()
    found = found.filter(pc.not_equal(found, "")).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def frequent_words(numbers: np.ndarray, words: list[str], often: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Numbers of the words that are often, from 1, zero for all others, and these words."""
    codes = np.where(often, np.cumsum(often), 0)
    return codes[numbers], [words[k] for k in np.flatnonzero(often).tolist()]


def segments(numbers: np.ndarray, words: list[str], most: int, most_ids: int) -> Iterator[tuple[np.ndarray, list[str], int]]:
    """(numbers, words, upto) with fewer words than ids; a phrase is counted where its first word is."""
    if len(words) < most_ids:
        yield numbers, words, len(numbers)
        return
    step = most_ids - most
    for at in range(0, len(numbers), step):
        distinct, back = np.unique(np.r_[0, numbers[at : at + step + most - 1]], return_inverse=True)
        yield back[1:], [words[k - 1] for k in distinct[1:].tolist()], step


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words of rows (lang, text)."""
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    words = F.explode(F.split(text, r"[.,;:!?\x0A-\x0D\x20\x09]+", -1))
    found = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), words.alias("phrase")).where("phrase <> ''")
    return found.groupBy("lang", "phrase").agg(F.count("*").alias("f"))


class Bits:
    """A bitmap on its way to the tasks: packed, since most are nearly empty, and sent once."""

    def __init__(self, spark: SparkSession, bits: bytes):
        self.packed = spark.sparkContext.broadcast(zlib.compress(bits, 1))

    def bytes(self) -> bytes:
        return zlib.decompress(self.packed.value)


def runs_from(ok: np.ndarray) -> np.ndarray:
    """How many are true in a row from each on."""
    ends = np.flatnonzero(~np.r_[ok, False])
    at = np.arange(len(ok))
    return ends[np.searchsorted(ends, at)] - at


class Chains:
    """Stretches of words that may belong to frequent phrases, in batches of texts."""

    def __init__(self, words: Bits, pair_buckets: Bits | None, pairs: Bits | None, triple_buckets: Bits | None, most: int, most_ids: int):
        self.may = Sieve(words.bytes())
        self.may_pair = pairs and Sieve(pairs.bytes())
        self.buckets = {n: np.frombuffer(b.bytes(), np.uint8) for n, b in ((2, pair_buckets), (3, triple_buckets)) if b}
        self.most, self.most_ids = most, most_ids

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """(lang, words, codes, hashes, reach) of rows (lang, text): the words in a row, by number, from 1, and by hash."""
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            of_lang = batch.column("text").filter(pc.equal(langs, lang))
            numbers, words = word_arrays(of_lang)
            often = self.may(lang, words)
            if _END in words:
                often[words.index(_END)] = False
            codes = frequent_words(numbers, words, often)
            for numbers, words, upto in segments(*codes, self.most, self.most_ids):
                words = ["", *words]
                hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], np.uint64)[numbers]
                reach = self.reach(lang, words, numbers, hashes)
                reach[upto:] = 0
                yield lang, words, numbers, hashes, reach

    def reach(self, lang: str, words: list[str], codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """How many words from each on may be one phrase."""
        near = np.r_[(codes[:-1] > 0) & (codes[1:] > 0), False]
        self._sift(near, lang, hashes, 2)
        at = np.flatnonzero(near)
        if self.may_pair is not None and len(at):
            distinct, back = np.unique(codes[at] << 32 | codes[at + 1], return_inverse=True)
            told = self.may_pair(lang, [f"{words[k >> 32]} {words[k & 0xFFFFFFFF]}" for k in distinct.tolist()])
            near[at] = told[back]
        reach = np.where(codes > 0, runs_from(near) + 1, 0)
        if 3 in self.buckets:
            three = reach >= 3
            self._sift(three, lang, hashes, 3)
            reach = np.where(three, runs_from(three) + 2, np.minimum(reach, 2))
        return reach

    def _sift(self, ok: np.ndarray, lang: str, hashes: np.ndarray, n: int) -> None:
        """Only those stay true whose bucket is frequent."""
        if n in self.buckets:
            at = np.flatnonzero(ok)
            code = buckets_of(lang, hashes, at, n)
            ok[at] = self.buckets[n][code >> 3] >> (code & 7).astype(np.uint8) & 1


def in_phrases(reach: np.ndarray, least: int, most: int) -> np.ndarray:
    """Which words lie in a phrase of ``least`` words or more."""
    starts = np.flatnonzero(reach >= least)
    edges = np.zeros(len(reach) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + np.minimum(reach[starts], most), -1)
    return np.cumsum(edges)[:-1] > 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def bucket_bitmap(docs: DataFrame, n: int, min_count: int, words: Bits, pair_buckets: Bits | None = None, pairs: Bits | None = None,
                  most_ids: int = _IDS, held: int = _HELD) -> Bits:
    """Which buckets hold ``min_count`` phrases of ``n`` words or more, one bit each.

    Tasks sum the buckets they meet and give them out by piece, as steps from one to the next and
    counts; the pieces are summed where they meet, one after the other.
    """
    spark = docs.sparkSession
    def summed(codes: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(codes), return_counts=True)
        pieces, starts = np.unique(found // BITS, return_index=True)
        rows = []
        for a, b in zip(starts, np.r_[starts[1:], len(found)]):
            steps = np.diff(found[a:b] % BITS, prepend=np.uint32(0)).astype("<u2")
            rows.append(zlib.compress(steps.tobytes() + counts[a:b].astype("<u4").tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(pieces.astype(np.int32)), pa.array(rows, pa.binary())], ["_piece", "held"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains(words, pair_buckets, pairs, None, n, most_ids)
        codes, size = [], 0
        for batch in slices(batches, "text", _ROWS, _BYTES):
            for lang, _, _, hashes, reach in chains.of(batch):
                codes.append(buckets_of(lang, hashes, np.flatnonzero(reach >= n), n))
                size += len(codes[-1])
                if size > held:
                    yield summed(codes)
                    codes, size = [], 0
        if size:
            yield summed(codes)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, np.zeros(BITS, np.int64)

        def row() -> pa.RecordBatch:
            bits = np.packbits(total >= min_count, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([bits], pa.binary())], ["_piece", "_map"])

        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != piece:
                    if piece is not None:
                        yield row()
                    piece = at
                    total[:] = 0
                data = zlib.decompress(data)
                k = len(data) // 6
                total[np.cumsum(np.frombuffer(data, "<u2", k).astype(np.int64))] += np.frombuffer(data, "<u4", k, 2 * k)
        if piece is not None:
            yield row()

    ship_package(spark)
    held_rows = _texts(docs).mapInArrow(scan, "_piece int, held binary")
    merged = held_rows.repartition("_piece").sortWithinPartitions("_piece").mapInArrow(often, "_piece int, _map binary")
    return Bits(spark, gathered(merged))


def phrase_counts(
    docs: DataFrame, least: int, most: int, min_count: int, words: Bits, pair_buckets: Bits | None = None, pairs: Bits | None = None,
    triple_buckets: Bits | None = None, capacity: int = CAPACITY, burst: int = BURST, most_ids: int = _IDS,
) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``least`` (2 or more) to ``most`` words that rows (lang, text) hold ``min_count`` times or more.

    ``words`` is the bitmap of words (lang, phrase) that phrases may hold; the others, where they
    are given, are those of the buckets of pairs, of pairs, and of the buckets of triples.
    """
    if not 2 <= least <= most <= 1 + _KEY_WORDS or not most < most_ids <= _IDS:
        raise ValueError(f"phrases have 2 to {1 + _KEY_WORDS} words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, counts = Chains(words, pair_buckets, pairs, triple_buckets, most, most_ids), Counts(capacity, burst)
        for batch in slices(batches, "text", _ROWS, _BYTES):
            for lang, known, codes, _, reach in chains.of(batch):
                # Only words of phrases that are counted need an id.
                used, back = np.unique(np.where(in_phrases(reach, least, most), codes, 0), return_inverse=True)
                named = [known[k] for k in used.tolist() if k]
                if counts.room(named) < _IDS - most_ids:
                    yield from counts.spill(everything=True)
                ids = counts.number(named)
                counts.add(lang, (ids if 0 in used else ids[1:])[back], reach, least, most)
                yield from counts.spill()
        yield from counts.spill(everything=True)

    ship_package(docs.sparkSession)
    # Runs of one head meet and are merged, one head after the other.
    runs = _texts(docs).mapInArrow(run, "lang string, head string, rests array<string>, counts array<long>")
    runs = runs.repartition("lang", "head").sortWithinPartitions("lang", "head")
    return runs.mapInArrow(lambda batches: merged(batches, min_count), "lang string, phrase string, f long")


def frequencies(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases that occur ``min_count`` times or more, and (lang, n) of all words."""
    every = keep_table(word_counts(docs))
    words = every.where(F.col("f") >= min_count)
    spark = docs.sparkSession
    bits = Bits(spark, local_bitmap(words, ["lang", "phrase"]))
    buckets = bucket_bitmap(docs, 2, min_count, bits)
    often = keep_table(phrase_counts(docs, 2, 2, min_count, bits, buckets))
    found = words.unionByName(often)
    if max_words > 2:
        pairs = Bits(spark, local_bitmap(often, ["lang", "phrase"]))
        triples = bucket_bitmap(docs, 3, min_count, bits, buckets, pairs)
        longer = phrase_counts(docs, 3, max_words, min_count, bits, buckets, pairs, triples)
        found = found.unionByName(keep_table(longer))
    return found, every.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``max_words`` words.

    ``docs`` has text and lang; other columns are not read. A null text is empty, a null lang
    is NO_LANG. ``a`` is how often the phrase occurs, ``l`` and ``r`` how often its parts at
    the cut that scores lowest (floor(1000 a n / (l r)); of equal ones the first). A phrase
    that never occurs outside a longer candidate is left out. Equal rows count each; of equal
    scores the more frequent phrase is first, then the smaller one. Languages without
    candidates, and empty tables, give no rows.
    """
    counts, totals = frequencies(docs, min_count, max_words)
    words = F.split("phrase", " ", -1)
    counts = counts.select("lang", "phrase", "f", words.alias("words"), F.size(words).alias("k"))
    candidates = counts.where("k > 1")
    # What lies inside a longer candidate that is as frequent is a part of it, not a phrase.
    spans = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))"
    inner = candidates.where("k > 2").select("lang", F.explode(F.array_distinct(F.expr(spans))).alias("phrase"), F.col("f").alias("g"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("g").alias("g"))
    free = candidates.join(inner, ["lang", "phrase"], "left").where("g IS NULL OR g < f").drop("g")
    cut = free.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cut = cut.select(
        "lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("_left"),
        F.expr("array_join(slice(words, cut + 1, size(words)), ' ')").alias("_right"),
    )
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    cut = cut.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(totals, "lang")
    score = F.expr("(1000BD * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    scored = cut.withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b"))
    best = best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each lane, then the first of those: no task sorts a whole language.
    lanes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lane = F.pmod(F.xxhash64("phrase"), F.lit(lanes)).alias("lane")
    best = best.select("*", lane).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order)))
    best = best.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    best = best.where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> str:
    """DuckDB SQL for the rows of ``collocations`` over documents."""
    return f"""
WITH texts AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
counts AS (
  SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS ws, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g
        FROM w, range(1, {max_words + 1}) t(k))
  GROUP BY lang, k, array_to_string(g, ' ')),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= {min_count}),
c AS (SELECT * FROM often WHERE k > 1),
free AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS g
    WHERE g.lang = c.lang AND g.k > c.k AND 100 * g.f >= 100 * c.f AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT free.lang, free.phrase, cut, free.f AS a, x.f AS l, y.f AS r, n,
         ((1000::HUGEINT * free.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM free, range(1, {max_words}) t(cut), often x, often y, totals
  WHERE cut < free.k AND x.lang = free.lang AND y.lang = free.lang AND totals.lang = free.lang
    AND x.phrase = array_to_string(free.ws[1:cut], ' ') AND y.phrase = array_to_string(free.ws[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {top}"""
