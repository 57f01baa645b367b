"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

A batch of documents is cut into the matches of a pattern, and its distinct
matches ("words") form one corpus of token sequences. An inverted index holds, for
each rank a pair of neighbours can merge to, the places where it occurs; a heap of
ranks replays the merges from the lowest up, and a merge touches only the two
neighbours it changes. The lowest rank of the whole corpus is also the lowest in
its word, so every word sees the merges in the order in which it would alone.

Chunks met before by a worker are looked up; the lookup takes in chunks until it has
``CACHE`` of them, and later new ones are encoded for their batch alone. Documents never leave their row: no shuffle, memory bounded by
a batch. Ids are assembled, and bytes decoded, by numpy over flat arrays.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridwave.llm.common import map_arrow

CACHE = 300_000
# Longer chunks and words are cut or encoded each time instead of being kept.
KEPT_CHARS = 100


class Ranks(NamedTuple):
    """Where a vocabulary of ranks comes from: a file of base64 tokens and ranks, and the pattern of words."""

    path: str
    pattern: str


@lru_cache(maxsize=4)
def load(path: str) -> dict[bytes, int]:
    """Token bytes to rank; every single byte must have one."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no rank for the bytes {missing[:5]}")
    return ranks


@lru_cache(maxsize=4)
def pairs(path: str) -> tuple[dict[int, int], list[int], int]:
    """Two neighbouring ids, as ``left * base + right``, to the rank of what they merge to; ids of bytes; the base."""
    ranks = load(path)
    base = max(ranks.values()) + 2  # the largest id is free: it stands between words
    merges = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                merges[left * base + right] = rank
    return merges, [ranks[bytes([b])] for b in range(256)], base


def replay(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words joined, and the number of ids of each: every merge applied to all words by rank."""
    merges, of_byte, base = pairs(path)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    gap, dead, get = base - 1, -1, merges.get
    # A gap stands before, between and behind the words; no merge has one.
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths + 1)
    first = np.full(int(ends[-1]) + 1, gap, np.int64)
    inside = np.ones(len(first), bool)
    inside[0] = inside[ends] = False
    first[inside] = np.array(of_byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
    # The inverted index: rank -> places of left tokens whose pair merges to it.
    keys = first[:-1] * base + first[1:]
    distinct, kind = np.unique(keys, return_inverse=True)
    rank_of = np.array([get(int(k), dead) for k in distinct], np.int64)[kind.reshape(-1)]
    order = np.argsort(rank_of, kind="stable")
    order = order[np.searchsorted(rank_of[order], 0) :]
    ranks, start = np.unique(rank_of[order], return_index=True)
    places = {int(r): p.tolist() for r, p in zip(ranks, np.split(order, start[1:]))}
    heap = list(places)
    heapq.heapify(heap)
    token, after, before = first.tolist(), list(range(1, len(first) + 1)), list(range(-1, len(first) - 1))

    def add(rank: int, place: int) -> None:
        if (known := places.get(rank)) is None:
            places[rank] = [place]
            heapq.heappush(heap, rank)
        else:
            known.append(place)

    while heap:
        rank = heapq.heappop(heap)
        waiting = places.pop(rank)
        waiting.sort()
        wait_to = -1  # end of a word in which a lower rank has come up: its other places wait
        for i in waiting:
            if i < wait_to:
                add(rank, i)
                continue
            j = after[i]
            if token[i] == dead or get(token[i] * base + token[j]) != rank:
                continue  # one of the two has gone into another token meanwhile
            token[i], token[j] = rank, dead
            k = after[i] = after[j]
            before[k] = i
            lower = False
            if (r := get(rank * base + token[k])) is not None:
                add(r, i)
                lower = r < rank
            h = before[i]
            if (r := get(token[h] * base + rank)) is not None:
                add(r, h)
                lower = lower or r < rank
            if lower:
                wait_to = i
                while token[wait_to] != gap:
                    wait_to = after[wait_to]
    left = np.array(token, np.int64)
    words_at = np.cumsum(left == gap)
    real = (left != gap) & (left != dead)
    return left[real].astype(np.int32), np.bincount(words_at[real] - 1, minlength=len(words))


# Where a text does not simply fall apart at its spaces.
_ODD_SPACE = re.compile(r"\s | \s|^ | $")


class Encoder:
    """Keeps the ids of the chunks and words it has met in flat arrays; encodes batches of texts."""

    def __init__(self, ranks: Ranks, cache: int = CACHE):
        self.path = ranks.path
        self.find = regex.compile(ranks.pattern).findall
        self.cache = cache
        self.words: dict[str, int] = {}
        self.word_ids, self.word_start, self.word_size = _Flat(), array("q"), array("q")
        self.chunks: dict[str, int] = {}  # without their first space
        self.ids, self.start, self.size = _Flat(), array("q"), array("q")

    def _learn(self, new: list[str]) -> None:
        """Ids of chunks that are not known yet, each with the space before it."""
        per_chunk, fresh = [], []
        words, next_word = self.words, len(self.words)
        for chunk in new:
            numbers = []
            for x in self.find(chunk):
                if (k := words.get(x)) is None:
                    k = words[x] = next_word
                    next_word += 1
                    fresh.append(x)
                numbers.append(k)
            per_chunk.append(numbers)
        flat, size = replay([w.encode() for w in fresh], self.path)
        _extend(self.word_ids, self.word_start, self.word_size, flat, size)
        numbers = np.array([k for x in per_chunk for k in x], np.int64)
        starts, sizes = np.frombuffer(self.word_start, np.int64), np.frombuffer(self.word_size, np.int64)
        flat, ends = gather(self.word_ids.view(), starts, sizes, numbers)
        ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, per_chunk)])]
        _extend(self.ids, self.start, self.size, flat, np.diff(ends))

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids start (one more entry: the end)."""
        full = len(self.chunks) >= self.cache
        marks = [len(x) for x in (self.words, self.word_start, self.word_ids.data, self.start, self.ids.data)]
        known, passing, new, order, counts = self.chunks, {}, [], [], []
        for text in texts:
            first, parts = split(text or "")
            got = list(map(known.get, parts))
            if None in got:
                for at, number in enumerate(got):
                    if number is None:
                        part = parts[at]
                        if (number := known.get(part, passing.get(part))) is None:
                            number = len(self.start) + len(new)
                            new.append(f" {part}")
                            (passing if full or len(part) > KEPT_CHARS else known)[part] = number
                        got[at] = number
            if first:
                order.append(len(self.start) + len(new))
                new.append(first)
            order += got
            counts.append(len(got) + bool(first))
        self._learn(new)
        ids, ends = gather(
            self.ids.view(), np.frombuffer(self.start, np.int64), np.frombuffer(self.size, np.int64),
            np.array(order, np.int64),
        )
        if full:
            self._forget(*marks)
        return ids, np.concatenate([[0], ends])[np.cumsum([0, *counts])]

    def _forget(self, words: int, word_count: int, word_ids: int, count: int, ids: int) -> None:
        """What came after these lengths: new chunks of a batch that are not kept."""
        while len(self.words) > words:
            self.words.popitem()
        del self.word_start[word_count:], self.word_size[word_count:], self.word_ids.data[word_ids:]
        del self.start[count:], self.size[count:], self.ids.data[ids:]


class _Flat:
    """An array of ids that grows."""

    def __init__(self) -> None:
        self.data = array("i")

    def view(self) -> np.ndarray:
        return np.frombuffer(self.data, np.int32) if self.data else np.zeros(0, np.int32)


def _extend(flat: _Flat, start: array, size: array, ids: np.ndarray, sizes: np.ndarray) -> None:
    ends = np.cumsum(sizes)
    start.frombytes((len(flat.data) + ends - sizes).astype(np.int64).tobytes())
    size.frombytes(sizes.astype(np.int64).tobytes())
    flat.data.frombytes(ids.astype(np.int32).tobytes())


def split(text: str) -> tuple[str, list[str]]:
    """The first chunk of a text, and the others without the single space each begins with.

    A single space between two characters that are no white space always starts a word.
    """
    parts = text.split(" ")
    if _ODD_SPACE.search(text) is None:
        return parts[0], parts[1:]
    out = [parts[0]]
    for p in parts[1:]:
        last = out[-1]
        if not p or not last or p[0].isspace() or last[-1].isspace():
            out[-1] = f"{last} {p}"
        else:
            out.append(p)
    return out[0], out[1:]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[start[k]:start[k]+size[k]]`` for each k of ``order``, joined; and where each ends."""
    sizes = size[order]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(start[order] - (ends - sizes), sizes)
    return flat[shift + np.arange(total)], ends


@lru_cache(maxsize=2)
def encoder(ranks: Ranks, cache: int = CACHE) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(ranks, cache)


def encode(
    docs: DataFrame, ranks: Ranks, text: str = "text", ids: str = "ids", keep_text: bool = True, cache: int = CACHE
) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int): its tokens, without special ones.

    A null text counts as empty and has no tokens. A column named like ``ids`` is replaced;
    without ``keep_text`` the texts are not sent back from Python.
    """
    docs = docs.drop(ids)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{ids}` array<int>"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = encoder(ranks, cache).encode(batch.column(text).to_pylist())
        column = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
        names = [f.name for f in fields]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], [*names, ids])

    return map_arrow(docs, text, kinds, run)


def decode(docs: DataFrame, ranks: Ranks, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the column ``decoded`` (binary): the bytes that ``ids`` stand for.

    Null ids count as none. An id outside the vocabulary fails. A column of that name is replaced.
    """
    docs = docs.drop(decoded)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, start, size = token_bytes(ranks.path)
        column = batch.column(ids)
        column = column.fill_null([]) if column.null_count else column
        numbers = column.flatten().to_numpy(zero_copy_only=False)
        lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= len(size) or not size[numbers].all()):
            raise ValueError("an id is not in the vocabulary")
        out, ends = gather(flat, start, size, numbers)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        offsets = pa.py_buffer(ends.astype(np.int32))
        binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(out)])
        return pa.RecordBatch.from_arrays([*batch.columns, binary], [*batch.schema.names, decoded])

    return map_arrow(docs, ids, f"{kinds}, `{decoded}` binary", run)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes in one array, and each id's start and size there (size 0: no such id)."""
    by_id = {r: t for t, r in load(path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
