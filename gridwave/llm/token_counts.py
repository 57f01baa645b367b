"""Token counts that follow edits.

A document is cut into the matches of a pattern (pre-tokens); each is a leaf of a
segment tree that sums characters and tokens. An edit descends to the leaves it
touches, re-cuts the text from a safe boundary before it until the new cuts meet an
old one behind it, encodes the pre-tokens in between, puts them into the first leaf
touched, empties the others and updates the sums above. All else is kept.

Why this is exact: where a pre-token ends depends on what it has read, at most one
character beyond the one after it, so leaves that end two characters before the edit
stand; and cutting goes from left to right without looking back, so from a common
boundary on equal texts are cut alike. Pre-tokens are encoded one by one.

``plant`` writes the leaves of each document's tree into a column, and ``revise`` takes
them from there and returns them edited, so a later round of edits neither cuts nor
encodes what earlier rounds have left alone. ``count`` does both in one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridwave.llm import bpe
from gridwave.llm.bpe import Ranks
from gridwave.llm.common import map_arrow

CACHE = 500_000


class Counter:
    """Numbers of tokens of pre-tokens; keeps up to ``cache`` of them."""

    def __init__(self, ranks: Ranks, cache: int = CACHE):
        self.path = ranks.path
        self.pattern = regex.compile(ranks.pattern)
        self.known: dict[str, int] = {}
        self.cache = cache

    def learn(self, texts: Iterable[list[str]]) -> dict[str, int]:
        """Counts of pre-tokens that are not kept, encoded together."""
        known = self.known
        new = list({w for words in texts for w in words if w not in known})
        _, sizes = bpe.replay([w.encode() for w in new], self.path)
        fresh = dict(zip(new, sizes.tolist()))
        if len(known) + len(fresh) <= self.cache:
            known.update(fresh)
        return fresh


class TokenTree:
    """The segment tree of one document."""

    def __init__(self, words: list[str], sizes: list[int], counter: Counter):
        self.counter = counter
        self.leaves: list[list[str]] = [[w] for w in words] or [[]]
        self.parts: list[list[int]] = [[n] for n in sizes] or [[]]
        n = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.first = n
        sums = np.zeros((2 * n, 2), np.int64)
        if words:
            sums[n : n + len(words), 0] = list(map(len, words))
            sums[n : n + len(words), 1] = sizes
        level = n
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2
        self.sums = sums
        self.recoded = 0

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)

    def stored(self) -> dict:
        """What ``kept_tree`` makes the tree of again: lengths and tokens of all pre-tokens, and a checksum of their text."""
        text = self.text()
        return {
            "chars": [len(w) for leaf in self.leaves for w in leaf],
            "tokens": [n for part in self.parts for n in part],
            "crc": zlib.crc32(text.encode()),
        }

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place``, and where that leaf starts; the last leaf at the end."""
        node, start = 1, 0
        while node < self.first:
            node *= 2
            left = int(self.sums[node, 0])
            if place - start >= left:
                start += left
                node += 1
        return min(node - self.first, len(self.leaves) - 1), start

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters from ``start``; both are cut to the text."""
        total = self.chars
        start = min(max(start, 0), total)
        stop = min(start + max(length, 0), total)
        if start == stop and not replacement:
            return
        # From the leaf with the last character whose reading could have reached the edit.
        first, begin = self.find(max(0, start - 2)) if total else (0, 0)
        if first and begin > start:
            first, begin = self.find(start)
        last, at = first, begin
        old = []
        while last < len(self.leaves) and (at < stop or not old):
            old += self.leaves[last]
            at += sum(map(len, self.leaves[last]))
            last += 1
        joined = "".join(old)
        fresh = joined[: start - begin] + replacement + joined[stop - begin :]
        shift = len(replacement) - (stop - start)
        # Cut anew, reading on leaf by leaf until a new cut falls on the end of a leaf that is wholly behind the edit.
        step = 1
        while True:
            ahead, look = [], last
            while look < len(self.leaves) and len(ahead) < step:
                ahead += self.leaves[look]
                look += 1
            words = self.counter.pattern.findall(fresh + "".join(ahead))
            ends = np.cumsum([0, *map(len, words)])
            if look >= len(self.leaves):
                last = look
                break
            # The last words may still grow: a cut counts only if two characters follow it.
            whole, edge, found = len(fresh) + sum(map(len, ahead)), len(fresh), None
            for k in range(last, look + 1):
                hit = int(np.searchsorted(ends, edge))
                if edge >= stop - begin + shift and hit < len(ends) and ends[hit] == edge and edge + 2 <= whole:
                    found = (hit, k)
                    break
                if k < look:
                    edge += sum(map(len, self.leaves[k]))
            if found:
                words, last = words[: found[0]], found[1]
                break
            step *= 2
        self._put(first, last, words)

    def _put(self, first: int, last: int, words: list[str]) -> None:
        fresh = self.counter.learn([words])
        known = self.counter.known
        sizes = [fresh[w] if w in fresh else known[w] for w in words]
        tokens = sum(sizes)
        self.recoded += len(words)
        self.leaves[first], self.parts[first] = words, sizes
        self.sums[self.first + first] = sum(map(len, words)), tokens
        for k in range(first + 1, last):
            self.leaves[k], self.parts[k] = [], []
        self.sums[self.first + first + 1 : self.first + max(last, first + 1)] = 0
        low, high = self.first + first, self.first + max(last, first + 1) - 1
        while low > 1:
            low, high = low // 2, high // 2
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2].reshape(-1, 2, 2).sum(axis=1)


def kept_tree(text: str, kept: dict | None, held: Counter) -> TokenTree | None:
    """The tree of ``text`` from what ``stored`` gave; None if that is missing or of another text."""
    if not kept or kept["chars"] is None or kept["tokens"] is None or kept["crc"] != zlib.crc32(text.encode()):
        return None
    ends = np.cumsum([0, *kept["chars"]])
    if ends[-1] != len(text) or len(kept["chars"]) != len(kept["tokens"]):
        return None
    ends = ends.tolist()
    return TokenTree([text[a:b] for a, b in zip(ends, ends[1:])], kept["tokens"], held)


@lru_cache(maxsize=2)
def counter(ranks: Ranks) -> Counter:
    """One for all tasks of a Python worker."""
    return Counter(ranks)


def count(docs: DataFrame, ranks: Ranks, text: str = "text", edits: str = "edits") -> DataFrame:
    """Token counts of each document before and after its edits.

    ``edits`` is an array of (start, length, replacement): code points of the text as the
    edits before have left it; null or empty: none. A null text counts as empty, a null in
    an edit as 0 or as an empty text, and places beyond the text as its end. Returns the other
    columns, n_tokens, n_tokens_edited and n_recoded (pre-tokens encoded again), which replace
    columns of these names. Rows stay where they are; a batch bounds the memory.
    """
    added = ("n_tokens", "n_tokens_edited", "n_recoded")
    docs = docs.drop(*added)
    fields = [f for f in docs.schema.fields if f.name not in (text, edits)]
    names = [f.name for f in fields]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} bigint" for n in added])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = counter(ranks)
        cut = [held.pattern.findall(t or "") for t in batch.column(text).to_pylist()]
        fresh, known, out = held.learn(cut), held.known, []
        for words, changes in zip(cut, batch.column(edits).to_pylist()):
            tree = TokenTree(words, [known[w] if w in known else fresh[w] for w in words], held)
            before = tree.tokens
            for e in changes or ():
                if e is not None:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
            out.append((before, tree.tokens, tree.recoded))
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, *added])

    return map_arrow(docs, text, kinds, run)


_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())), ("crc", pa.int64())])
_TREE_SQL = "struct<chars: array<int>, tokens: array<int>, crc: bigint>"


def plant(docs: DataFrame, ranks: Ranks, text: str = "text", tree: str = "tree") -> DataFrame:
    """``docs`` with n_tokens and the leaves of each document's tree, two numbers for a pre-token.

    A null text counts as empty and stays null. Columns named n_tokens or like ``tree`` are replaced;
    rows stay where they are, repeated rows too.
    """
    docs = docs.drop("n_tokens", tree)
    fields = [f.name for f in docs.schema.fields]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "n_tokens bigint", f"`{tree}` {_TREE_SQL}"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grown = _grown([t or "" for t in batch.column(text).to_pylist()], counter(ranks))
        added = [pa.array([t.tokens for t in grown], pa.int64()), pa.array([t.stored() for t in grown], _TREE)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in fields), *added], [*fields, "n_tokens", tree])

    return map_arrow(docs, text, kinds, run)


def _grown(texts: list[str], held: Counter) -> list[TokenTree]:
    cut = [held.pattern.findall(t) for t in texts]
    fresh, known = held.learn(cut), held.known
    return [TokenTree(words, [known[w] if w in known else fresh[w] for w in words], held) for words in cut]


def revise(docs: DataFrame, ranks: Ranks, text: str = "text", edits: str = "edits", tree: str = "tree") -> DataFrame:
    """The edited documents: their new text and tree, n_tokens, n_tokens_edited and n_recoded.

    ``edits`` is as in ``count`` and goes; ``tree`` is what ``plant`` or an earlier call returned
    for this text. Only pre-tokens that the edits touch are cut and encoded, and n_recoded counts
    them. A tree that is null or of another text (told by checksum and length) is grown anew, and
    then all its pre-tokens count. A null text counts as empty, and stays null without edits.
    """
    added = ("n_tokens", "n_tokens_edited", "n_recoded")
    docs = docs.drop(*added)
    fields = [f for f in docs.schema.fields if f.name not in (text, edits, tree)]
    names = [f.name for f in fields]
    kinds = ", ".join([
        *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{text}` string", f"`{tree}` {_TREE_SQL}", *(f"{n} bigint" for n in added),
    ])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = counter(ranks)
        texts = batch.column(text).to_pylist()
        trees = [kept_tree(t or "", k, held) for t, k in zip(texts, batch.column(tree).to_pylist())]
        lost = [i for i, t in enumerate(trees) if t is None]
        for i, grown in zip(lost, _grown([texts[i] or "" for i in lost], held)):
            grown.recoded = sum(map(len, grown.leaves))
            trees[i] = grown
        out = []
        for old, t, changes in zip(texts, trees, batch.column(edits).to_pylist()):
            before = t.tokens
            for e in changes or ():
                if e is not None:
                    t.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
            out.append((None if old is None and not t.chars else t.text(), t.stored(), before, t.tokens, t.recoded))
        kept = zip(zip(*out), (pa.string(), _TREE, pa.int64(), pa.int64(), pa.int64()))
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, k) for c, k in kept)], [*names, text, tree, *added])

    return map_arrow(docs, text, kinds, run)
