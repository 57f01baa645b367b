"""Packing: pieces against the tokenizer, the reduction against best solutions, places without gaps."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridwave.llm import packing
from gridwave.llm.queries import op11_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(docs, capacity):
    """(doc_id, piece, start, length, crc) by the library itself, one text at a time."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check(rows, docs, capacity):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == expected(docs, capacity)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def by_the_piece(sizes, capacity):
    """Best fit, largest first, one piece at a time: the number of sequences."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= s
        else:
            room.append(capacity - s)
    return len(room)


def fewest(sizes, capacity):
    """The least number of sequences, by trying everything."""

    @cache
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]

        def fill(room, rest, i):
            """All maximal and smaller fillings of the sequence that holds the first piece."""
            yield rest
            for k in range(i, len(rest)):
                if rest[k] <= room and (k == i or rest[k] != rest[k - 1]):
                    yield from fill(room - rest[k], rest[:k] + rest[k + 1 :], k)

        return 1 + min(best(r) for r in set(fill(capacity - first, rest, 0)))

    return best(tuple(sorted(sizes, reverse=True)))


def held(patterns):
    out = Counter()
    for pattern, times in patterns:
        for s, k in pattern:
            out[s] += k * times
    return out


def test_reduction_keeps_a_best_solution():
    draw = random.Random(1)
    some = 0
    for _ in range(400):
        capacity = draw.choice([10, 17, 30, 60])
        low = draw.choice([1, 1, 2, capacity // 5 + 1, capacity // 4 + 1, capacity // 3 + 1])
        sizes = [draw.randint(low, capacity * 3 // 4) for _ in range(draw.randint(4, 12))]
        counts = Counter(sizes)
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        assert held(fixed) + Counter(rest) == counts
        assert all(sum(s * k for s, k in p) <= capacity for p, _ in fixed)
        n_fixed = sum(t for _, t in fixed)
        assert n_fixed + fewest(Counter(rest).elements(), capacity) == fewest(sizes, capacity)
        some += bool(rest) and n_fixed > 0
    assert some > 20


def test_best_fit_at_once_is_best_fit_by_the_piece():
    draw = random.Random(2)
    for _ in range(200):
        capacity = draw.choice([10, 64, 100])
        sizes = [min(capacity, 1 + int(draw.expovariate(6 / capacity))) for _ in range(draw.randint(0, 120))]
        patterns = packing.best_fit(Counter(sizes), capacity)
        assert held(patterns) == Counter(sizes) and all(sum(s * k for s, k in p) <= capacity for p, _ in patterns)
        assert sum(t for _, t in patterns) == by_the_piece(sizes, capacity)


def test_many_equal_pieces():
    counts = {1: 10**9, 2: 3, 1500: 10**8, 4096: 7, 2596: 10**8 - 5, 2597: 11}
    patterns = packing.solve(counts)
    assert held(patterns) == Counter(counts) and len(patterns) < 40
    total = sum(t for _, t in patterns)
    assert total <= -(-sum(s * n for s, n in counts.items()) // 4096) * 1.01


def test_op11(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = op11_best_fit_packing(spark, folder).collect()
    n = check(rows, docs, 4096)
    sizes = [r.length for r in rows]
    assert n <= by_the_piece(sizes, 4096) and n <= -(-sum(sizes) // 4096) + 1


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word " * 3000), (5, "one\ntwo"), (5, "one\ntwo"), (5, "three"), (None, "three"), (None, None),
    (6, "don't it's WE'LL 'S x'vex café café ́ ΣΣ İstanbul  a b\x1cc\x85d"),
    (7, "<|startoftext|> a<|endoftext|>b"), (8, "x" * 9000 + " " + "我" * 500), (9, "a\rb\x0bc\x0cd  e"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"length": F.lit("x"), "rank": F.lit(1), "lane": F.lit(2), "sequence_id": F.lit(3)})
    rows = packing.pack(docs, PATH, 64).collect()
    plain = [(d, t) for d, t in ODD if d != 7]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id != 7), key=repr) == expected(plain, 64)
    again = packing.pack(docs.repartition(5), PATH, 64).collect()
    assert sorted(rows, key=repr) == sorted(again, key=repr)
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("capacity", [1, 3])
def test_small_capacities(spark, capacity):
    docs = [(k, "a b c d e"[: 2 * k]) for k in range(5)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, capacity).collect()
    check(rows, docs, capacity)
