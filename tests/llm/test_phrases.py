"""Collocations against counting by hand, tries against counters, the filter audit against all orders in turn."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from gridwave.llm import collocations, filter_audit
from gridwave.llm.bitmaps import local_bitmap
from gridwave.llm.queries import ORACLES, QUERIES

LETTERS = {k: k + 32 for k in range(65, 91)}


def phrases(rows, min_count, max_words, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LETTERS)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        often = {p: f for p, f in found.items() if f >= min_count}
        inside = Counter()
        for p, f in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], f)
        scored = []
        for p, a in often.items():
            if len(p) > 1 and inside[p] < a:
                score, cut = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), found[p[:cut]], found[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made_up():
    draw = random.Random(3)
    words = ["the", "of", "New", "York", "aé", "Été", "x", "y", "z"] + [f"w{k}" for k in range(12)]
    rows = []
    for k in range(120):
        text = " ".join(draw.choices(words, k=draw.randint(0, 60)))
        text += draw.choice(["", "\nNew  York City, state of the art", "\tthe end of the world; of the world", " one two three four five six"])
        rows.append((draw.choice(["en", "fr", None]), text))
    return [*rows, rows[0], rows[0], ("en", None), ("de", ""), ("", "a b a b a b a b"), ("xx", "q " * 5000)]


@pytest.mark.parametrize("min_count, top", [(2, 10_000), (5, 7), (40, 3)])
def test_collocations(spark, min_count, top):
    rows = made_up()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("x"), "prefix": F.lit(1), "n": F.lit(2), "f": F.lit(3)})
    assert rows_of(collocations.collocations(docs, min_count, 5, top)) == phrases(rows, min_count, 5, top)


def test_two_words_at_most_and_no_rows(spark):
    rows = made_up()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(collocations.collocations(docs, 4, 2, 50)) == phrases(rows, 4, 2, 50)
    assert collocations.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most_ids", [60_000, 30, 6])
def test_many_spills(spark, most_ids):
    """Tries that hold next to nothing, burst at once and run out of ids count the same."""
    rows = [(lang or "und", text or "") for lang, text in made_up()]
    docs = spark.createDataFrame(rows, "lang string, text string")
    frequent = collocations.Bits(spark, local_bitmap(collocations.word_counts(docs), ["lang", "phrase"]))
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n]", text.translate(LETTERS)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            want.update((lang, " ".join(words[i : i + k])) for k in (2, 3, 4) for i in range(len(words) - k + 1))
    got = collocations.phrase_counts(docs, 2, 4, 1, frequent, capacity=40, burst=2, most_ids=most_ids).collect()
    assert {(r.lang, r.phrase): r.f for r in got} == want and len(got) == len(want)
    often = collocations.phrase_counts(docs, 2, 4, 6, frequent, most_ids=most_ids).collect()
    assert {(r.lang, r.phrase): r.f for r in often} == {k: v for k, v in want.items() if v >= 6}
    # What buckets keep back is rare, and hardly anything rare passes.
    for n in (2, 3):
        buckets = collocations.bucket_bitmap(docs, n, 5, frequent, most_ids=most_ids, held=50)
        kept = collocations.phrase_counts(docs, n, n, 1, frequent, *([buckets] if n == 2 else [None, None, buckets]), most_ids=most_ids).collect()
        often = {k: v for k, v in want.items() if k[1].count(" ") == n - 1 and v >= 5}
        assert {(r.lang, r.phrase): r.f for r in kept} == often


def test_trie():
    draw = random.Random(4)
    for burst in (0, 3, 20, 1000):
        trie, want = collocations.HatTrie(burst), Counter()
        for _ in range(40):
            n = draw.randint(2, 5)
            ids = np.array([draw.randint(1, 5) for _ in range(80)])
            starts = np.arange(len(ids) - n + 1)
            trie.add(ids[starts], collocations.pack(ids, starts, n))
            want.update(tuple(ids[i : i + n].tolist()) for i in starts)
        assert trie.size == len(want) == sum(trie.sizes.values())
        gone, got = trie.largest(trie.size // 2), Counter()
        assert 0 < len(gone) < 5

        def take(firsts):
            for first in firsts:
                keys, counts = trie.take(first)
                assert (np.diff(keys.astype(object)) > 0).all()
                for key, n in zip(keys, counts):
                    rest = [int(collocations.unpack(np.array([key]), j)[0]) for j in range(4)]
                    got[(first, *[k for k in rest if k])] += int(n)

        take(gone)
        assert trie.size <= len(want) // 2
        take(trie.largest(0))
        assert got == want and trie.size == 0


# --- filter audit


def audited(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    heads = {}
    for d, text, _ in docs:
        if d is not None:
            heads[text or ""] = min(d, heads.get(text or "", d))
    fails = defaultdict(list)
    for d, text, lang in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": bool(set(text) & set("#$%&*|")),
            "E": d is not None and heads[text] < d,
        }
        fails[lang or ""].append(({k for k, v in failed.items() if v}, d in good and d is not None, d in toxic and d is not None))
    out = []
    for part, rows in fails.items():
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                failing = sum(letter in r[0] for r in rows)
                alone = sum(r[0] == {letter} for r in rows)
                steps.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)])
        shapley = Counter()
        for s in steps:
            shapley[s[1][s[2] - 1]] += s[4]
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit(spark):
    draw = random.Random(5)
    words = [f"word{k}" for k in range(400)]
    docs = []
    for k in range(150):
        text = " ".join(draw.sample(words, draw.choice([5, 199, 200, 250])))
        text = draw.choice([text, text + " " + text, text + " " + text[:-1] + " " + text, text.upper(), "#" + text, "A " * 3 + text])
        docs.append((k, text, draw.choice(["en", "fr", None, ""])))
    docs += [(200 + k, draw.choice(docs)[1], draw.choice(["en", "fr"])) for k in range(60)]
    docs += [(300, None, "en"), (301, "", "en"), (302, "", "xx"), (5, docs[5][1], "fr"), (5, docs[7][1], "fr"), (None, docs[9][1], "en"), (None, docs[9][1], "en"),
             (303, "ÉÉÉ A" * 9, "yy"), (304, "x\x0by " * 70_000, "yy"), (305, " ".join("ab"), "yy")]
    labels = [(d, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for d in range(0, 320, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, 1, 0), (999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit(1), "mask": F.lit(2), "good": F.lit(3), "h": F.lit(4)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame, marks)
    assert sorted(map(tuple, got.collect())) == audited(docs, labels)
    assert sorted(map(tuple, filter_audit.audit(frame.repartition(7), marks.repartition(3)).collect())) == audited(docs, labels)
    assert sorted(map(tuple, filter_audit.audit(frame, marks.limit(0)).collect())) == audited(docs, [])
    assert filter_audit.audit(frame.limit(0), marks).count() == 0


@pytest.mark.parametrize("name", ["op12_phrase_collocations", "op13_filter_audit"])
def test_sql_at_the_larger_size(spark, name):
    from compare import connect

    large = "/root/testdata/sf0.01"
    result = compare(spark, connect(large), large, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result
