"""Licence scan, fingerprints, sharding, quality and mixing; SQL of all queries; the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from gridwave.llm import fingerprints, license_scan, mixing, quality, sharding
from gridwave.llm.common import table
from gridwave.llm.queries import ORACLES, QUERIES, op2_document_fingerprints, op7_quality

EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "word " * 30_000, "b"), (5, "one\ntwo", "b"), (5, "one\ntwo", "b"), (None, "three", "a")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, folder, name):
    result = compare(spark, duck, folder, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


# --- licence scan


def test_notices_in_any_place(spark, edges):
    notes = [t for _, t in license_scan.NOTICES]
    filler = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"{filler[: 3 * k]} {t.upper()}\n{filler}") for k, t in enumerate(notes)]
    rows += [(100, "Licensed under the"), (101, " ".join(notes)), (101, " ".join(notes)), (102, None), (103, "x " * 50_000 + notes[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in license_scan.scan(docs, license_scan.notices(spark)).collect():
        got[r.doc_id].add(r.template_id)
        assert r.containment == 1.0 and r.first_word >= 0
    want = {k: {i} for k, (i, _) in enumerate(license_scan.NOTICES)}
    assert {k: got[k] for k in want} == want
    assert got[101] == {i for i, _ in license_scan.NOTICES} and got[103] == {"mit"} and set(got) == {*want, 101, 103}
    assert license_scan.scan(edges, license_scan.notices(spark)).count() == 0
    assert license_scan.scan(docs.limit(0), license_scan.notices(spark)).count() == 0
    assert license_scan.scan(docs, license_scan.notices(spark).limit(0)).count() == 0


def test_partial_notices(spark):
    template = spark.createDataFrame([("t", " ".join(f"a{k}" for k in range(24)))], "template_id string, text string")
    near = " ".join(f"a{k}" for k in range(21))  # 17 of 20 shingles
    far = " ".join(f"a{k}" for k in range(12))
    docs = spark.createDataFrame([(1, "x " * 9 + near + " y" * 9), (2, far), (3, far + " z" * 60 + far)], "doc_id long, text string")
    got = license_scan.scan(docs, template).collect()
    assert [(r.doc_id, r.containment, r.first_word) for r in got] == [(1, 0.85, 9)]
    with pytest.raises(Exception, match="too few words"):
        license_scan.scan(docs, template.withColumn("text", F.lit("only three words"))).collect()


# --- fingerprints


def plain_paragraphs(text):
    return set(re.findall(r"(?:[^\s]+[^\S\n]*){1,8}", text, re.A))


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(got, texts):
    order = sorted(texts, key=lambda i: -1 << 63 if i is None else i, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    for r in got:
        text, after = texts[r.doc_id], texts[following[r.doc_id]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = plain_paragraphs(text)
        assert r.near_edited == pytest.approx(share(own, plain_paragraphs(edited)))
        assert r.near_next == pytest.approx(share(own, plain_paragraphs(after)))
        assert (r.fingerprint == r.edited_fingerprint) == (own == plain_paragraphs(edited))


def test_op2(spark, folder):
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    got = op2_document_fingerprints(spark, folder).collect()
    assert len(got) == len(texts)
    check_fingerprints(got, texts)
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_fingerprints_of_odd_rows(spark, edges):
    got = fingerprints.fingerprint(edges).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in EDGES)
    check_fingerprints(got, {i: t or "" for i, t, _ in EDGES})
    assert fingerprints.fingerprint(edges.limit(0)).count() == 0
    alone = fingerprints.fingerprint(spark.createDataFrame([(9, "a b c d")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def digests(spark, texts):
    """The digest of every paragraph of the texts."""
    found = sorted(set().union(*map(plain_paragraphs, texts)))
    rows = spark.createDataFrame([(x,) for x in found], "p string").select("p", F.xxhash64("p").alias("d")).collect()
    return {r.p: r.d for r in rows}


def test_differing_digests_come_back(spark):
    base = "\n".join(f"line {k} of a text with a few words" for k in range(60))
    lines = base.split("\n")
    versions = {
        1: (base, base), 2: (base, base.replace("line 7 of", "row 7 of")), 3: (base, "\n".join(lines[:20] + ["all else is new"] + lines[40:])),
        4: ("", base), 5: ("", ""), 6: ("a b", "c d"), 7: (base, "\n".join(lines[2:])), 8: (None, "a b"), 9: (base + "\n" + lines[0], base),
    }
    rows = [(k, a, b) for k, (a, b) in versions.items()]
    pairs = spark.createDataFrame(rows + rows[:1], "k long, one string, other string")
    prints = [fingerprints.sketch_text(fingerprints.paragraphs(f"coalesce({c}, '')")).alias(f"{c}_print") for c in ("one", "other")]
    got = {r.k: r for r in fingerprints.differing(pairs.select("*", *prints), ["k"]).collect()}
    names = digests(spark, [t or "" for p in versions.values() for t in p])
    assert len(got) == len(versions)
    for k, (a, b) in versions.items():
        a, b = ({names[p] for p in plain_paragraphs(t or "")} for t in (a, b))
        assert (got[k].gone, got[k].come) == (sorted(a - b), sorted(b - a)), k
    assert all(got[k].stored for k in (1, 2, 5, 6, 7, 8, 9)) and not got[4].stored
    bare = pairs.withColumns({"one_print": F.lit(None).cast("string"), "other_print": F.lit(None).cast("string")})
    other = {r.k: r for r in fingerprints.differing(bare, ["k"]).collect()}
    assert all((other[k].gone, other[k].come, other[k].stored) == (r.gone, r.come, False) for k, r in got.items())
    assert fingerprints.differing(bare.limit(0), ["k"]).count() == 0


def test_small_sketches_give_no_wrong_digests(spark):
    rows = [(k, list(range(k * 1000, k * 1000 + 60)), list(range(k * 1000 + 5, k * 1000 + 90))) for k in range(20)]
    pairs = spark.createDataFrame(rows, "k long, one array<long>, other array<long>").repartition("k")
    want = {k: (sorted(set(a) - set(b)), sorted(set(b) - set(a))) for k, a, b in rows}
    small = fingerprints.recover(pairs, ["k"], 0.05).collect()
    assert any(r.gone is None for r in small)
    large = fingerprints.recover(pairs, ["k"], 2.0).collect()
    assert all(r.gone is None or (r.gone, r.come) == want[r.k] for r in small + large)
    # Two digests may share all their cells at one size, which a larger one tells apart.
    assert sum(r.gone is not None for r in large) >= 18


def test_small_sketches_are_tried_again(spark):
    rows = [(k, list(range(k * 1000, k * 1000 + 60)), list(range(k * 1000 + 5, k * 1000 + 90))) for k in range(20)]
    pairs = spark.createDataFrame(rows, "k long, one array<long>, other array<long>")
    first = fingerprints.attempt(pairs.repartition("k"), ["k"], 0.05).where("differ IS NULL").count()
    assert first == 20
    assert {r.differ for r in fingerprints.retry(pairs, ["k"], 0.05).collect()} == {35}


# --- sharding


def test_lookup_table_is_what_turns_give():
    shards, size = [f"s{i}" for i in range(7)], 101
    orders = [[(o + j * s) % size for j in range(size)] for o, s in (sharding.preference(x, size) for x in shards)]
    assert all(sorted(x) == list(range(size)) for x in orders)
    want, i = {}, 0
    while len(want) < size:
        want[next(s for s in orders[i % 7] if s not in want)] = i % 7
        i += 1
    got = sharding.lookup_table(shards, size)
    assert got == [want[k] for k in range(size)]
    assert max(Counter(got).values()) - min(Counter(got).values()) <= 1
    # Without one shard, its slots go to the others and most of the rest stays.
    left = sharding.lookup_table(shards[:-1], size)
    assert sum(a != b for a, b in zip(got, left) if a != 6) < 0.35 * size
    weighted = Counter(sharding.lookup_table(shards[:2], size, [3, 1]))
    assert abs(weighted[0] - 3 * weighted[1]) <= 4
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, size)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_placing(spark, edges):
    frame = edges.withColumn("shard", F.lit("old")).withColumn("slot", F.lit(-1))
    got = sharding.place(frame, ["doc_id", "source"])
    assert got.count() == len(EDGES) and set(got.columns) == set(frame.columns)
    rows = got.collect()
    assert len({(r.slot, r.shard) for r in rows if r.doc_id == 5}) == 1 and all(0 <= r.slot < sharding.SIZE for r in rows)
    assert sharding.place(frame.limit(0), ["doc_id"]).count() == 0


# --- quality


def test_trees_learn_what_a_threshold_cannot():
    draw = np.random.default_rng(0)
    x = draw.uniform(-1, 1, (3000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    # The flattened walk is the tree, row by row.
    row, total = x[0], model.base
    for t in range(len(model.feature)):
        at = 0
        for _ in range(model.depth):
            at = 2 * at + 1 + (row[model.feature[t, at]] > model.threshold[t, at])
        total += model.leaf[t, at - (2**model.depth - 1)]
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert len(quality.fit(x[:0], y[:0]).score(x)) == 3000 and quality.fit(x[:9], np.ones(9)).score(x[:1])[0] > 0.8


def test_op7_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    got = op7_quality(spark, folder).collect()
    assert len(got) == table(spark, folder, "documents").count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(judged) > 80 and sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_quality_of_odd_rows(spark, edges):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (4, 0), (7, None), (8, 3)], "doc_id long, quality int")
    model = quality.train(edges, labels)
    got = quality.score(edges.withColumn("score", F.lit("old")), model)
    assert got.count() == len(EDGES) and dict(got.dtypes)["score"] == "double"
    assert quality.score(edges.limit(0), model).count() == 0
    assert quality.train(edges.limit(0), labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == pytest.approx(0.5)


# --- mixing


def water_level(sizes: dict, weights=mixing.WEIGHTS, most=mixing.MOST) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(most * sizes[s] for s in full)
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return share | {s: float(most * sizes[s]) for s in full}
        full |= set(over)


@pytest.mark.parametrize("block", [3, 256])
def test_mix(spark, block):
    sizes = {"a": [5, 900, 1, 0], "b": [2, 3], None: [400] * 5, "c": [70], "d": [0]}
    rows = [(100 * k + i, "w " * n, s) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)] + [(1, None, "a"), (0, "x y", "a")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("taken", F.lit("old")).withColumn("sid", F.lit("mine"))
    out = mixing.mix(docs, block=block)
    got = out.collect()
    assert len(got) == len(rows) and "text" not in out.columns and {r.sid for r in got} == {"mine"}
    whole = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes}
    want = water_level(whole)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == whole[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), block=block).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    copies = mixing.plan_copies(docs, block=block)
    assert copies.columns == docs.columns


def test_every_stretch_of_the_schedule_is_mixed(spark):
    sizes = spark.createDataFrame([("a", 600_000), ("b", 300_000), ("c", 300_000)], "source string, size long")
    mixed = mixing.sources(sizes)
    rows = mixing.schedule(mixed, block=100).orderBy("slot").collect()
    shares = {r.sid: r.need / r.total for r in mixed.collect()}
    for start in range(0, len(rows) - 600, 500):
        part = Counter(r.sid for r in rows[start : start + 500])
        assert all(abs(part[s] / 500 - share) < 0.02 for s, share in shares.items())
    for s in shares:
        ranks = [r["rank"] for r in rows if r.sid == s]
        assert ranks == list(range(len(ranks)))


# --- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    assert 4 <= len(p.STAGES) <= 5
    before = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in table(spark, folder, "labels").where("quality = 0").collect()}
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= set(before) and (k == 3 or len(ids) == len(set(ids)))
        if k == 0:
            assert len(bad & set(ids)) < 0.1 * len(bad) and len(ids) > 0.8 * len(before)
    last = p.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == docs.count() and all(r.n_tokens == len(r.ids) for r in last)


def test_pipeline_of_no_rows_and_odd_rows(spark, edges, folder):
    import corpus_pipeline as p

    odd = edges.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source", "CAST(1 AS bigint) AS n_chars")
    for docs in (odd.limit(0), odd):
        for _, stage in p.STAGES:
            assert stage(spark, docs, folder).count() <= 3 * docs.count()
