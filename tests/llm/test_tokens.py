"""Byte-level BPE, token counts and their edits, against tiktoken."""

from __future__ import annotations

import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwave.llm import bpe, token_counts
from gridwave.llm.queries import VOCABULARY, op4_byte_bpe, op8_token_counts

LETTERS = st.sampled_from(list("ab cd'  \n\tsrelvm 12.-_*éÉ漢字😀\x1c\x85 …"))
TEXTS = st.text(LETTERS, max_size=60)


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("own", pat_str=VOCABULARY.pattern, mergeable_ranks=bpe.load(VOCABULARY.path), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(VOCABULARY, cache=50)


@given(texts=st.lists(TEXTS, max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_is_tiktoken(peer, encoder, texts):
    ids, starts = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [peer.encode_ordinary(t) for t in texts]


def test_long_runs(peer, encoder):
    texts = ["a" * 3000, " " * 500 + "x", "\n" * 300, "ab" * 2000 + " ." * 100, "", None]
    ids, starts = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [peer.encode_ordinary(t or "") for t in texts]


def test_lower_rank_comes_up_later(tmp_path):
    # "bc" is formed first; its merge with "a" ranks below it and must come before the second "bc".
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 0, b"bc": 5, b"bcbc": 4}
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    peer = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = [b"abcbc", b"bcbcbc", b"abcabcbc", b"cba"]
    ids, sizes = bpe.replay(words, str(path))
    ends = sizes.cumsum()
    assert [ids[e - n : e].tolist() for n, e in zip(sizes, ends)] == [peer.encode_ordinary(w.decode()) for w in words]


def test_encode_and_decode_tables(spark, peer):
    rows = [(1, "héllo wörld", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, "long " * 5000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    assert sorted((r.doc_id, r.ids, bytes(r.decoded).decode()) for r in out) == sorted(
        (i, peer.encode_ordinary(t or ""), t or "") for i, t, _ in rows
    )
    assert bpe.decode(bpe.encode(docs.limit(0), VOCABULARY), VOCABULARY).count() == 0
    nulls = spark.sql("SELECT CAST(NULL AS array<int>) AS ids UNION ALL SELECT array(0, 1)")
    assert sorted(len(r.decoded) for r in bpe.decode(nulls, VOCABULARY).collect()) == [0, 2]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.sql("SELECT array(-1) AS ids"), VOCABULARY).collect()


def test_op4(spark, folder, peer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op4_byte_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = peer.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@given(text=TEXTS, edits=st.lists(st.tuples(st.integers(0, 70), st.integers(0, 30), st.text(LETTERS, max_size=12)), max_size=5))
@settings(max_examples=400, deadline=None)
def test_edits_are_as_if_counted_anew(peer, text, edits):
    held = token_counts.counter(VOCABULARY)
    words = held.pattern.findall(text)
    fresh = held.learn([words])
    tree = token_counts.TokenTree(words, [fresh.get(w, held.known.get(w)) for w in words], held)
    assert tree.tokens == len(peer.encode_ordinary(text))
    for start, length, new in edits:
        tree.edit(start, length, new)
        start = min(start, len(text))
        text = text[:start] + new + text[start + length :]
        assert tree.text() == text and tree.chars == len(text)
        assert [w for leaf in tree.leaves for w in leaf] == held.pattern.findall(text)
        assert tree.tokens == len(peer.encode_ordinary(text))


def test_an_edit_recodes_little(peer):
    held = token_counts.counter(VOCABULARY)
    draw = random.Random(1)
    text = " ".join("".join(draw.choices("abcdef", k=5)) for _ in range(20_000))
    words = held.pattern.findall(text)
    held.learn([words])
    tree = token_counts.TokenTree(words, [held.known[w] for w in words], held)
    tree.edit(60_000, 5, " new words")
    assert tree.recoded < 20
    assert tree.tokens == len(peer.encode_ordinary(text[:60_000] + " new words" + text[60_005:]))


def test_count_table(spark):
    schema = "doc_id long, text string, edits array<struct<start: long, length: long, replacement: string>>, n_tokens string"
    rows = [
        (1, "one two three", [(4, 3, "2")], "x"), (2, None, [(5, 9, "added"), None], "x"), (3, "", None, "x"),
        (4, "same", [], None), (4, "same", [], None), (5, "cut", [(None, 99, None)], "x"),
    ]
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in token_counts.count(docs, VOCABULARY).collect()}
    size = lambda t: len(bpe.Encoder(VOCABULARY).encode([t])[0])
    assert got[1] == (size("one two three"), size("one 2 three"))
    assert got[2] == (0, size("added")) and got[3] == (0, 0) and got[5] == (size("cut"), 0)
    assert got[4] == (size("same"),) * 2
    assert token_counts.count(docs.limit(0), VOCABULARY).count() == 0


@given(text=TEXTS, rounds=st.lists(st.lists(st.tuples(st.integers(0, 70), st.integers(0, 30), st.text(LETTERS, max_size=12)), max_size=3), max_size=4))
@settings(max_examples=200, deadline=None)
def test_kept_trees_are_as_if_never_put_away(peer, text, rounds):
    held = token_counts.counter(VOCABULARY)
    kept = token_counts._grown([text], held)[0].stored()
    for edits in rounds:
        tree = token_counts.kept_tree(text, kept, held)
        for start, length, new in edits:
            tree.edit(start, length, new)
            start = min(start, len(text))
            text = text[:start] + new + text[start + length :]
        assert (tree.text(), tree.tokens) == (text, len(peer.encode_ordinary(text)))
        kept = tree.stored()
        assert kept == token_counts._grown([text], held)[0].stored()


def test_revise_recodes_what_edits_touch(spark, peer):
    size = lambda t: len(peer.encode_ordinary(t))
    long = "some words of a long text, 12 of them. " * 500
    docs = spark.createDataFrame([(1, long, "x"), (2, None, "y"), (3, "", "z"), (4, "same", "v"), (4, "same", "v")], "doc_id long, text string, tree string")
    planted = token_counts.plant(docs, VOCABULARY)
    assert sorted((r.doc_id, r.n_tokens) for r in planted.collect()) == [(1, size(long)), (2, 0), (3, 0), (4, size("same")), (4, size("same"))]
    kind = "array<struct<start: long, length: long, replacement: string>>"

    def edit(doc, changes):
        rows = spark.createDataFrame([(1, changes), (4, [(None, 1, None), None])], f"e_id long, edits {kind}")
        return doc.join(rows, doc.doc_id == rows.e_id, "left").drop("e_id")

    once = token_counts.revise(edit(planted, [(9000, 5, " new"), (10, 0, "!")]), VOCABULARY)
    text = long[:9000] + " new" + long[9005:]
    text = text[:10] + "!" + text[10:]
    got = {r.doc_id: r for r in once.collect()}
    assert (got[1].text, got[1].n_tokens, got[1].n_tokens_edited) == (text, size(long), size(text)) and 0 < got[1].n_recoded < 20
    assert (got[2].text, got[2].n_tokens_edited, got[2].n_recoded) == (None, 0, 0) and got[3].text == "" and got[4].text == "ame"
    twice = token_counts.revise(edit(once, [(len(text), 0, " end")]), VOCABULARY)
    got = {r.doc_id: r for r in twice.collect()}
    assert (got[1].text, got[1].n_tokens, got[1].n_tokens_edited) == (text + " end", size(text), size(text + " end")) and 0 < got[1].n_recoded < 10
    # A tree of another text, or none, is grown anew.
    for wrong in (F.lit("other"), F.concat("text", F.lit("s"))):
        stale = token_counts.revise(planted.where("doc_id = 4").withColumns({"text": wrong, "edits": F.lit(None).cast(kind)}), VOCABULARY).first()
        assert (stale.n_tokens, stale.n_recoded) == (size(stale.text), 1)
    none = planted.withColumns({"tree": F.lit(None).cast(token_counts._TREE_SQL), "edits": F.lit(None).cast(kind)})
    assert sorted(r.n_tokens for r in token_counts.revise(none, VOCABULARY).collect()) == sorted([size(long), 0, 0, size("same"), size("same")])
    assert token_counts.revise(none.limit(0), VOCABULARY).count() == 0


def test_op8(spark, folder, peer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op8_token_counts(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        third, two = len(t) // 3, len(t) * 2 // 3
        e = t[:third] + t[:20] + t[third + 12 :]
        e = e[:two] + " revised " + e[two:]
        assert (r.n_tokens, r.n_tokens_edited) == (len(peer.encode_ordinary(t)), len(peer.encode_ordinary(e)))
