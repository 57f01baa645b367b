"""Components, SimHash, embeddings and lines, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridwave.llm import components, embedding_dedup, line_dedup, simhash_dedup
from gridwave.llm.bitmaps import likely
from gridwave.llm.common import keep_table, shared_folder
from gridwave.llm.queries import op3_embedding_dedup, op6_simhash_dedup, op9_line_dedup


def groups(n: int, links) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(160)]
    links += [(k, k + 1) for k in range(300, 420)] + [(500, k) for k in range(430, 480)] + [(7, 7)]
    want = groups(501, links)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {x: want[x] for p in links for x in p if p[0] != p[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bucket_components_lose_no_link(spark):
    # One bucket: a chain of near numbers, far ones, and two that only meet each other.
    ids = [0, 1, 2, 3, 50, 51, 90, 91, 200]
    buckets = spark.createDataFrame([(1, i) for i in ids] + [(2, 200), (2, 50)], "key long, id long")
    near = lambda pairs: pairs.where("b - a <= 1 AND a - b <= 1")
    got = {r.id: r.component for r in components.bucket_components(buckets, near).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 50: 50, 51: 50, 90: 90, 91: 90}


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(texts):
    prints = [plain_print(t) for t in texts]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    return prints, groups(len(prints), links)


def test_simhash_links_by_bits(spark):
    draw = random.Random(5)
    base = [draw.getrandbits(64) - (1 << 63) for _ in range(40)]
    prints = base + [b ^ (1 << draw.randrange(63)) for b in base] + [b ^ (1 << draw.randrange(63)) ^ (1 << draw.randrange(63)) for b in base]
    prints = list(dict.fromkeys(prints))
    frame = spark.createDataFrame([(p,) for p in prints], "id long")
    got = {r.id: r.component for r in components.bucket_components(simhash_dedup.byte_index(frame), simhash_dedup.close).collect()}
    links = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) % (1 << 64)).bit_count() <= 2]
    want = defaultdict(set)
    for p, g in zip(prints, groups(len(prints), links)):
        want[g].add(p)
    have = defaultdict(set)
    for p in prints:
        have[got.get(p, p)].add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_simhash_edges(spark):
    rows = [(3, None, 1), (1, "", 1), (2, " \n", 1), (4, "ÀB one two three", 1), (9, "Àb ONE two three", 1), (None, "zz y x w", 1),
            (7, "word " * 40_000, 1), (7, "word " * 40_000, 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.classes(docs).collect()]
    assert len(got) == len(rows)
    by = {i: (f, c) for i, f, c in got if i is not None}
    assert by[1] == by[2] == by[3] == (0, 1)
    assert by[4] == by[9] and by[4][1] == 4 and by[7][1] == 7
    assert (None, 0, 1) in got and any(i is None and c is None for i, _, c in got)
    assert simhash_dedup.classes(docs.limit(0)).count() == 0
    kept = simhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 7, None, None]


def test_op6(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    prints, want = simhash_groups([d.text for d in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash_dedup(spark, folder).collect()}
    assert got == {d.doc_id: (f"{p:016x}", docs[g].doc_id) for d, p, g in zip(docs, prints, want)}


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(1)
    x = draw.standard_normal((400, 64))
    q = x + 0.4 * draw.standard_normal(x.shape)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    codes, factors = embedding_dedup.encode(x)
    turned = unit(q) @ embedding_dedup.rotation(64).T
    got = np.diag(embedding_dedup.estimates(turned, codes, factors))
    real = (unit(x) * unit(q)).sum(axis=1)
    assert abs((got - real).mean()) < 0.01 and (real - got <= embedding_dedup.slack(factors, 64, real.min())).all()


@pytest.mark.parametrize("block", [7, 8192])
def test_embeddings(spark, block):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((12, 16))
    rows = []
    for k in range(90):
        v = base[k % 12] + 0.16 * draw.standard_normal(16)
        rows.append((k, [float(np.float32(a)) for a in v], k % 3 if k % 10 else None))
    rows += [(100 + k, rows[1][1], rows[1][2]) for k in range(30)] + [(131, [2 * a for a in rows[1][1]], rows[1][2])]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] + [1.0] * 15, 1), (204, [None] + [1.0] * 15, 1),
             (205, [1.0, 0.0], 1), (206, [1.0, 0.0], 1), (207, [float("inf")] * 16, 1), (None, rows[1][1], rows[1][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.vec_id): (r.n_links, r.component_id, r.kept) for r in embedding_dedup.groups(frame, block=block).collect()}
    usable = lambda v: v and None not in v and np.isfinite(v).all() and np.any(v)
    links = defaultdict(set)
    for i, (a, x, m) in enumerate(rows):
        for b, y, n in rows[:i]:
            if None in (m, n, a, b) or m != n or not usable(x) or not usable(y) or len(x) != len(y):
                continue
            x_, y_ = np.array(x, float), np.array(y, float)
            if x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= 0.93:
                links[a].add(b), links[b].add(a)
    ids = [r[0] for r in rows if r[0] is not None]
    want = groups(300, [(a, b) for a in links for b in links[a]])
    assert got == {i: (len(links[i]), want[i], want[i] == i) for i in ids} | {None: (0, None, True)}


def test_embeddings_of_no_rows(spark):
    assert embedding_dedup.groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_op3_rows(spark, folder):
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    got = op3_embedding_dedup(spark, folder).collect()
    assert len(got) == n and sum(r.kept for r in got) <= n


def line_heads(docs, similarity=line_dedup.SIMILARITY):
    """(doc, line number) of the line that stands for each line."""
    places = {(i, k): x for i, t in docs if t is not None for k, x in enumerate(t.split("\n"))}
    first = {}
    for p in sorted(places, reverse=True):
        first[places[p]] = p
    # Blank lines stand for themselves; one below a shingle is alike to its copies only.
    long = sorted((x for x in first if x.strip()), key=lambda x: first[x])
    sets = [{x[i : i + 4] for i in range(len(x) - 3)} if len(x) > 3 else {x} for x in long]
    links = [
        (i, j) for i in range(len(long)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])
    ]
    head = {long[i]: first[long[g]] for i, g in enumerate(groups(len(long), links))}
    return {p: head.get(x, p) for p, x in places.items()}


def test_lines(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    text = " ".join(word() for _ in range(40))
    near = [text.replace(text.split()[k], word()) for k in range(0, 40, 3)]
    docs = [(1, text + "\nshort\n" + near[0]), (2, "\n".join(near)), (3, None), (4, ""), (5, "short\n\nshort"), (6, text), (6, text),
            (8, " ".join(word() for _ in range(30_000))), (9, near[3] + "x" + "\n" + text[::-1])]
    frame = spark.createDataFrame([(*d, "a") for d in docs], "doc_id long, text string, line string")
    got = {(r.doc_id, r.line_no): (r.component_doc_id, r.component_line_no) for r in line_dedup.decide(frame).collect()}
    want = line_heads(docs)
    assert got == want
    out = {r.doc_id: (r.text, r.n_removed, r.line) for r in line_dedup.dedup(frame).collect()}
    assert out[6] == ("", 1, "a") and out[3] == (None, 0, "a") and out[5] == ("", 2, "a")
    assert out[1][0] == "\n".join(x for k, x in enumerate(docs[0][1].split("\n")) if want[1, k] == (1, k))
    assert line_dedup.decide(frame.limit(0)).count() == 0


def test_null_ids_of_lines(spark):
    line = "a line that is long enough to be compared with others"
    frame = spark.createDataFrame([(None, line), (5, line)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_doc_id), r.kept) for r in line_dedup.decide(frame).collect())
    assert got == [("5", "None", False), ("None", "None", True)]


def test_bitmap_has_all_it_was_made_of(spark):
    rows = spark.range(5000).select("id", (F.col("id") * 7).alias("b"))
    seen = {r.id for r in likely(rows, ["id", "b"], rows.where("id % 50 = 0")).collect()}
    assert {i for i in range(0, 5000, 50)} <= seen and len(seen) < 110


def test_op9(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {(r.doc_id, r.line_no): (r.component_doc_id, r.component_line_no) for r in op9_line_dedup(spark, folder).collect()}
    want = line_heads(docs)
    # MinHash may miss a pair, and nothing else: no line joins others than it should, nearly all join all they should.
    assert set(got) == set(want) and all(want[p] == want[h] for p, h in got.items())
    fuzzy = [p for p in want if want[p] != p]
    assert len(fuzzy) > 100 and sum(got[p] == want[p] for p in fuzzy) >= 0.99 * len(fuzzy)


def test_lines_of_repeated_ids(spark):
    """Rows of one id with other texts lose their own copied lines alone."""
    a, b, c = ("a line that two of the rows share", "a line that is nowhere else in here", "and another one that stands alone")
    rows = [(1, f"{a}\nfirst"), (2, f"{a}\n{b}"), (2, f"{c}\n{a}"), (2, f"{c}\n{a}"), (None, a), (None, f"{b}x\n{c}yz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(line_dedup.dedup(frame).select("doc_id", "text", "n_removed").collect(), key=str)
    # The null id comes first, so its lines are kept; equal rows are one document.
    texts = sorted((str(r.doc_id), r.text, r.n_removed) for r in out)
    assert texts == sorted([("1", "first", 1), ("2", "", 2), ("2", "", 2), ("2", "", 2), ("None", a, 0), ("None", f"{b}x\n{c}yz", 0)])


def test_buckets_of_many_near_copies(spark):
    """Ten thousand changed copies of one line in shared buckets: pairs grow with the members, not with their square."""
    base = [f"w{k:03d}" for k in range(60)]
    rows = [(0, base), *[(k, [*base[: k % 60], f"x{k}", *base[k % 60 + 1 :]]) for k in range(1, 4000)], *[(4000 + k, [f"y{k}_{j}" for j in range(9)]) for k in range(50)]]
    sets = dict(rows)
    members = spark.createDataFrame([(key, k, [0]) for k in sets for key in (1, 2, k % 7 + 3) if k < 4000 or key == 1], "key long, id long, sig array<int>").distinct()
    seen = []

    def measure(pairs):
        found = [(r.a, r.b) for r in pairs.collect()]
        assert len(set(found)) == len(found) and all(a < b for a, b in found)
        seen.append(len(found))
        told = [(a, b, len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})) for a, b in found]
        return spark.createDataFrame(told, "a long, b long, j double")

    got = {r.id: r.component for r in components.linked_components(members, "size({x}) = size({y})", measure, 0.96).collect()}
    assert {got.get(k, k) for k in range(4000)} == {0} and all(got.get(k, k) == k for k in sets if k >= 4000)
    assert sum(seen) < 10 * members.count()


def test_links_across_heads(spark):
    """Two members that no head is linked with find each other, and so do members of different heads' components."""
    draw = random.Random(6)
    for _ in range(3):
        points = {k: draw.random() for k in range(80)}
        near = 0.03
        members = spark.createDataFrame([(key, k, [0]) for k in points for key in (0, 1 + k % 3)], "key long, id long, sig array<int>")

        def measure(pairs, points=points):
            told = [(r.a, r.b, 1 - abs(points[r.a] - points[r.b])) for r in pairs.collect()]
            return spark.createDataFrame(told, "a long, b long, j double")

        got = {r.id: r.component for r in components.linked_components(members, "size({x}) = size({y})", measure, 1 - near).collect()}
        ids = sorted(points)
        links = [(i, j) for i in ids for j in ids if j < i and 1 - abs(points[i] - points[j]) >= 1 - near]
        want = groups(len(ids), links)
        assert [got.get(k, k) for k in ids] == want


def test_sketches_lose_no_link(spark):
    """Sketches count distinct shingles, pass every pair of similarity 0.8 and tell most pairs far below it apart."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdef", k=draw.randrange(2, 7)))
    rows = [(0, "abcd"), (1, "aaaaaaaaaa"), (2, "aaaaaaaaaaaa")]
    for k in range(12):
        base = [word() for _ in range(8 * (k + 1))]
        for _ in range(6):
            rows.append((len(rows), " ".join(word() if draw.random() < 0.07 else w for w in base)))
    made = line_dedup.sketches(spark.createDataFrame(rows, "id long, line string"))
    x, y = made.select(F.col("id").alias("a"), F.col("sig").alias("x")), made.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    told = x.join(y, F.expr("a < b")).select("a", "b", F.col("x.n").alias("n"), F.expr(line_dedup.may_link(0.8).format(x="x", y="y")).alias("may"))
    sets = {i: {t[k : k + 4] for k in range(len(t) - 3)} for i, t in rows}
    seen = [(len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b]), r.n == len(sets[r.a]), r.may) for r in told.collect()]
    assert len(seen) == len(rows) * (len(rows) - 1) // 2 and all(same for _, same, _ in seen)
    assert all(may for j, _, may in seen if j >= 0.8) and sum(j >= 0.8 for j, _, _ in seen) > 10
    far = [may for j, _, may in seen if j < 0.7]
    assert sum(far) < 0.02 * len(far)


def test_signatures_are_not_kept_for_each_bucket(spark):
    """Ids in eight buckets of strangers each: what is written is less than half a signature for each place in a bucket."""
    n = 10_000
    sig = F.array(*[F.xxhash64("id", F.lit(j)) for j in range(16)])
    keys = F.array(*[F.expr(f"pmod(xxhash64(id, {b}), {n // 4}) * 8 + {b}") for b in range(8)])
    members = spark.range(0, n, 1, 4).select(F.explode(keys).alias("key"), "id", sig.alias("sig"))
    measure = lambda pairs: pairs.withColumn("j", F.lit(0.0))
    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.rglob("*.parquet"))
    got = components.linked_components(members, "{x}[0] = {y}[0]", measure, 0.8).where("id <> component")
    assert got.count() == 0
    assert sum(p.stat().st_size for p in set(root.rglob("*.parquet")) - before if p.is_file()) < 16 * 8 * 8 * n / 2


def test_marks_lose_no_link(spark):
    """Marks, sketches of long lines and both together pass every pair of similarity 0.8 and tell most pairs far below it apart."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefghijkl", k=draw.randrange(2, 7)))
    rows = [(0, "abcd"), (1, "aaaaaaaaaa"), (2, "aaaaaaaaaaaa"), (3, "日本語日本語"), (4, "ab 😀 cd 😀 ab")]
    for k in (8, 20, 60, 150, 240, 250, 260):
        base = [word() for _ in range(k)]
        for _ in range(6):
            rows.append((len(rows), " ".join(word() if draw.random() < 0.06 else w for w in base)))
    lengths = [len(t) > line_dedup.MARKED for _, t in rows]
    assert 10 < sum(lengths) < len(rows) - 20
    made = line_dedup.sifters(spark.createDataFrame(rows, "id long, line string"))
    x, y = made.select(F.col("id").alias("a"), F.col("sig").alias("x")), made.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    told = x.join(y, F.expr("a < b")).select("a", "b", F.expr(line_dedup.may_link_any(0.8).format(x="x", y="y")).alias("may"))
    sets = {i: {t[k : k + 4] for k in range(len(t) - 3)} for i, t in rows}
    seen = [(len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b]), r.may, lengths[r.a] != lengths[r.b]) for r in told.collect()]
    assert len(seen) == len(rows) * (len(rows) - 1) // 2
    assert all(may for j, may, _ in seen if j >= 0.8) and sum(j >= 0.8 for j, _, _ in seen) > 10
    far = [may for j, may, mixed in seen if j < 0.4 and not mixed]
    assert sum(far) < 0.02 * len(far)


def test_lines_that_met_by_accident_go_first(spark):
    """Lines of the same syllables share bands by accident: they are no candidates, alike lines that share a band all are."""
    draw = random.Random(10)
    syllables = ["".join(draw.choices("abcdefghijklmnop", k=2)) for _ in range(12)]
    word = lambda: "".join(draw.choices(syllables, k=3))
    rows = [" ".join(word() for _ in range(70)) for _ in range(1200)]
    for k in range(60):
        rows.append(" ".join(word() if draw.random() < 0.05 else w for w in rows[k].split()))
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "doc_id long, text string")
    first = keep_table(line_dedup.signed_lines(docs))
    met = {r.id for r in line_dedup.candidates(first).select("id").distinct().collect()}
    signed = {r.doc: r for r in first.collect()}
    sets = [{x[i : i + 4] for i in range(len(x) - 3)} for x in rows]
    share = lambda a, b: any(x == y for x, y in zip(signed[a].bands, signed[b].bands))
    alike = [(k, 1200 + k) for k in range(60) if rows[k] != rows[1200 + k] and len(sets[k] & sets[1200 + k]) >= 0.8 * len(sets[k] | sets[1200 + k])]
    want = {signed[i].id for p in alike if share(*p) for i in p}
    assert len(want) > 20 and want <= met
    near = [a for a in range(300) if a in signed]
    # Of the first 300 lines alone.
    assert len(met) < 200 and sum(any(share(a, b) for b in near if b != a) for a in near) > 20


def test_large_buckets_keep_all_members(spark):
    rows = [(k, [7] if k < line_dedup.FEW + 1 else [8], (k * 6148914691236517205 % (1 << 56), 0)) for k in range(line_dedup.FEW + 5)]
    first = spark.createDataFrame(rows, "id long, bands array<int>, brief struct<p: long, q: long>")
    got = line_dedup.candidates(first).collect()
    assert {r.id for r in got if r.key == 7} == set(range(line_dedup.FEW + 1))


def test_brief_bound():
    """Of pairs of 0.8 that share a band, briefs lose next to none; of strangers that share one they pass few."""
    draw, n = random.Random(11), line_dedup.HASHES - line_dedup.ROWS
    apart = lambda j: sum(draw.random() >= j and draw.random() < 0.75 for _ in range(n))
    most = line_dedup.most_apart(0.8)
    assert sum(apart(0.8) > most for _ in range(20_000)) <= 4
    assert sum(apart(0.15) <= most for _ in range(5_000)) < 50
