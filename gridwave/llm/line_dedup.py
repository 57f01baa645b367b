"""Near-duplicate lines by MinHash: of each group of alike lines one stays.

Equal lines are one until the end (named by 128 bits of hashes). A line is the set of
its shingles of ``SHINGLE`` characters; its signature holds the smallest shingle hash in
each of ``HASHES`` orders. Bands of ``ROWS`` values find candidates. Bands share values:
they are the blocks of three ways to cut the signature into seven and one into eight, which finds 97.3 % of
the pairs of similarity 0.8, 99.6 % of 0.85 and 99.99 % of 0.9. A line keeps the numbers of its
bands and two bits of each value: lines that share a bucket but differ in more values than
alike ones do (see ``most_apart``) met by accident and go before anything wide moves.
Candidates are sifted by odd sketches (which of 1024 bits an odd number
of shingles fall on): two sketches differ in no more bits than the sets have shingles apart,
so a pair that differs in more than a link allows is none, and no link is lost. The others are
verified by the exact Jaccard similarity of their shingles and joined by distributed
union-find.

All of it is DataFrame functions. A generated row covers ``STEP`` shingles, so the
minima over them are plain expressions and only one row in ``STEP`` is aggregated.
Texts are shuffled once, with equal lines folded before; they are signed where they land.
For verification only those of candidates move, found by a broadcast bitmap of fixed size.
All else that moves is a few numbers for a line. While signatures are made, a line of any
length is a streak of rows, never an array of its shingles.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwave.llm.bitmaps import bitmap, likely, marked
from gridwave.llm.common import keep_table, mixers, turned
from gridwave.llm.components import linked_components

# One changed character spoils 4 shingles, so lines from 39 characters bear it.
SHINGLE = 4
SIMILARITY = 0.8
HASHES, BANDS, ROWS = 56, 21, 8
# Values of the bands of one more cut, for pairs that these miss.
SHORT = 7
# Values of a signature in one half of its brief form, two bits of each.
HALF = HASHES // 2
# Buckets of more lines are not searched for lines that met by accident.
FEW = 64
# Numbers of 64 bits in an odd sketch.
ODD = 16
# Lines of more characters have odd sketches, shorter ones marks.
MARKED = 1200
STEP = 4

_TURNS, _SEED = 3, 9
# Stands for a null id, so that rows without id keep a place of their own.
_NO_ID = -(1 << 63)
_PLACE = ["doc", "row", "line_no"]


def lines(docs: DataFrame) -> DataFrame:
    """(doc, row, line_no, line) of rows (doc_id, text), from 0; a null text has no lines.

    ``row`` is a hash of the text: rows of one id with other texts are other documents.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.expr(f"CAST('{_NO_ID}' AS BIGINT)")).alias("doc")
    row = F.xxhash64(F.lit(2), "text").alias("row")
    return docs.select(doc, row, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _judges() -> Column:
    """Whether a line takes part: all but blank ones do."""
    return F.col("line").rlike(r"[^\s\p{Z}]")


def _named() -> list[Column]:
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")]


def _points(line: str) -> Column:
    """The line as four bytes a character, so that a shingle is found by its place at once."""
    return F.encode(line, "UTF-32")


def signatures(rows: DataFrame, keys: Sequence[str], shingle: int = SHINGLE) -> DataFrame:
    """(keys, bands, brief) of rows (keys, line); a line shorter than a shingle is one shingle.

    ``bands`` has the hash of each band of the signature, ``brief`` two bits of each of its values.

    Rows must be partitioned by some of the keys; then nothing moves.
    """
    chars = rows.select(*keys, _points("line").alias("_c"))
    chars = chars.withColumn("_last", F.expr(f"greatest(length(_c) div 4 - {shingle}, 0L)"))
    steps = chars.select("*", F.explode(F.expr(f"sequence(0L, _last, {STEP}L)")).alias("_i"))
    hashed = steps.select(*keys, *[
        F.expr(f"xxhash64(substring(_c, int(4 * least(_i + {j}, _last) + 1), {4 * shingle}))").alias(f"_h{j}")
        for j in range(STEP)
    ])
    orders = mixers(HASHES, _TURNS, _SEED)
    turns = hashed.select(*keys, *[
        F.expr(turned(f"_h{j}", t)).alias(f"_t{t}_{j}") for t in dict(orders) for j in range(STEP)
    ])
    # Minima within a row are part of the aggregates, which are compiled one by one: all of them
    # in one projection would be too long a method to be compiled at all.
    least = turns.groupBy(*keys).agg(*[
        F.min(F.least(*[F.col(f"_t{t}_{j}").bitwiseXOR(F.lit(c)) for j in range(STEP)])).alias(f"m{k}")
        for k, (t, c) in enumerate(orders)
    ])
    # Bands are numbers of 31 bits: strangers that share one are told apart by their briefs.
    bands = [F.xxhash64(F.lit(b), *[f"m{k}" for k in cut]).bitwiseAND(F.lit(2147483647)).cast("int") for b, cut in enumerate(_cuts())]
    # With a lambda in it this projection is compiled apart from the aggregate, in methods short enough to be compiled at all.
    halves = [f"aggregate(array({', '.join(f'm{k}' for k in range(start, start + HALF))}), 0L, (x, m) -> shiftleft(x, 2) | (m & 3L))" for start in (0, HALF)]
    brief = F.struct(F.expr(halves[0]).alias("p"), F.expr(halves[1]).alias("q"))
    return least.select(*keys, F.array(*bands).alias("bands"), brief.alias("brief"))


def _cuts() -> list[list[int]]:
    """Which values of a signature make each band."""
    draw, out = random.Random(_SEED), []
    while len(out) < BANDS:
        order = draw.sample(range(HASHES), HASHES)
        out += [sorted(order[i : i + ROWS]) for i in range(0, HASHES, ROWS)]
    order = draw.sample(range(HASHES), HASHES)
    out += [sorted(order[i : i + SHORT]) for i in range(0, HASHES, SHORT)]
    return out


def band_keys(rows: DataFrame) -> DataFrame:
    """(key, id, brief) of rows (id, bands, brief), once for each band."""
    bands = rows.select("id", "brief", F.posexplode("bands").alias("_b", "_v"))
    return bands.select(F.expr("shiftleft(bigint(_b), 31) | _v").alias("key"), "id", "brief")


def most_apart(similarity: float) -> int:
    """In how many values the briefs of two lines of a bucket may differ.

    Lines of this similarity agree in a band, and in each other value with at least that chance; of values that
    differ, two bits are the same in one of four. 3 in 100,000 of such pairs differ in more, of more alike ones fewer.
    """
    n, p = HASHES - ROWS, 0.75 * (1 - similarity)
    more, d = 1.0, -1
    while more > 3e-5:
        d += 1
        more -= math.comb(n, d) * p**d * (1 - p) ** (n - d)
    return d


def may_agree(similarity: float) -> str:
    """SQL whether lines of the briefs ``{x}`` and ``{y}`` that share a bucket may have the similarity."""
    apart = [f"bit_count((({{x}}.{h} ^ {{y}}.{h}) | shiftrightunsigned({{x}}.{h} ^ {{y}}.{h}, 1)) & 6148914691236517205L)" for h in "pq"]
    return f"{' + '.join(apart)} <= {most_apart(similarity)}"


def shingles(line: str, shingle: int = SHINGLE) -> str:
    """SQL of the array of distinct shingle hashes of a line.

    The wide form of the line is bound by a lambda of its own: written out, the optimizer
    would put its making into the inner lambda, and make it once for each shingle.
    """
    hashes = f"transform(sequence(0, length(c) div 4 - {shingle}), i -> xxhash64(substring(c, 4 * i + 1, {4 * shingle})))"
    return f"transform(array(encode({line}, 'UTF-32')), c -> array_distinct({hashes}))[0]"


def sketches(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, sig) of rows (id, line): the number of distinct shingles ``n`` and their odd sketch ``odd``."""
    sets = texts.select("id", F.explode(F.expr(shingles("line", shingle))).alias("_h"))
    rows = sets.select("id", F.expr("shiftleft(1L, int(_h & 63))").alias("_bit"), F.expr(f"shiftright(_h, 6) & {ODD - 1}").alias("_at"))
    odd = [F.bit_xor(F.when(F.col("_at") == k, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"o{k}") for k in range(ODD)]
    made = rows.groupBy("id").agg(F.count("*").alias("n"), *odd)
    return made.select("id", F.struct("n", F.array(*[f"o{k}" for k in range(ODD)]).alias("odd")).alias("sig"))


def marks(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, sig) like ``sketches``, with the bits that any shingle falls on and the number of places of shingles.

    Two of them, too, differ in no more bits than the sets have shingles apart, and there are no more distinct
    shingles than places. It takes a third of the time, for nothing is made distinct, but more bits are set the longer a line is.
    """
    chars = texts.select("id", _points("line").alias("_c"))
    chars = chars.withColumn("_last", F.expr(f"greatest(length(_c) div 4 - {shingle}, 0L)"))
    steps = chars.select("*", F.explode(F.expr(f"sequence(0L, _last, {STEP}L)")).alias("_i"))
    hashed = steps.select("id", "_last", *[
        F.expr(f"xxhash64(substring(_c, int(4 * least(_i + {j}, _last) + 1), {4 * shingle}))").alias(f"_h{j}")
        for j in range(STEP)
    ])
    rows = hashed.select("id", "_last", *[
        F.expr(e).alias(f"{c}{j}") for j in range(STEP)
        for c, e in (("_bit", f"shiftleft(1L, int(_h{j} & 63))"), ("_at", f"shiftright(_h{j}, 6) & {ODD - 1}"))
    ])
    words = [F.bit_or(F.expr(" | ".join(f"if(_at{j} = {k}, _bit{j}, 0L)" for j in range(STEP)))).alias(f"o{k}") for k in range(ODD)]
    made = rows.groupBy("id").agg((F.max("_last") + 1).alias("n"), *words)
    return made.select("id", F.struct("n", F.array(*[f"o{k}" for k in range(ODD)]).alias("odd")).alias("sig"))


def sifters(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, sig) of rows (id, line): marks, or odd sketches of lines so long that marks fill up; ``sig.long`` tells which."""
    is_long = F.length("line") > MARKED
    kinds = [(marks(texts.where(~is_long), shingle), False), (sketches(texts.where(is_long), shingle), True)]
    short, long = [rows.select("id", F.struct("sig.n", "sig.odd", F.lit(kind).alias("long")).alias("sig")) for rows, kind in kinds]
    return short.unionByName(long)


def may_link(similarity: float) -> str:
    """SQL whether lines of the sketches ``{x}`` and ``{y}`` may have the similarity: false only for pairs that have not.

    Of sets with n and m elements that differ in d, the similarity is (n + m - d) / (n + m + d),
    and the sketches differ in d bits at most.
    """
    bits = " + ".join(f"bit_count({{x}}.odd[{k}] ^ {{y}}.odd[{k}])" for k in range(ODD))
    return f"{bits} <= ({{x}}.n + {{y}}.n) * {(1 - similarity) / (1 + similarity)!r}D + 1e-6D"


def may_link_any(similarity: float) -> str:
    """Like ``may_link``, of ``sifters``: of marks and a sketch, the number of distinct shingles in the sketch must not be too large."""
    other = f"if({{x}}.long, {{x}}.n * {similarity!r}D <= {{y}}.n + 1e-6D, {{y}}.n * {similarity!r}D <= {{x}}.n + 1e-6D)"
    return f"if({{x}}.long = {{y}}.long, {may_link(similarity)}, {other})"


def jaccard(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b, j): the Jaccard similarity of the lines in ``texts`` (id, line) of pairs (a, b) of ids."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("_a")), "a")
    joined = joined.join(texts.select(F.col("id").alias("b"), F.col("line").alias("_b")), "b")
    # Lines move as texts; their sets are made once, where they have met.
    share = "n -> n / (size(s.a) + size(s.b) - n)"
    both = f"array(struct({shingles('_a', shingle)} AS a, {shingles('_b', shingle)} AS b))"
    return joined.select("a", "b", F.expr(f"transform({both}, s -> transform(array(size(array_intersect(s.a, s.b))), {share})[0])[0]").alias("j"))


def signed_lines(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, h, g, doc, row, line_no, copies, bands, brief) for every distinct line: its first place, its copies, its signature.

    Ids of lines with more copies are smaller, by powers of two, so that the smallest id of a
    bucket is the line most likely to be what the others were made from. A line shorter than a
    shingle has no bands: only its copies are alike.
    """
    found = lines(docs).where(_judges()).select(*_PLACE, "line", *_named())
    texts = found.groupBy("h", "g").agg(F.min(F.struct(*_PLACE, "line")).alias("at"), F.count("*").alias("copies"))
    is_long = (F.length("at.line") >= shingle).alias("is_long")
    texts = texts.select("h", "g", *[f"at.{c}" for c in _PLACE], "copies", is_long, "at.line")
    signed = signatures(texts, ["h", "g", *_PLACE, "copies", "is_long"], shingle)
    rank = F.expr("shiftleft(63L - CAST(floor(log2(copies)) AS BIGINT), 57)") + F.monotonically_increasing_id()
    return signed.select(rank.alias("id"), "h", "g", *_PLACE, "copies", F.when(F.col("is_long"), F.col("bands")).alias("bands"), "brief")


def candidates(first: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, id, brief) of the buckets of two lines or more; of buckets of FEW at most, lines that may be alike to another there."""
    entries = band_keys(first.where("bands IS NOT NULL"))
    # An id has a key once, since keys have the number of their band in them.
    crowded = keep_table(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = keep_table(likely(entries, ["key"], crowded).join(crowded, "key"))
    few, many = members.where(F.col("n") <= FEW), members.where(F.col("n") > FEW)
    others = few.select(F.col("key").alias("_k"), F.col("id").alias("_id"), F.col("brief").alias("_brief"))
    met = F.expr(f"key = _k AND id <> _id AND {may_agree(similarity).format(x='brief', y='_brief')}")
    return few.join(others, met, "left_semi").unionByName(many).drop("n")


def decide(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, line_no, component_doc_id, component_line_no, kept) for each line of ``docs`` (doc_id, text).

    A component is what links of lines reach; it is named by its first line (smallest id, then
    line number), which is the one that is kept. Blank lines are components of their own. A line
    shorter than a shingle is alike to its copies only. A null text has no lines; a null id
    comes before all others; rows with one id and one text count as one document, with other
    texts as several; an empty table gives no rows.
    """
    out = _decided(docs, similarity, shingle)

    def back(name: str) -> Column:
        return F.expr(f"nullif({name}, CAST('{_NO_ID}' AS BIGINT))")

    return out.select(
        back("doc").alias("doc_id"), "line_no", back("head.doc").alias("component_doc_id"),
        F.col("head.line_no").alias("component_line_no"), "kept",
    )


def _decided(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(doc, row, line_no, head, kept) for each line; the head is a place."""
    first = keep_table(signed_lines(docs, shingle))
    members = keep_table(candidates(first, similarity))
    # Texts of candidates alone, found by a bitmap of fixed size before they move.
    ids = members.select("id").distinct()
    wanted = keep_table(likely(first, ["id"], ids).join(ids, "id").select("id", "h", "g", *_PLACE))
    texts = likely(lines(docs).where(_judges()), _PLACE, wanted).select(*_PLACE, "line", *_named())
    # Rows that are equal in id and text give a line twice.
    texts = keep_table(texts.join(wanted, [*_PLACE, "h", "g"]).groupBy("id").agg(F.min("line").alias("line")))
    # Odd sketches of short lines too: in marks, what lines have in common hides what they have not.
    sigs = keep_table(sketches(texts, shingle))

    def measure(pairs: DataFrame) -> DataFrame:
        # Of the texts those move that are in a pair.
        return jaccard(pairs, likely(texts, ["id"], pairs.select(F.explode(F.array("a", "b")).alias("id"))), shingle)

    linked = keep_table(linked_components(members, may_link(similarity), measure, similarity, sigs, may_agree(similarity)))
    # Lines that are neither copied nor linked stand for themselves and need not move.
    shared = marked(first.select("id", "h", "g", *_PLACE, "copies"), ["id"], bitmap(linked, ["id"])).where("_maybe OR copies > 1").drop("_maybe")
    named = shared.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = named.groupBy("component").agg(F.min(F.struct(*_PLACE)).alias("head"))
    named = keep_table(named.join(heads, "component").select("h", "g", "head"))
    every = lines(docs).select(*_PLACE, *_named(), _judges().alias("judged"))
    every = marked(every, ["h", "g"], bitmap(named, ["h", "g"])).withColumn("_maybe", F.expr("judged AND _maybe"))
    own = F.struct(*_PLACE)
    far = every.where("_maybe").join(named, ["h", "g"], "left").select(*_PLACE, F.coalesce("head", own).alias("head"))
    near = every.where("NOT _maybe").select(*_PLACE, own.alias("head"))
    return far.unionByName(near).withColumn("kept", F.col("head") == own)


def dedup(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with texts of the lines that are kept, and n_removed (lines taken out).

    Other columns stay as they are; a document that loses all its lines keeps its row with an
    empty text, and a null text stays null. Rows are told apart by id and text, so one row's
    lines go only if they are alike to kept ones, whatever ids repeat.
    """
    removed = _decided(docs.select("doc_id", "text"), similarity, shingle).where("NOT kept")
    removed = removed.groupBy("doc", "row").agg(F.collect_set("line_no").alias("_gone"))
    removed = removed.withColumnsRenamed({"doc": "_doc", "row": "_row"})
    own = F.coalesce(F.col("doc_id").cast("long"), F.expr(f"CAST('{_NO_ID}' AS BIGINT)"))
    joined = docs.drop("n_removed").join(removed, (own == F.col("_doc")) & (F.xxhash64(F.lit(2), "text") == F.col("_row")), "left")
    left = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> NOT array_contains(_gone, i)), '\\n')")
    return joined.withColumns({
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left),
        "n_removed": F.coalesce(F.size("_gone"), F.lit(0)),
    }).drop("_gone", "_doc", "_row")
