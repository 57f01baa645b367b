"""Document fingerprints by invertible Bloom lookup sketches of paragraphs.

A text is the set of its paragraphs: runs of at most ``WORDS`` words of one line, each
named by a 64-bit digest. A sketch has three tables of cells; a digest goes into one
cell of each, and a cell holds how many digests it got, their exclusive or, and that of
their checks. Sketches of two versions subtract cell by cell: what both have cancels. A
cell of the difference with one digest gives it away (its check proves it) and it is
taken out of its other cells, until nothing is left: then the differing digests are
known, and with the numbers of paragraphs the likeness (shared over all, from 0 to 1).
If cells remain, the sketches are too small and the pair is tried again with twice the
size; every pair gets its exact likeness in the end.

The tables are peeled in turn. A digest has one cell in each, so no two cells of a turn
give the same digest, and a turn is one generator and one aggregate by document, with
no shuffle. The fingerprint is the smallest sketch, as text. Cells of a document lie
with it, texts are shuffled once by id.

``differing`` gives the differing digests themselves: from two stored fingerprints, which
an array fold subtracts and peels in place, and from larger sketches where these fail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwave.llm.common import keep

WORDS = 8
# Cells of each table of a fingerprint.
BASE = 4
TURNS = 12
# Cells of each table for each paragraph of both texts, at first.
FACTOR = 0.6
# Sketches take more memory than the texts they are made of: so many more partitions than otherwise.
PARTS = 4
_NO_ID = -(1 << 63)


def paragraphs(text: str) -> str:
    """SQL of the distinct paragraph digests of a text."""
    cut = f"regexp_extract_all({text}, '(?:[^\\\\s]++[^\\\\S\\\\n]*+){{1,{WORDS}}}+', 0)"
    return f"array_distinct(transform({cut}, p -> xxhash64(p)))"


def _cell(digest: str, table: int, size: str) -> str:
    """The cell of a digest in one of the three tables."""
    return f"int({table} * {size} + pmod(xxhash64({digest}, {table}), {size}))"


def _check(digest: str) -> str:
    return f"xxhash64({digest}, 'check')"


def sketch_text(digests: str) -> Column:
    """The smallest sketch as hexadecimal digits: number of paragraphs, then count, digests and checks of each cell."""
    cells = []
    for table in range(3):
        mine = [f"filter({digests}, d -> pmod(xxhash64(d, {table}), {BASE}) = {k})" for k in range(BASE)]
        cells += [
            f"lpad(hex(size({m})), 8, '0'), lpad(hex(aggregate({m}, 0L, (a, d) -> a ^ d)), 16, '0'),"
            f" lpad(hex(aggregate({m}, 0L, (a, d) -> a ^ {_check('d')})), 16, '0')"
            for m in mine
        ]
    return F.expr(f"lower(concat(lpad(hex(size({digests})), 8, '0'), {', '.join(cells)}))")


def successors(ids: DataFrame) -> DataFrame:
    """(doc, next) for the distinct ids ``doc``: the next smaller one, after the smallest the largest.

    Ids are sorted by ranges; only the largest of each range meets in one task.
    """
    ranged = keep(ids.distinct().repartitionByRange("doc").withColumn("part", F.spark_partition_id()))
    inside = F.lead("doc").over(Window.partitionBy("part").orderBy(F.desc("doc")))
    following = ranged.withColumn("next", inside)
    largest = ranged.groupBy("part").agg(F.max("doc").alias("largest"))
    order = Window.partitionBy().orderBy(F.desc("part"))
    below = F.coalesce(F.lead("largest").over(order), F.max("largest").over(Window.partitionBy()))
    below = largest.select("part", below.alias("below"))
    return following.join(below, "part").select("doc", F.coalesce("next", "below").alias("next"))


def _spread(pairs: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, _size, cell, n, digest, check) of rows (keys, one, other) of digest arrays: three cells for a digest, not summed.

    ``n`` is 1 for a digest of ``one`` and -1 for one of ``other``.
    """
    size = f"greatest(8, int(ceil((size(one) + size(other)) * {factor})))"
    cells = "array({})".format(", ".join(
        f"named_struct('cell', {_cell('x.d', t, '_size')}, 'n', x.n, 'digest', x.d, 'check', {_check('x.d')})" for t in range(3)
    ))
    signed = "concat(transform(one, d -> struct(1L AS n, d AS d)), transform(other, d -> struct(-1L AS n, d AS d)))"
    return (
        pairs.withColumn("_size", F.expr(size))
        .select(*keys, "_size", F.explode(F.expr(signed)).alias("x"))
        .select(*keys, "_size", F.explode(F.expr(cells)).alias("c"))
        .select(*keys, "_size", "c.cell", "c.n", "c.digest", "c.check")
    )


def attempt(pairs: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, differ) of the rows (keys, one, other) of digest arrays: how many digests differ.

    Null if the sketches of this size (``factor`` times the paragraphs of both, in cells of
    each table) did not decode. Rows partitioned by some of the keys do not move.
    """
    spread = _spread(pairs, keys, factor).withColumn("got", F.lit(0).cast("long"))
    by = [*keys, "_size", "cell"]
    nothing = "n = 0 AND digest = 0 AND check = 0 AND got = 0"

    def summed(rows: DataFrame) -> DataFrame:
        total = rows.groupBy(*by).agg(
            F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"), F.sum("got").alias("got")
        )
        return total.where(f"NOT ({nothing})")

    def turn(rows: DataFrame, table: int) -> DataFrame:
        pure = f"cell div _size = {table} AND abs(n) = 1 AND check = {_check('digest')}"
        same = "struct(cell, n, digest, check, got)"
        out = ", ".join(
            f"struct({_cell('digest', t, '_size')} AS cell, -n AS n, digest, check, 0L AS got)" for t in range(3) if t != table
        )
        emptied = "struct(cell, 0L AS n, 0L AS digest, 0L AS check, got + 1 AS got)"
        moved = rows.select(*keys, "_size", F.expr(f"inline(if({pure}, array({emptied}, {out}), array({same})))"))
        return summed(moved)

    peeled = reduce(turn, [t % 3 for t in range(TURNS)], summed(spread))
    left = F.max(F.expr("n <> 0 OR digest <> 0 OR check <> 0"))
    return peeled.groupBy(*keys).agg(F.when(~left, F.sum("got")).alias("differ"))


def retry(pairs: DataFrame, keys: list[str], factor: float = FACTOR) -> DataFrame:
    """(keys, differ) of rows (keys, one, other): twice the cells each time, until all are decoded."""
    done, pending = None, keep(pairs)
    while True:
        tried = keep(attempt(pending.repartition(*keys), keys, factor))
        decoded = tried.where("differ IS NOT NULL")
        done = decoded if done is None else done.unionByName(decoded)
        failed = tried.where("differ IS NULL").select(*keys)
        if failed.isEmpty():
            return done
        pending, factor = keep(pending.join(failed, keys, "left_semi")), factor * 2


def stored_difference(one: str, other: str) -> Column:
    """(gone, come): the digests that only the first or only the second of two stored fingerprints has.

    Null if one of them is null or they differ in more than their few cells give back: a count of
    digests, the cells left over and the numbers of paragraphs all have to come out even.
    """

    def field(text: str, start: str, width: int) -> str:
        return f"CAST(conv(substring({text}, {start}, {width}), 16, -10) AS BIGINT)"

    def cell(i: str) -> str:
        count, digest, check = f"int(9 + 40 * {i})", f"int(17 + 40 * {i})", f"int(33 + 40 * {i})"
        return (
            f"named_struct('n', {field(one, count, 8)} - {field(other, count, 8)}, 'd', {field(one, digest, 16)} ^ {field(other, digest, 16)},"
            f" 'c', {field(one, check, 16)} ^ {field(other, check, 16)})"
        )

    last = 3 * BASE - 1
    at = " OR ".join(f"i = {_cell('x.d', t, str(BASE))}" for t in range(3))
    pure = f"abs(s.cells[i].n) = 1 AND s.cells[i].c = {_check('s.cells[i].d')}"
    taken = f"named_struct('n', c.n - x.n, 'd', c.d ^ x.d, 'c', c.c ^ {_check('x.d')})"
    peeled = (
        f"named_struct('cells', transform(s.cells, (c, i) -> if({at}, {taken}, c)),"
        " 'gone', if(x.n = 1, concat(s.gone, array(x.d)), s.gone), 'come', if(x.n = -1, concat(s.come, array(x.d)), s.come))"
    )
    # A step takes out the digest of the first cell that has one alone; each empties a cell, so there is one for each.
    step = (
        f"transform(array(filter(sequence(0, {last}), i -> {pure})), p -> if(size(p) = 0, s,"
        f" transform(array(s.cells[p[0]]), x -> {peeled})[0]))[0]"
    )
    none = "CAST(array() AS ARRAY<BIGINT>)"
    start = f"named_struct('cells', transform(sequence(0, {last}), i -> {cell('i')}), 'gone', {none}, 'come', {none})"
    even = (
        "NOT exists(r.cells, c -> c.n <> 0 OR c.d <> 0 OR c.c <> 0)"
        f" AND size(r.gone) - size(r.come) = {field(one, '1', 8)} - {field(other, '1', 8)}"
    )
    end = f"r -> if({even}, named_struct('gone', array_sort(r.gone), 'come', array_sort(r.come)), NULL)"
    return F.expr(f"if({one} IS NULL OR {other} IS NULL, NULL, aggregate(sequence(0, {last}), {start}, (s, k) -> {step}, {end}))")


def recover(pairs: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, gone, come) of the rows (keys, one, other) of digest arrays: digests of the first alone and of the second alone.

    Both are null if the sketches of this size did not decode; equal sets have no row.
    """
    by = [*keys, "_size", "cell", "found"]

    def summed(rows: DataFrame) -> DataFrame:
        total = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"))
        return total.where("NOT (n = 0 AND digest = 0 AND check = 0)")

    def turn(rows: DataFrame, table: int) -> DataFrame:
        pure = f"cell >= 0 AND cell div _size = {table} AND abs(n) = 1 AND check = {_check('digest')}"
        out = ", ".join(
            f"struct({_cell('digest', t, '_size')} AS cell, -n AS n, digest, check, CAST(NULL AS BIGINT) AS found)" for t in range(3) if t != table
        )
        # What is found waits in a cell of its own, by digest.
        given = "struct(-1 AS cell, n, digest, check, digest AS found)"
        moved = f"inline(if({pure}, array({given}, {out}), array(struct(cell, n, digest, check, found))))"
        return summed(rows.select(*keys, "_size", F.expr(moved)))

    rows = _spread(pairs, keys, factor).withColumn("found", F.lit(None).cast("long"))
    peeled = reduce(turn, [t % 3 for t in range(TURNS)], summed(rows))
    sides = [F.array_sort(F.collect_list(F.when((F.col("cell") < 0) & (F.col("n") == n), F.col("found")))).alias(c) for n, c in ((1, "gone"), (-1, "come"))]
    done = F.expr("NOT _left")
    return peeled.groupBy(*keys).agg(F.bool_or(F.expr("cell >= 0 OR abs(n) <> 1")).alias("_left"), *sides).select(
        *keys, *[F.when(done, F.col(c)).alias(c) for c in ("gone", "come")]
    )


def differing(versions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gone, come, stored) of rows (keys, one, other, one_print, other_print): the paragraph digests two versions differ in.

    ``one`` and ``other`` are texts (null: empty), the prints their stored fingerprints. ``gone`` has
    the digests of ``one`` alone, ``come`` those of ``other`` alone, sorted; repeats of a paragraph are
    one digest. ``stored`` tells that the prints alone gave them back; null prints and those that
    differ in too much are decoded from larger sketches of the texts, twice the size each time. Keys
    name a row and are not null; rows that are equal in all columns are one. An empty table gives no rows.
    """
    given = versions.select(*keys, "one", "other", stored_difference("one_print", "other_print").alias("_d"))
    given = keep(given.distinct())
    done = given.where("_d IS NOT NULL").select(*keys, "_d.gone", "_d.come", F.lit(True).alias("stored"))
    texts = given.where("_d IS NULL").select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in ("one", "other")])
    pending, factor = keep(texts.select(*keys, *[F.expr(paragraphs(c)).alias(c) for c in ("one", "other")])), FACTOR
    while not pending.isEmpty():
        tried = keep(recover(pending.repartition(*keys), keys, factor).withColumn("_tried", F.lit(True)))
        # What has no row differs in nothing.
        known = pending.select(*keys).join(tried, keys, "left")
        none = F.expr("CAST(array() AS ARRAY<BIGINT>)")
        sides = [F.when(F.col("_tried").isNull(), none).otherwise(F.col(c)).alias(c) for c in ("gone", "come")]
        done = done.unionByName(known.where("_tried IS NULL OR gone IS NOT NULL").select(*keys, *sides, F.lit(False).alias("stored")))
        pending, factor = keep(pending.join(tried.where("gone IS NULL").select(*keys), keys, "left_semi")), factor * 2
    return done


def likeness(differ: str, one: str, other: str) -> Column:
    """Shared paragraphs over all, from the number that differ (null: none) and the numbers of both; 1 if both have none."""
    d = f"coalesce({differ}, 0)"
    return F.expr(f"if({one} + {other} = 0, 1D, ({one} + {other} - {d}) / ({one} + {other} + {d}))")


def edited(docs: DataFrame) -> DataFrame:
    """(doc, text, copies, edited, next_digests) of rows (doc_id, text).

    The edit replaces the last half of the characters (rounded down) by as many first ones of
    the next document, or all it has: the next smaller id, after the smallest the largest. A
    null text is empty; a null id comes before all others; of rows with one id, the one with
    the smallest text stands for it as a next document; rows equal in id and text are one here,
    with their number in ``copies``.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.expr(f"CAST('{_NO_ID}' AS BIGINT)")).alias("doc")
    plain = docs.select(doc, F.coalesce("text", F.lit("")).alias("text"))
    # By id once; all that follows finds its rows there.
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = plain.repartition(parts, "doc").groupBy("doc", "text").agg(F.count("*").alias("copies"))
    lengths = plain.select("doc", F.length("text").alias("n"))
    links = successors(lengths.select("doc")).join(lengths.groupBy("doc").agg(F.max("n").alias("n")), "doc")
    links = links.select(F.col("doc").alias("before"), F.col("next").alias("doc"), F.expr("n div 2").alias("half"))
    heads = rows.join(links, "doc").select(
        F.col("before").alias("doc"), F.expr("substring(text, 1, int(half))").alias("head"),
        F.expr(paragraphs("text")).alias("next_digests"),
    )
    heads = heads.repartition(parts, "doc").groupBy("doc").agg(F.min(F.struct("head", "next_digests")).alias("h"))
    joined = rows.join(heads, "doc")
    half = "length(text) div 2"
    new = f"concat(substring(text, 1, length(text) - int({half})), substring(h.head, 1, int({half})))"
    return joined.select("doc", "text", "copies", F.expr(new).alias("edited"), F.col("h.next_digests").alias("next_digests"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text), with what becomes of it when it is edited.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness with the edited text and with the next document), n_paragraphs. Equal
    rows have equal results, one for each. Null, repeated and empty rows: see ``edited``. An empty table gives no rows.
    """
    rows = edited(docs).select(
        "doc", F.xxhash64("text").alias("version"), "copies", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(paragraphs("text")).alias("_own"), F.expr(paragraphs("edited")).alias("_new"), F.col("next_digests").alias("_next"),
    )
    keys = ["doc", "version", "which"]
    first = attempt(_pairs(rows), keys, FACTOR).groupBy("doc", "version").agg(*[
        F.max(F.when(F.col("which") == w, F.struct(F.col("differ").alias("d")))).alias(f"t_{w}") for w in ("new", "next")
    ])
    first = first.select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), "t_new", "t_next")
    # Both sides lie by id; equality of versions, said so that it is no key, keeps them there.
    same = (F.col("doc") == F.col("_doc")) & F.col("version").between(F.col("_version"), F.col("_version"))
    tried = rows.join(first, same, "left").withColumn(
        "failed", F.expr("coalesce(t_new.d IS NULL AND t_new IS NOT NULL, false) OR coalesce(t_next.d IS NULL AND t_next IS NOT NULL, false)")
    )
    counts = {f"n{c}": F.size(c).cast("long") for c in ("_own", "_new", "_next")}
    # What is left of a document is its numbers and texts of a sketch; digests only where sketches failed.
    tried = keep(tried.withColumns(counts).select(
        "doc", "version", "copies", "n_chars", "edited_sha256", sketch_text("_own").alias("fingerprint"),
        sketch_text("_new").alias("edited_fingerprint"), F.col("t_new.d").alias("d_new"), F.col("t_next.d").alias("d_next"),
        *counts, "failed", *[F.when(F.col("failed"), F.col(c)).alias(c) for c in ("_own", "_new", "_next")],
    ))
    again = retry(_pairs(tried.where("failed")), keys, 2 * FACTOR).groupBy("doc", "version").agg(*[
        F.max(F.when(F.col("which") == w, F.col("differ"))).alias(f"r_{w}") for w in ("new", "next")
    ])
    none = F.lit(None).cast("long")
    whole = tried.where("NOT failed").withColumns({"r_new": none, "r_next": none}).unionByName(
        tried.where("failed").join(again, ["doc", "version"], "left")
    )
    each = whole.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    return each.select(
        F.expr(f"nullif(doc, CAST('{_NO_ID}' AS BIGINT))").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint",
        "edited_fingerprint", likeness("coalesce(r_new, d_new)", "n_own", "n_new").alias("near_edited"),
        likeness("coalesce(r_next, d_next)", "n_own", "n_next").alias("near_next"), F.col("n_own").alias("n_paragraphs"),
    )


def _pairs(rows: DataFrame) -> DataFrame:
    """(doc, version, which, one, other): a text against its edited text, and against the next document."""
    both = F.array(*[
        F.struct(F.lit(w).alias("which"), F.col("_own").alias("one"), F.col(f"_{w}").alias("other")) for w in ("new", "next")
    ])
    return rows.select("doc", "version", F.explode(both).alias("p")).select("doc", "version", "p.which", "p.one", "p.other")
