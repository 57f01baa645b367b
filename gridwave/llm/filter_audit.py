"""How filters interact: what each removes in every order, and its fair share of all that goes.

A document is the set of filters it fails, a mask of bits, so the whole table comes down to
counts by part and mask in one pass; nothing below depends on the number of documents. The
removal game gives a coalition of filters the documents that fail any of its filters. Its
Hart-Mas-Colell potential is found recursively, from small coalitions to large ones,

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,   P(nothing) = 0,

and a filter's Shapley value is the potential of all filters less that without it. Potentials
are held times the factorial of the number of filters, which makes them whole numbers; the
difference is then the sum over all orders. What a step of an order removes is the
difference of two coalitions.

All of it is DataFrame functions.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = "E"

_BLANKS = r"[\x20\x09-\x0D]+"
_FIGURES = ("n", "good", "toxic")


def failing() -> dict[str, Column]:
    """What a document fails by itself, from columns ``text`` (not null) and ``words`` (array)."""
    words = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {
        "A": words < 200,
        "B": F.size(F.array_distinct("words")) * 100 < words * 50,
        "C": capitals.cast("long") * 100 > F.length("text").cast("long") * 3,
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, h, g) of rows (doc_id, text, lang): what each fails by itself, and 128 bits of its text."""
    text = F.coalesce("text", F.lit(""))
    part = F.coalesce("lang", F.lit(""))
    split = docs.select("doc_id", part.alias("part"), text.alias("text"))
    split = split.withColumn("words", F.array_remove(F.split("text", _BLANKS, -1), ""))
    mask = F.lit(0)
    for letter, fails in failing().items():
        mask = mask.bitwiseOR(F.when(fails, F.lit(_bit(letter))).otherwise(F.lit(0)))
    h, g = F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")
    return split.select("doc_id", "part", mask.alias("mask"), h, g)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by what they fail, copies of a smaller doc_id's text included.

    Copies are counted, not marked one by one: each text is folded to its counts and those of
    its smallest doc_id before anything meets, so a text held by a third of all rows is one
    row from each task.
    """
    marked = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = marked.where("good = 1 OR toxic = 1").select(F.col("doc_id").alias("_id"), "good", "toxic", F.lit(0).cast("long").alias("_lane"))
    # Rows without id match no label; a number of their own keeps them from meeting in one task.
    lane = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    rows = masks(docs).withColumn("lane", lane)
    rows = rows.join(marked, (F.col("doc_id") == F.col("_id")) & (F.col("lane") == F.col("_lane")), "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    rows = rows.select("doc_id", "lane", "part", "mask", "h", "g", *flags)
    rows = rows.groupBy("doc_id", "lane", "part", "mask", "h", "g", "good", "toxic").agg(F.count("*").alias("n"))
    figures = [F.col("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic")]
    rows = rows.select("doc_id", "part", "mask", "h", "g", *figures)
    known = F.col("doc_id").isNotNull()
    texts = rows.groupBy("h", "g", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in _FIGURES],
        *[F.coalesce(F.sum(F.when(~known, F.col(c))), F.lit(0)).alias(f"un_{c}") for c in _FIGURES],
        F.min(F.when(known, F.struct("doc_id", *_FIGURES))).alias("least"),
    )
    # One row for each part that holds the text.
    first = F.min("least.doc_id").over(Window.partitionBy("h", "g"))
    texts = texts.withColumn("is_first", F.coalesce(F.col("least.doc_id") == first, F.lit(False)))
    free = [F.col(f"un_{c}") + F.when(F.col("is_first"), F.col(f"least.{c}")).otherwise(F.lit(0)) for c in _FIGURES]
    copied = F.col("mask").bitwiseOR(F.lit(_bit(COPY))).alias("mask")
    both = F.array(
        F.struct("mask", *[x.alias(c) for c, x in zip(_FIGURES, free)]),
        F.struct(copied, *[(F.col(c) - x).alias(c) for c, x in zip(_FIGURES, free)]),
    )
    # Both kinds, also where there are none: every part has a row, whatever its documents fail.
    return texts.select("part", F.inline(both)).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in _FIGURES])


def potentials(values: str, filters: int) -> str:
    """SQL of the potentials of all coalitions, times the factorial of the number of filters.

    ``values`` is the array of the game, by the coalition's bits; coalitions are smaller
    numbers than those that hold them, so a fold in this order always finds its parts.
    """
    others = f"filter(sequence(0, {filters - 1}), i -> (s & shiftleft(1, i)) <> 0)"
    without = f"aggregate({others}, 0L, (t, i) -> t + p[s ^ shiftleft(1, i)])"
    value = f"({math.factorial(filters)}L * {values}[s] + {without}) div bit_count(s)"
    return f"aggregate(sequence(1, {(1 << filters) - 1}), array(0L), (p, s) -> concat(p, array({value})))"


def report(counts: DataFrame) -> DataFrame:
    """Every step of every order, from (part, mask, n, good, toxic)."""
    k, everyone = len(FILTERS), (1 << len(FILTERS)) - 1
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    coalitions = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(everyone))).alias("s")).groupBy("part", "s").agg(
        *[F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0))).alias(c) for c in _FIGURES], F.sum("n").alias("total")
    )
    # An array of 32 coalitions for each part.
    games = coalitions.groupBy("part").agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("s", *_FIGURES))).alias("game")
    )
    games = games.select("part", "total", *[F.col(f"game.{c}").alias(f"v_{c}") for c in _FIGURES])
    games = games.withColumn("potential", F.expr(potentials("v_n", k)))
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    coalition = f"(m, c) -> m | shiftleft(1, instr('{FILTERS}', c) - 1)"
    steps = steps.withColumns({
        "before": F.expr(f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, {coalition})"),
        "own": F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)"),
    }).withColumn("after", F.expr("before | own"))
    removed = F.expr("v_n[after] - v_n[before]")
    return steps.select(
        "part", "filter_order", "step",
        F.expr("total - v_n[after]").alias("kept"),
        removed.alias("removed"),
        (F.expr("v_n[own]") - removed).alias("redundant"),
        F.expr(f"v_n[{everyone}] - v_n[{everyone} ^ own]").alias("unique_fails"),
        F.expr("v_good[after] - v_good[before]").alias("good_lost"),
        F.expr("v_toxic[after] - v_toxic[before]").alias("toxic_lost"),
        F.expr(f"potential[{everyone}] - potential[{everyone} ^ own]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are
    not read. A null text is empty, a null lang the part of the empty string. A row without
    doc_id is a copy of none, makes no other row a copy and has no label; rows of one doc_id
    are documents of their own, none of them a smaller one than another. A document has a label
    if any of its label rows says so. Without documents there are no rows.
    """
    return report(mask_counts(docs, labels))


def oracle() -> str:
    """DuckDB SQL for the rows of ``audit`` over documents and labels."""
    bits = {c: 1 << i for i, c in enumerate(FILTERS)}
    tables = ", ".join(f"({b}, '{c}')" for c, b in bits.items())
    every = (1 << len(FILTERS)) - 1
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
heads AS (SELECT text, min(doc_id) AS head FROM d GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         | CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         | CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
         | CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         | CASE WHEN doc_id > head THEN 16 ELSE 0 END AS mask
  FROM d JOIN heads USING (text) LEFT JOIN marks USING (doc_id)),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m GROUP BY ALL),
f(bit, letter) AS (VALUES {tables}),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = {every}),
places AS (
  SELECT filter_order, step::INTEGER AS step, bit AS own,
         (SELECT coalesce(sum(g.bit), 0)::BIGINT FROM f g WHERE instr(filter_order, g.letter) < step) AS before
  FROM orders, range(1, {len(FILTERS) + 1}) t(step), f WHERE letter = filter_order[step]),
steps AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (mask & (before | own) = 0) AS kept,
         sum(n) FILTER (mask & before = 0 AND mask & own <> 0) AS removed,
         sum(n) FILTER (mask & before <> 0 AND mask & own <> 0) AS redundant,
         sum(n) FILTER (mask = own) AS unique_fails,
         sum(good) FILTER (mask & before = 0 AND mask & own <> 0) AS good_lost,
         sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0) AS toxic_lost
  FROM c, places GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM steps"""
