"""A mix of sources in given weights, by a low-discrepancy schedule of equal blocks.

Each source's documents are laid end to end in an order of hashes, and the stream,
repeated as often as needed, is cut into blocks of ``BLOCK`` words. The schedule maps
the points of the van der Corput sequence (bits of the slot number, mirrored) through
the cumulated targets, so that any stretch of slots holds the sources nearly in
proportion. Slots are ranked within their source: the slot of rank r plays the source's
block r. A source takes exactly its target: its last block is cut there, slots beyond
it are passed over, and what the points leave short (a few slots, whatever the length)
follows at the end.

Nothing here depends on a source being small: running sums and ranks are taken within
parts of a source (by hash, or by stretches of slots) and then moved by the sums of the
parts before, so a source with a third of all rows is spread like any other. The
table of sources (one row each) is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwave.llm.common import keep

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 256
WORD = "[^\\x20\\x09-\\x0D]+"
_STRETCH = 4096
_CELLS = 4096


def sources(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target, need, first, total) from rows (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn. A source's target is
    its share of all words by weight, but at most ``most`` times its size; what is over goes
    to the others by weight, until none is above. ``need`` is the target in whole words and
    ``first`` the sum of those before.
    """
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = table.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    table = table.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    # In the order in which sources reach their caps as the level of words per weight rises.
    rising = everything.orderBy(F.col("cap") / F.col("w"), "sid")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    behind = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    table = table.withColumn("level", left / F.sum("w").over(behind)).withColumn("k", F.row_number().over(rising))
    holds = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("k", "level"))
    table = table.withColumn("level", F.min(holds).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    table = table.withColumn("target", target).withColumn("need", F.floor(F.col("target") + 0.5))
    so_far = everything.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return table.select(
        "source", "sid", "source_size", "target", "need",
        F.coalesce(F.sum("need").over(so_far), F.lit(0)).alias("first"), F.sum("need").over(everything).alias("total"),
    )


def schedule(mixed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, rank) of the mix from what ``sources`` returns: in slot order, which source plays its which block."""
    spark = mixed.sparkSession
    total = mixed.agg(F.max("total").alias("n")).first()["n"] or 0
    slots = -(-total // block)
    # Mirrored, the 48 bits of a slot's number are its point; times the total it falls on a word of a source.
    point = "conv(reverse(lpad(bin(slot), 48, '0')), 2, 10) / 281474976710656D"
    cell = max(1, -(-total // _CELLS))
    points = spark.range(slots).selectExpr("id AS slot", f"CAST(floor({point} * {total}D) AS BIGINT) AS word")
    points = points.withColumn("cell", F.expr(f"word div {cell}"))
    spans = mixed.where("need > 0").select(
        "sid", "first", (F.col("first") + F.col("need")).alias("end"),
        F.explode(F.expr(f"sequence(first div {cell}, (first + need - 1) div {cell})")).alias("cell"),
    )
    dealt = points.join(spans, "cell").where("word >= first AND word < end")
    dealt = dealt.select("slot", "sid", F.expr(f"slot div {_STRETCH}").alias("stretch"))
    counts = dealt.groupBy("sid", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("sid", "stretch").orderBy("slot")) - 1
    ranked = dealt.withColumn("within", within).join(counts.select("sid", "stretch", "before"), ["sid", "stretch"])
    plays = mixed.select("sid", F.expr(f"(need + {block - 1}) div {block}").alias("plays"))
    ranked = ranked.select("slot", "sid", (F.col("before") + F.col("within")).alias("rank"))
    ranked = ranked.join(plays, "sid").where("rank < plays").select("slot", "sid", "rank")
    # What the points leave short, behind all points: a source's missing blocks in its own order.
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = plays.join(got, "sid", "left").selectExpr("sid", "plays", "coalesce(got, 0) AS got").where("got < plays")
    tail = short.select("sid", F.explode(F.expr("sequence(got, plays - 1)")).alias("rank"))
    tail = tail.select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank")
    return ranked.unionByName(tail)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text, source, more) without text, with what the mix takes of each document.

    Adds size (words), source_size, target, taken (words, repeats counted; at most ``most``
    times the size) and first_slot (where in the mix it first plays; null if it never does);
    columns of these names are replaced. A null text has no words and is not taken; a null
    source is a source, the last; rows with equal ids are documents of their own, laid out by
    size. An empty table gives no rows. Equal input gives equal output in any partitioning.
    """
    new = ["size", "source_size", "target", "taken", "first_slot"]
    docs = docs.drop(*new)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    others = [c for c in docs.columns if c != "text"]
    sized = docs.select("doc_id", "source", F.struct(*others).alias("_doc"), words.alias("size"), place.alias("_place"))
    # One pass over the texts; what is left of a document is a few numbers.
    sized = keep(sized.withColumn("_row", F.monotonically_increasing_id()))
    mixed = keep(sources(sized.select("source", "size"), weights, most))
    known = mixed.select(F.col("source").alias("_source"), "sid", "source_size", "target", "need")
    sized = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    parts = sized.withColumn("_part", F.shiftrightunsigned("_place", 50)).where("size > 0 AND need > 0")
    parts = parts.select("_row", "doc_id", "sid", "size", "source_size", "need", "_place", "_part")
    sums = parts.groupBy("sid", "_part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("sid", "_part").orderBy("_place", "doc_id", "size", "_row")
    start = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    laid = parts.withColumn("start", start).join(sums, ["sid", "_part"])
    laid = laid.withColumn("start", F.col("start") + F.col("before"))
    # A document stands in the repeated stream once per pass; each time its blocks are the words it shares with them.
    passes = laid.withColumn("start", F.explode(F.expr(
        "transform(sequence(0L, (need - 1) div source_size), p -> start + p * source_size)"
    ))).where("start < need")
    passes = passes.withColumn("end", F.expr("least(start + size, need)"))
    pieces = passes.withColumn("rank", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")))
    shared = F.expr(f"least(end, (rank + 1) * {block}) - greatest(start, rank * {block})")
    pieces = pieces.select("_row", "sid", "rank", shared.alias("shared"))
    taken = pieces.join(schedule(mixed, block), ["sid", "rank"]).groupBy("_row")
    taken = taken.agg(F.sum("shared").alias("taken"), F.min("slot").alias("first_slot"))
    out = sized.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return out.select("_doc.*", *new)


def plan_copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``docs`` as the mix plays them: each as often as its taken words make whole documents, rounded.

    Documents of which less than half is taken go. The rows keep all their columns; rows of
    one id are all treated like the one that is taken most.
    """
    plan = mix(docs.select("doc_id", "text", "source"), weights, most, block)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1)
    plan = plan.groupBy("doc_id").agg(F.max(times).alias("_times"))
    joined = docs.join(plan.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).where("_times > 0")
    repeated = joined.withColumn("_times", F.explode(F.expr("sequence(1, int(_times))")))
    return repeated.select(*docs.columns)


def oracle(weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> str:
    """The same as DuckDB SQL over ``documents``."""
    listed = ", ".join(f"{float(w)}" for w in weights)
    return f"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM sized GROUP BY source),
w AS (SELECT *, ([{listed}])[sid % {len(weights)} + 1]::DOUBLE AS w, source_size * {most} AS cap FROM s),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sid
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, sid) AS k FROM w),
chosen AS (SELECT arg_min(level, k) AS level FROM levels WHERE level <= cap / w),
t AS (SELECT sid, source, source_size, least(cap::DOUBLE, coalesce(chosen.level * w, cap::DOUBLE)) AS target
      FROM levels, chosen),
needs AS (SELECT *, floor(target + 0.5)::BIGINT AS need FROM t),
spans AS (
  SELECT *, (coalesce(sum(need) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first,
         (sum(need) OVER ())::BIGINT AS total FROM needs),
points AS (
  SELECT slot, floor(list_sum(list_transform(range(48), lambda b: CASE WHEN (slot >> b) & 1 = 1
                     THEN 1.0::DOUBLE / (1::BIGINT << (b + 1)) ELSE 0.0::DOUBLE END)) * total::DOUBLE)::BIGINT AS word
  FROM (SELECT unnest(range((total + {block - 1}) // {block})) AS slot, total FROM (SELECT max(total) AS total FROM spans))),
ranked AS (
  SELECT slot, sid, need, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM points JOIN spans ON word >= first AND word < first + need),
got AS (SELECT sid, count(*) AS got FROM ranked GROUP BY sid),
tail AS (
  SELECT total, sid, unnest(range(coalesce(got, 0), (need + {block - 1}) // {block})) AS rank
  FROM spans LEFT JOIN got USING (sid)),
plays AS (
  SELECT slot, sid, rank FROM ranked WHERE rank * {block} < need
  UNION ALL SELECT (total + {block - 1}) // {block} + rank, sid, rank FROM tail),
laid AS (
  SELECT r, sid, size, source_size, need,
         (sum(size) OVER (PARTITION BY sid ORDER BY place, doc_id NULLS FIRST, size, r) - size)::BIGINT AS start
  FROM sized JOIN spans ON sized.source IS NOT DISTINCT FROM spans.source WHERE size > 0 AND need > 0),
passes AS (
  SELECT r, sid, greatest(start + p * source_size, 0) AS start, least(start + p * source_size + size, need) AS stop
  FROM laid, range({most}) x(p) WHERE start + p * source_size < need),
pieces AS (SELECT *, unnest(range(start // {block}, (stop - 1) // {block} + 1)) AS rank FROM passes),
taken AS (
  SELECT r, sum(least(stop, (rank + 1) * {block}) - greatest(start, rank * {block}))::BIGINT AS taken, min(slot) AS first_slot
  FROM pieces JOIN plays USING (sid, rank) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot
FROM sized JOIN spans ON sized.source IS NOT DISTINCT FROM spans.source LEFT JOIN taken USING (r)"""
