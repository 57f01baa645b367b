"""Connected components of links between ids, and links within buckets of candidates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwave.llm.common import keep, keep_table


def components(links: DataFrame, write: Callable[[DataFrame], DataFrame] = keep) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its smallest id.

    Distributed union-find by stars: each round every id points its larger neighbours,
    then its smaller ones, to the smallest id it knows, until all links lead to the
    smallest id of their component; the number of rounds grows with the logarithm of the
    longest chain. Minima are taken by partial aggregates, so an id with very many links
    is no hot group, and joins on it can be split. Rounds are written to the shared folder by ``write``.
    """
    a, b = F.col("a"), F.col("b")
    stars = write(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    mark = _mark(stars)
    while mark[0]:
        both = stars.unionByName(stars.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        stars = write(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if mark == (mark := _mark(stars)):
            break
    return stars.select(a.alias("id"), b.alias("component")).unionByName(
        stars.select(b.alias("id"), b.alias("component")).distinct()
    )


def _mark(links: DataFrame) -> tuple[int, int | None]:
    """What tells two sets of links apart: their number and the sum of their hashes without carry."""
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def bucket_components(buckets: DataFrame, similar: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component) of the links among candidates: ids (``id``) that share a ``key``.

    ``similar`` takes distinct pairs (a, b) and returns those that are links. Not all pairs
    of a bucket are formed: its members first meet two of them, drawn by a hash that differs
    from bucket to bucket, so copies that share several buckets meet several of their kind;
    then only members that are still in different components meet. No link that could join
    two components is passed over, and a bucket of thousands of copies costs two pairs each.
    """
    buckets = keep(buckets.distinct())
    drawn = F.xxhash64("id", "key")
    ends = buckets.groupBy("key").agg(F.min_by("id", drawn).alias("one"), F.max_by("id", drawn).alias("two"))
    shared = buckets.join(ends.where("one <> two"), "key")
    met = shared.select("id", F.explode(F.array("one", "two")).alias("other")).where("id <> other")
    pairs = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    first = keep(similar(pairs.distinct()).select("a", "b"))
    found = keep(components(first))
    placed = shared.select("key", "id").join(found, "id", "left")
    placed = placed.select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    # Buckets of two have met already.
    rest = placed.join(mixed.where("lo <> hi and n > 2").select("key"), "key")
    left = rest.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
    right = rest.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    pairs = left.join(right, "key").where("ca < cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = keep(similar(pairs.distinct()).select("a", "b"))
    if second.isEmpty():
        return found
    return components(first.unionByName(second))


# Rounds of heads after the first, at most, and pairs that one task makes of a bucket.
ROUNDS, TASK_PAIRS = 3, 100_000
# A bucket has another round if more members than this are outside its heads' components, and the
# round before compared at least one in so many of its members.
CROWD, WORTH = 200, 50
# Pairs whose signatures or texts move in one turn: as many as there are ids, but no fewer than this.
TURN = 50_000


def linked_components(
    members: DataFrame, near: str, measure: Callable[[DataFrame], DataFrame], similarity: float, sigs: DataFrame | None = None,
    agree: str = "true",
) -> DataFrame:
    """(id, component) of the links among ids that share a bucket: distinct rows (key, id, sig) of buckets of two or more, of a table that was written.

    ``near`` is SQL that tells from the signatures ``x`` and ``y`` whether two ids may be linked;
    ``measure`` takes distinct pairs (a, b) and returns (a, b, j), their Jaccard similarities; links
    have at least ``similarity``. With ``sigs`` (id, sig), a written table too, ``members`` need
    no signatures. ``agree`` is such SQL of a column ``brief`` of ``members``, a few bytes by which most pairs
    are told apart before signatures move. Not all pairs of a bucket are formed. Its members meet its head,
    the smallest id; those of crowded buckets then meet, in ROUNDS more at most, the smallest id outside
    the components of earlier heads, until a round has next to nothing left to compare there.
    Then those outside the first head's component meet the others that they are not joined
    with, unless a head tells the two apart: one less the similarity is a distance, so two that
    differ by more than a link allows in their distance from a head are no link. No link among
    near pairs that could join two components is passed over, and a bucket whose members are
    near its heads costs a pair for each.

    Signatures are wide, and an id has a place in many buckets: buckets are kept as numbers, and
    signatures move for pairs, in turns that move about as many as there are ids, or TURN. What was
    shuffled for a turn is freed before the next.
    """
    if sigs is None:
        sigs = keep_table(members.dropDuplicates(["id"]).select("id", "sig"))
    brief = F.col("brief") if "brief" in members.columns else F.lit(0).alias("brief")
    members, most = members.select("key", "id", brief), max(TURN, sigs.count())
    agrees = agree.format(x="brief", y="_h.brief")

    def sifted(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a")
        met = met.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
        return met.where(near.format(x="x", y="y")).select("a", "b")

    def compared(state: DataFrame) -> DataFrame:
        """(a, b, j) of the pairs of ``state`` that may be links."""
        pairs = _in_turns(keep_table(_met(state)), most, sifted)
        return _in_turns(pairs, most, measure)

    state = members.join(members.groupBy("key").agg(F.min_by(F.struct("id", "brief"), "id").alias("_h")), "key")
    state = state.select("key", "id", "brief", F.col("_h.id").alias("head"), F.expr(f"id <> _h.id AND {agrees}").alias("meets"))
    told = compared(state)
    enough = F.col("j") >= similarity
    links = told.where(enough).select("a", "b")
    found = keep_table(components(links, keep_table))
    state = _told(_open(state, found), told)
    members = keep_table(state.select("key", "id", "brief", F.array("d").alias("d"), (F.col("id") == F.col("head")).alias("is_head")))
    for _ in range(ROUNDS):
        placed = _placed(members, found)
        lead = placed.where("is_head").select(F.col("key").alias("_k"), F.col("component").alias("_c")).distinct()
        rest = placed.join(lead, (F.col("key") == F.col("_k")) & (F.col("component") == F.col("_c")), "left_anti")
        heads = rest.groupBy("key").agg(F.min_by(F.struct("id", "component", "brief"), "id").alias("_h"), F.count("*").alias("n")).where(F.col("n") > CROWD)
        worth = members.groupBy("key").agg(F.count("*").alias("n"), F.count(F.element_at("d", -1)).alias("told")).where(F.col("told") * WORTH > F.col("n"))
        heads = keep_table(heads.select("key", "_h").join(worth.select("key"), "key", "left_semi"))
        if heads.isEmpty():
            break
        state = _placed(members, found).join(heads, "key", "left")
        meets = F.expr(f"NOT is_head AND id <> _h.id AND component <> _h.component AND {agrees}")
        state = state.withColumns({"meets": F.coalesce(meets, F.lit(False)), "head": F.col("_h.id")})
        state = keep_table(state.drop("_h", "component"))
        told = compared(state)
        is_head = F.col("is_head") | F.coalesce(F.col("id") == F.col("head"), F.lit(False))
        found = _joined(found, told.where(enough).select("a", "b"))
        state = _told(_open(state, found), told)
        members = keep_table(state.select("key", "id", "brief", F.concat("d_old", F.array("d")).alias("d"), is_head.alias("is_head")))
    placed = keep_table(_placed(members, found))
    lead = placed.groupBy("key").agg(F.min_by("component", "id").alias("_c"))
    placed = placed.join(lead, "key").where("NOT is_head").withColumn("_r", F.col("component") != F.col("_c")).drop("_c", "is_head")
    sizes = placed.groupBy("key").agg(F.count("*").alias("_m"), F.count_if("_r").alias("_n")).where("_n > 0")
    lanes = F.least(F.ceil(F.col("_n") * F.col("_m") / TASK_PAIRS), F.col("_n")).cast("int").alias("lanes")
    placed = keep_table(placed.join(sizes.select("key", lanes), "key"))
    moved = placed.agg(F.sum("lanes") + F.count_if("_r")).first()[0]
    if not moved:
        return found
    apart = f"exists(zip_with(da, db, (p, q) -> coalesce(abs(p - q) > {1 - similarity + 1e-9!r}D, false)), v -> v)"
    turns = -(-moved // most)
    turn = F.pmod(F.xxhash64("key", "lane"), F.lit(turns))
    pairs = []
    for k in range(turns):
        left = placed.where("_r").withColumn("lane", F.pmod(F.xxhash64("id"), F.col("lanes").cast("long")).cast("int")).where(turn == k)
        right = placed.withColumn("lane", F.explode(F.expr("sequence(0, lanes - 1)"))).where(turn == k)
        left = left.join(sigs, "id").select("key", "lane", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("d").alias("da"), F.col("brief").alias("bx"), F.col("sig").alias("x"))
        right = right.join(sigs, "id").select("key", "lane", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("d").alias("db"), "_r", F.col("brief").alias("by"), F.col("sig").alias("y"))
        met = left.join(right, ["key", "lane"]).where(f"ca <> cb AND (NOT _r OR a < b) AND {agree.format(x='bx', y='by')}").where(near.format(x="x", y="y")).where(f"NOT {apart}")
        pairs.append(keep_table(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    pairs = keep_table(reduce(DataFrame.unionByName, pairs).distinct()) if turns > 1 else pairs[0]
    new = _in_turns(pairs, most, measure).where(enough).select("a", "b")
    return _joined(found, new)


def _joined(found: DataFrame, new: DataFrame) -> DataFrame:
    """(id, component) of what ``found`` holds together and ``new`` links (a, b) join; stars that are there take few rounds."""
    if new.isEmpty():
        return found
    stars = found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return keep_table(components(stars.unionByName(new), keep_table))


def _in_turns(pairs: DataFrame, most: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` makes of pairs (a, b) of a written table, about ``most`` at a time, as written tables."""
    turns = max(1, -(-pairs.count() // most))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(turns))
    return reduce(DataFrame.unionByName, [keep_table(work(pairs.where(turn == k) if turns > 1 else pairs)) for k in range(turns)])


def _met(state: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of ids and the heads they meet."""
    pairs = state.where("meets").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    return pairs.distinct()


def _open(state: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets of three or more that are not all in one component: in the others all is decided."""
    placed = _placed(state.select("key", "id"), found)
    mixed = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("_n"))
    return state.join(mixed.where("_lo <> _hi AND _n > 2").select("key"), "key", "left_semi")


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with component; what is linked with nothing is a component of its own."""
    placed = members.join(found, "id", "left")
    return placed.select(*members.columns, F.coalesce("component", "id").alias("component"))


def _told(state: DataFrame, told: DataFrame) -> DataFrame:
    """``state`` with ``d``, the distance from the head where it was measured; an earlier ``d`` is ``d_old``."""
    state = state.withColumnRenamed("d", "d_old")
    same = (F.least("id", "head") == F.col("a")) & (F.greatest("id", "head") == F.col("b"))
    distance = F.when(F.col("id") == F.col("head"), F.lit(0.0)).otherwise(1 - F.col("j"))
    return state.join(told, same, "left").withColumn("d", distance)
