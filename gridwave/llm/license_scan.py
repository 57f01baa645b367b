"""Licence notices in texts: MinHash bands retrieve templates, shingle containment verifies them.

Texts are cut into words (lower case, runs of letters and digits) and into windows of
``WINDOW`` words that start every ``STRIDE`` words, so each window holds 4 shingles of 5
words and each shingle is in one window. A window's MinHash values (the smallest of its
shingle hashes in each of ``BANDS`` orders) are compared with
those of all templates, one value to a band: a window with one shingle of a template of
one shingle meets it in a band with probability 1/4, in none of 40 bands in 1 of 100,000;
windows inside longer templates meet them more often. Candidates are verified by the
exact share of the template's shingles within reach of the window. A template of fewer
words than a shingle is one shingle, of all its words in their order; a set of hashes at
every word of a text finds these, and their words verify them.

The values of the templates are constants of the plan (at most ``MAX_TEMPLATES`` times
``BANDS`` numbers), so the scan is one pass of expressions; only hits move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.llm.common import keep, mixers, turned

SHINGLE, STRIDE = 5, 4
WINDOW = SHINGLE + STRIDE - 1
BANDS = 40
CONTAINMENT = 0.8
MAX_TEMPLATES = 10_000

# Notices that name a licence, as their authors ask to place them.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("lgpl-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
# Notices of fewer words than a shingle.
SHORT_NOTICES = (("all-rights-reserved", "All rights reserved."),)

_WORDS = "split(lower({}), '[^\\\\p{{L}}\\\\p{{N}}]+')"
_TRIMMED = "regexp_replace(text, '^[^\\\\p{L}\\\\p{N}]+|[^\\\\p{L}\\\\p{N}]+$', '')"
_TURNS, _SEED = 8, 1


def words(column: str) -> Column:
    """The words of a text; at its ends there may be an empty one, which is no word of any template."""
    return F.expr(_WORDS.format(column))


def _shingle(at: str, array: str = "_w") -> str:
    return "xxhash64(" + ", ".join(f"{array}[int({at}) + {k}]" for k in range(SHINGLE)) + ")"


def _cut(templates: DataFrame) -> DataFrame:
    trimmed = F.expr(_TRIMMED)
    return templates.select("template_id", trimmed.alias("_t")).dropna().distinct().select("template_id", words("_t").alias("_w"))


def prepare(templates: DataFrame) -> DataFrame:
    """(template_id, shingles, span) of rows (template_id, text): distinct shingle hashes, and how many there are in a row.

    Null and repeated rows are passed over; a template of fewer than 5 words fails: those are for ``prepare_short``.
    """
    cut = _cut(templates)
    short = F.raise_error(F.concat(F.lit("template with too few words: "), F.col("template_id").cast("string")))
    cut = cut.where(F.when(F.size("_w") < SHINGLE, short).otherwise(F.lit(True)))
    listed = F.expr(f"transform(sequence(0, size(_w) - {SHINGLE}), i -> {_shingle('i')})")
    return cut.select("template_id", F.array_distinct(listed).alias("shingles"), (F.size("_w") - SHINGLE + 1).alias("span"))


def prepare_short(templates: DataFrame) -> DataFrame:
    """(template_id, words, shingle) of the templates of fewer than 5 words; one without any word fails."""
    none = F.raise_error(F.concat(F.lit("template without words: "), F.col("template_id").cast("string")))
    cut = _cut(templates).where(F.when(F.element_at("_w", 1) == "", none).otherwise(F.size("_w") < SHINGLE))
    return cut.select("template_id", F.col("_w").alias("words"), F.expr("xxhash64(_w)").alias("shingle"))


def scan_short(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Like ``scan``, for templates of fewer than 5 words: a template is one shingle, of all its words."""
    ready = keep(prepare_short(templates))
    known = ready.limit(MAX_TEMPLATES + 1).collect()
    if len(known) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    hashes: dict[int, set[int]] = {}
    for r in known:
        hashes.setdefault(len(r["words"]), set()).add(r["shingle"])
    cut = docs.select("doc_id", words("text").alias("_w"))
    places = [F.expr("CAST(array() AS array<struct<at: int, n: int>>)")]
    for n, of_templates in sorted(hashes.items()):
        at = "xxhash64(" + ", ".join(f"_w[i + {k}]" for k in range(n)) + ")"
        listed = ", ".join(f"{h}L" if h > -(1 << 63) else "-9223372036854775807L - 1L" for h in sorted(of_templates))
        found = f"filter(sequence(0, size(_w) - {n}), i -> {at} IN ({listed}))"
        places.append(F.expr(f"CASE WHEN size(_w) >= {n} THEN transform({found}, i -> struct(i AS at, {n} AS n)) ELSE array() END"))
    placed = cut.select("doc_id", "_w", F.explode(F.concat(*places)).alias("_p"))
    said = placed.select("doc_id", F.expr("_p.at").alias("_at"), F.expr("slice(_w, _p.at + 1, _p.n)").alias("words"))
    met = said.join(F.broadcast(ready.select("template_id", "words").distinct()), "words")
    shared = met.groupBy("doc_id", "template_id").agg(F.min("_at").cast("long").alias("first_word"))
    return shared.select("doc_id", "template_id", F.lit(1.0).alias("containment"), "first_word").where(F.col("containment") >= containment)


def _of_words(templates: DataFrame, few: bool) -> DataFrame:
    """The templates of fewer than 5 words, or the others."""
    size = F.size(words("_t"))
    trimmed = templates.withColumn("_t", F.expr(_TRIMMED)).where(F.col("text").isNotNull())
    return trimmed.where(size < SHINGLE if few else size >= SHINGLE).drop("_t")


def scan(
    docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT, bands: int = BANDS, short: bool = False
) -> DataFrame:
    """(doc_id, template_id, containment, first_word) of the notices in ``docs`` (doc_id, text).

    One row per document and template of which at least that share of distinct shingles
    stands in one place; first_word is the number of the word where the first such place
    begins. Null texts hold none; rows with one id are one document; empty tables give no
    rows. At most ``MAX_TEMPLATES`` templates. With ``short``, templates of fewer than 5
    words are found as well, wherever all their words stand in a row; without it they fail.
    """
    if short:
        return scan(docs, _of_words(templates, few=False), containment, bands).unionByName(
            scan_short(docs, _of_words(templates, few=True), containment)
        )
    ready = keep(prepare(templates))
    known = ready.limit(MAX_TEMPLATES + 1).collect()
    if len(known) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    orders = mixers(bands, _TURNS, _SEED)
    kept = {t: f"_t{t}" for t, _ in orders}
    # Every template's smallest value in each order.
    spread = ready.select(
        "*",
        F.posexplode(F.array(*[
            F.expr(f"array_min(transform(shingles, s -> ({turned('s', t)}) ^ {c}L))") for t, c in orders
        ])).alias("_band", "_value"),
    )
    least: list[set[int]] = [set() for _ in orders]
    for r in spread.select("_band", "_value").collect():
        least[r["_band"]].add(r["_value"])
    reach = max((r["span"] for r in known), default=1) - 1

    cut = docs.select("doc_id", words("text").alias("_w")).where(f"size(_w) >= {SHINGLE}")
    windows = cut.select("*", F.explode(F.expr(f"sequence(0, size(_w) - {SHINGLE}, {STRIDE})")).alias("_at"))
    last = f"size(_w) - {SHINGLE}"
    # Words within reach of the window, with the place of the first of them: all that verification needs.
    near = f"slice(_w, greatest(_at - {reach}, 0) + 1, {2 * reach + WINDOW})"
    hashed = windows.select(
        "doc_id", "_w", "_at", *[F.expr(_shingle(f"least(_at + {j}, {last})")).alias(f"_s{j}") for j in range(STRIDE)]
    )
    values = [F.col(f"_v{k}") for k in range(bands)]
    turns = hashed.select("doc_id", "_w", "_at", *[
        F.expr(turned(f"_s{j}", t)).alias(f"{name}_{j}") for t, name in kept.items() for j in range(STRIDE)
    ])
    signed = turns.select("doc_id", "_w", "_at", *[
        F.least(*[F.col(f"{kept[t]}_{j}").bitwiseXOR(F.lit(c)) for j in range(STRIDE)]).alias(f"_v{k}")
        for k, (t, c) in enumerate(orders)
    ])
    hit = F.lit(False)
    for value, of_templates in zip(values, least):
        hit = hit | value.isin(sorted(of_templates))
    # A filter would be moved below and compute every hash once per band; a generator of one row or none is not.
    hits = signed.select("*", F.explode(F.when(hit, F.array(F.lit(True)))).alias("_hit")).select(
        "doc_id", F.expr(near).alias("_n"), F.expr(f"greatest(_at - {reach}, 0)").alias("_from"), "_at",
        F.posexplode(F.array(*values)).alias("_band", "_value"),
    )
    # At most MAX_TEMPLATES x bands rows of a bounded number of hashes.
    met = hits.join(F.broadcast(spread), ["_band", "_value"])
    # Per template the shingles that could belong to a copy around the window.
    inside = met.withColumn(
        "_found",
        F.expr(
            f"filter(transform(sequence(0, size(_n) - {SHINGLE}), i -> struct(_from + i AS at, {_shingle('i', '_n')} AS s)),"
            f" x -> x.at BETWEEN _at - span + 1 AND _at + {STRIDE - 1} + span - 1 AND array_contains(shingles, x.s))"
        ),
    )
    share = F.size(F.array_distinct(F.col("_found.s"))) / F.size("shingles")
    return (
        inside.select("doc_id", "template_id", share.alias("containment"), F.array_min(F.col("_found.at")).alias("first_word"))
        .where(F.col("containment") >= containment)
        .groupBy("doc_id", "template_id")
        .agg(F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"))
    )



def notices(spark: SparkSession, short: bool = False) -> DataFrame:
    """NOTICES, with ``short`` also SHORT_NOTICES, as a table (template_id, text)."""
    listed = NOTICES + SHORT_NOTICES if short else NOTICES
    rows = F.array(*[F.struct(F.lit(i).alias("template_id"), F.lit(t).alias("text")) for i, t in listed])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def oracle(containment: float = CONTAINMENT) -> str:
    """The same as DuckDB SQL over ``documents``, by joining all shingles."""
    listed = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in NOTICES + SHORT_NOTICES)
    cut = "string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+')"
    return f"""
WITH templates(template_id, text) AS (VALUES {listed}),
tw AS (SELECT template_id, {cut.format("regexp_replace(text, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')")} AS w FROM templates),
ts AS (SELECT DISTINCT template_id, len(w) - 4 AS span, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
       FROM tw, unnest(range(1, len(w) - 3)) AS u(i)),
tn AS (SELECT template_id, count(*) AS n FROM ts GROUP BY template_id),
dw AS (SELECT doc_id, {cut.format("text")} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM dw, unnest(range(1, len(w) - 3)) AS u(i)),
m AS (SELECT doc_id, template_id, pos, s, span FROM ds JOIN ts USING (s)),
wins AS (SELECT DISTINCT doc_id, template_id, span, pos // 4 * 4 AS win FROM m),
shares AS (
  SELECT wins.doc_id, wins.template_id, win, count(DISTINCT s) / any_value(n) AS containment, min(pos) AS first_word
  FROM wins JOIN m ON m.doc_id = wins.doc_id AND m.template_id = wins.template_id
       AND m.pos BETWEEN win - wins.span + 1 AND win + 3 + wins.span - 1
  JOIN tn ON tn.template_id = wins.template_id
  GROUP BY wins.doc_id, wins.template_id, win),
brief AS (SELECT template_id, array_to_string(w, ' ') AS s, len(w) AS n FROM tw WHERE len(w) < 5),
found AS (
  SELECT doc_id, template_id, containment, first_word FROM shares
  UNION ALL
  SELECT doc_id, template_id, 1.0, i - 1
  FROM dw, brief, unnest(range(1, len(dw.w) - brief.n + 2)) AS u(i) WHERE array_to_string(w[i:i + n - 1], ' ') = s)
SELECT doc_id, template_id, max(containment)::DOUBLE AS containment, min(first_word)::BIGINT AS first_word
FROM found WHERE containment >= {containment} GROUP BY doc_id, template_id"""
