"""One query per operator, over whole tables, with equivalent SQL where it can be stated."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwave.llm import (
    bpe, collocations, embedding_dedup, filter_audit, fingerprints, license_scan, line_dedup, mixing, packing, quality, sharding,
    simhash_dedup, token_counts,
)
from gridwave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, license_scan.notices(spark, short=True), short=True)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}),
reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(r) AS component_id,
       vec_id = min(r) AS kept
FROM reach GROUP BY vec_id"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.decode(bpe.encode(docs, VOCABULARY, keep_text=False), VOCABULARY)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"]).select("doc_id", "slot", "shard")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
OP5_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, {_HASH.format("printf('shard-%02d/offset', i)")} % {sharding.SIZE} AS o,
         {_HASH.format("printf('shard-%02d/step', i)")} % {sharding.SIZE - 1} + 1 AS s
  FROM range({len(sharding.SHARDS)}) t(i)),
orders AS (
  SELECT i, list((o + k * s) % {sharding.SIZE} ORDER BY k) AS slots
  FROM shards, range({sharding.SIZE}) t(k) GROUP BY i),
turns AS (
  SELECT 0 AS t, NULL::BIGINT AS slot, repeat('0', {sharding.SIZE})::BIT AS taken
  UNION ALL
  SELECT t + 1, slot, set_bit(taken, slot::INTEGER, 1)
  FROM (SELECT t, taken, list_filter(slots, lambda x: get_bit(taken, x::INTEGER) = 0)[1] AS slot
        FROM turns JOIN orders ON i = t % {len(sharding.SHARDS)} WHERE t < {sharding.SIZE})),
lookup AS (SELECT slot, printf('shard-%02d', (t - 1) % {len(sharding.SHARDS)}) AS shard FROM turns WHERE t > 0)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, {_HASH.format("coalesce(doc_id::VARCHAR, '')")} % {sharding.SIZE} AS slot FROM documents)
JOIN lookup USING (slot)"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    judged = quality.score(docs, model, keep_text=False)
    return judged.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets two edits: its first 20 characters replace 12 of them at a third, and a word goes in at two thirds."""
    size = F.coalesce(F.length("text"), F.lit(0))
    edits = F.array(
        F.struct(
            F.floor(size / 3).alias("start"), F.lit(12).cast("long").alias("length"),
            F.substring(F.coalesce("text", F.lit("")), 1, 20).alias("replacement"),
        ),
        F.struct(
            F.floor(size * 2 / 3).alias("start"), F.lit(0).cast("long").alias("length"),
            F.lit(" revised ").alias("replacement"),
        ),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return token_counts.count(docs, VOCABULARY)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decide(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_document_fingerprints, op3_embedding_dedup, op4_byte_bpe, op5_shard_placement, op6_simhash_dedup, op7_quality, op8_token_counts,
        op9_line_dedup, op10_source_mix, op11_best_fit_packing, op12_phrase_collocations, op13_filter_audit,
    )
}
ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(), "op3_embedding_dedup": OP3_SQL, "op5_shard_placement": OP5_SQL, "op10_source_mix": mixing.oracle(),
    "op12_phrase_collocations": collocations.oracle(), "op13_filter_audit": filter_audit.oracle(),
}
