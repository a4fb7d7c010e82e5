"""One query for each operator of this package, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, with_package
from . import bpe, byte_bpe, decontaminate, manifest_sql, merkle, near_dup, passages, quality, secret_scan, sharding, token_files, top_k, toxicity, turn_trie
from .registry import REGISTRY


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return with_package(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends there."""
    path = scratch_path(with_package(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@REGISTRY.add("op1_bpe")
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@REGISTRY.add("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return found.select(
        "doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@REGISTRY.add("op6_token_files")
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(
        table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )
    return token_files.checksums(token_files.read_tokens(spark, path))


@REGISTRY.add("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(table(spark, folder, "documents"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@REGISTRY.add("op5_top_k", TOP_K_SQL)
def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.search(table(spark, folder, "embeddings"), "vec_id % 50 = 0", k=5)


SHARDS, SLOTS = 32, 4099
SHARDING_SQL = f"""
WITH RECURSIVE {sharding.fill_sql("'shard-' || i", SHARDS, SLOTS)},
keyed AS (
  SELECT doc_id,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot
  FROM documents)
SELECT doc_id, slot::INTEGER AS slot, shard::INTEGER AS shard, 'shard-' || shard AS shard_name
FROM keyed JOIN slots USING (slot)"""


@REGISTRY.add("op9_sharding", SHARDING_SQL)
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    names = [f"shard-{i}" for i in range(SHARDS)]
    return sharding.place(table(spark, folder, "documents").select("doc_id"), "doc_id", names, SLOTS)


@REGISTRY.add("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(
        table(spark, folder, "documents"), table(spark, folder, "labels"), lambda df: written(df, "toxicity")
    )


@REGISTRY.add("op10_quality")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@REGISTRY.add("op3_passages")
def op3_passages(spark: SparkSession, folder: str) -> DataFrame:
    left = passages.remove_repeats(table(spark, folder, "documents"), lambda df: written(df, "passages"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@REGISTRY.add("op7_near_dup")
def op7_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dup.classes(table(spark, folder, "documents"), lambda df: written(df, "near-dup"))
    return found.select("doc_id", "copy_of", "class_id")


@REGISTRY.add("op8_decontaminate", decontaminate.matches_sql())
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), lambda df: written(df, "benchmark")
    )
    return found.select("doc_id", "item_id", "similarity", "start")


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@REGISTRY.add("op12_merkle", manifest_sql.audit_sql())
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = merkle.digest_of(plain)
    tampered = merkle.digest_of([*plain[:-1], F.translate("text", CAPITALS, SMALL)])
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    save = lambda df: written(df, "merkle")
    manifest = merkle.build(
        docs, save, F.col("lang"), F.col("doc_id"), leaf, F.when(third, tampered).otherwise(leaf)
    )
    return merkle.audit(manifest, save).withColumnRenamed("id", "doc_id")


TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         strlen(coalesce(text, '')) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM t GROUP BY c),
convs AS (
  SELECT c, {manifest_sql.crc32_sql("c::VARCHAR")} % 9 AS h, c - ((c % 5) + 5) % 5 AS base FROM sizes),
rebuilt AS (
  SELECT v.c, t.p, t.k, t.bytes FROM convs v JOIN t ON t.c = v.base AND t.p <= v.h
  UNION ALL
  SELECT v.c, t.p - v.h + least(v.h, coalesce(b.n, 0)), t.k, t.bytes
  FROM convs v JOIN t ON t.c = v.c AND t.p > v.h LEFT JOIN sizes b ON b.c = v.base),
prefixes AS (
  SELECT c, p AS depth, bytes, list(k) OVER (PARTITION BY c ORDER BY p) AS turns FROM rebuilt
  UNION ALL SELECT c, 0, 0, [] FROM convs),
lengths AS (SELECT c, max(depth) AS len FROM prefixes GROUP BY c),
nodes AS (
  SELECT turns, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = len), '') AS ends
  FROM prefixes JOIN lengths USING (c) GROUP BY turns, depth),
kids AS (
  SELECT turns[1:depth - 1] AS turns, depth - 1 AS depth, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY 1, 2),
known AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (turns, depth)),
ancestry AS (
  SELECT unnest(range(0, depth + 1)) AS level, turns, n_children, (n_convs - 1) * bytes AS saved FROM known),
sums AS (
  SELECT turns[1:level] AS turns, level AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
         sum(saved)::BIGINT AS saved_tokens
  FROM ancestry GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM known n JOIN sums s USING (turns, depth)
LEFT JOIN known p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.turns = n.turns[1:n.depth - 1]"""


@REGISTRY.add("op13_turn_trie", TRIE_SQL)
def op13_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    save = lambda df: written(df, "trie")
    found = turn_trie.sequences(table(spark, folder, "conversations"), save)
    own = F.col("conv_id")
    head = (F.crc32(own.cast("string")) % 9).cast("int")
    return turn_trie.trie(turn_trie.rebuilt(found, own - F.pmod(own, F.lit(5)), head, 8), save)
