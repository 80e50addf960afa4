"""The queries of this subpackage: opN_<name>(spark, sf_dir) for each operator, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import imatch, minhash, oracles, packing, pii, quality, repair, resample, sampling, secrets, simhash, suffixtree, topk, trie
from .common import table


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over ``documents``: fingerprints of each text and its edited text, and their likeness."""
    return imatch.with_edits(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over ``documents``: doc_id, fingerprint (16 hex digits), component_id."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over ``documents``, learning from ``labels`` outside fold 0 of 5: doc_id, held_out, score, predicted."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over ``documents``: a row for each piece."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), False, 1)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over ``documents``: doc_id, n_entities, kinds, text with surrogates."""
    return pii.replace(table(spark, sf_dir, "documents"), key=pii.PUBLIC_TEST_KEY)


def op6_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over ``documents``: written in ascending order as Re-Pair shards and read back."""
    return repair.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), True, 0)


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over ``documents``, learning from rows outside fold 2 of 7."""
    return suffixtree.score(table(spark, sf_dir, "documents"), suffixtree.held())


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over ``documents``: sizes, targets and the words that the mix takes of each document."""
    rows = sampling.copies(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over ``documents``: counts of the base kinds, their digest, and all spans."""
    rows = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [secrets.count(F.col("base_spans"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return rows.select("doc_id", *n, F.sha2(F.encode(secrets.told(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256"), secrets.told(F.col("spans")).alias("spans"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over ``embeddings``: the ten best of all rows for every row whose vec_id is divisible by 100."""
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over ``conversations``, rebuilt from heads of others: a row for each node of their prefix trie."""
    return trie.prefix_trie(*trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over ``documents``: doc_id, n_shingles, component_id, kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: ``documents`` drawn towards the n-grams of ``benchmark``; a row for every document."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_imatch_fingerprints, op2_simhash_near_dedup, op3_quality_cnn, op4_power_of_two_packing, op5_pii_surrogates,
        op6_repair_shards, op7_suffix_tree_scores, op8_systematic_mix, op9_secret_scan, op10_exact_top_k, op11_prefix_trie,
        op12_tensored_minhash, op13_importance_resampling,
    )
}

#: None for 1 to 7 (fingerprints, networks, tokenizers and suffix trees are no SQL); 9 needs positions of matches.
ORACLE_SQL: dict[str, str] = {
    "op8_systematic_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS DOUBLE) AS cap,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size, least(cap, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()) AS target FROM l),
r AS (
  SELECT d.source, d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.key) - 1 AS DOUBLE) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (
  SELECT *, CAST('0x' || substr(md5('mix:offset:' || coalesce(source, 'null')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM r)
SELECT doc_id, size, source_size, target, CAST(size * (floor(u + (rank + 1) * rate) - floor(u + rank * rate)) AS BIGINT) AS taken
FROM o""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 10""",
    "op11_prefix_trie": oracles.TRIE,
    "op12_tensored_minhash": oracles.NEAR,
    "op13_importance_resampling": oracles.RESAMPLE,
}
