"""A corpus pipeline of five operators: quality, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridica.llm import packing, quality, sampling, secrets, simhash
from veridica.llm.common import new_path, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores below 0.3 go. It learns from ``labels``, outside fold 0 of 5, and the texts of
    ``docs``. Null texts are scored as empty ones; repeated rows go or stay together; nothing gives nothing; any columns pass."""
    labels = table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels.where(quality.fold(F.col("doc_id"), 5) != 0))
    (out,) = unused(docs.columns, "_score")
    return quality.score(docs, net, out=out).where(F.col(out) >= 0.3).drop(out)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of least doc_id (null ids last). Texts without words, null ones
    among them, are one group; of rows that repeat one stays; nothing gives nothing; any columns pass."""
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents without any stay as they are. n_chars follows the text: null for null texts. Repeated rows
    stay; nothing gives nothing; any columns pass."""
    return secrets.mask(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them. Null sources are one source, null texts have no words and are
    taken by their rank like any other; equal rows are interchangeable; nothing gives nothing; any columns pass."""
    return sampling.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with their ids. Null and empty texts are the end id alone; repeated rows are packed each;
    nothing gives nothing; further columns are not read."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), False, 1, with_ids=True)


STAGES = [
    ("quality_cnn", quality_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("secret_scan", secrets_stage),
    ("systematic_mix", mixture_stage),
    ("power_of_two_packing", packing_stage),
]

#: A network, SimHash and a tokenizer are no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
