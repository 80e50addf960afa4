"""The driver tables in the shapes that the operators work on: chunks, beliefs, manifest, queries, series, pixels.

Every view is a deterministic projection; ``plans/oracle_views.py`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..schema import FACETS, GENERAL_TOPIC, N_STAGES, NEIGHBOUR, STAGE_NAMES, TOPICS, UNSTAGED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: tuple[str, ...], i: Column) -> Column:
    """names[i], i from 0."""
    return F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)


def compat_of(stage: Column) -> Column:
    """1 at the stage, NEIGHBOUR beside it; all UNSTAGED where ``stage`` is no stage."""
    near = F.transform(F.sequence(F.lit(0), F.lit(N_STAGES - 1)), lambda k: F.when(k == stage, 1.0).when(F.abs(k - stage) == 1, NEIGHBOUR).otherwise(0.0))
    return F.when(stage.between(0, N_STAGES - 1), near).otherwise(F.array(*[F.lit(UNSTAGED)] * N_STAGES))


def _named() -> list[Column]:
    i = F.col("doc_id")
    return [F.format_string("C%06d", i).alias("chunk_id"), F.col("text"), pick(TOPICS, i % 9).alias("topic")]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, text, topic) of ``chunks``, whose join with labels can exchange all texts. Without its columns that join only says how
    often a document is taken, so it needs the ids that are labelled more than once (none, if labels are sound), which are broadcast."""
    again = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
    d = table(spark, sf_dir, "documents").join(F.broadcast(again), "doc_id", "left")
    return d.withColumn("_k", F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)).cast("int")))).select(*_named())


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as governed chunks."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        *_named(),
        compat_of((i % 7).cast("int")).alias("stage_compatibility"),
        (((i * 37) % 101) / 100.0).alias("authority_score"),
        pick((*FACETS, "general"), F.floor(i / 9) % 5).alias("facet"),
        F.col("source").alias("source_id"),
        F.when(F.col("quality") == 1, "reviewed").when(F.col("quality") == 0, "machine_curated_pending_domain_review").otherwise("unreviewed").alias("review_status"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("production_eligible"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("restricted_action"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("r"), (i % 3).cast("string")))).alias("region"),
        F.when(i % 5 == 0, F.array(F.lit("general"))).when(i % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("v"), (i % 2).cast("string")))).alias("varieties"),
        F.col("lang").alias("language"),
    )


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as classifier outputs: logits, belief = softmax, truth, model, split."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    truth = F.col("label") % N_STAGES
    logits = F.array(*(10.0 * F.col("embedding")[k].cast("double") + F.when((truth == k) & (F.col("vec_id") % 4 != 0), 2.5).otherwise(0.0) for k in range(N_STAGES)))
    e = e.select("vec_id", truth.cast("int").alias("truth"), logits.alias("logits"), F.when(F.col("vec_id") % 5 == 0, "validation").when(F.col("vec_id") % 5 == 1, "test").otherwise("train").alias("split"))
    e = e.withColumn("belief", vec.softmax(F.col("logits")))
    return e.withColumn("predicted", vec.argmax(F.col("belief"))).withColumn("confidence", F.array_max("belief"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as an image manifest."""
    i, label = F.col("vec_id"), F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.format_string("img%06d", i).alias("image_id"),
        F.concat(F.lit("s"), label.cast("string"), F.lit("/"), F.format_string("p%05d", F.floor(i / 3)), F.lit("_subset_overlap_"), (i % 3).cast("string"), F.lit(".jpg")).alias("image_path"),
        F.format_string("p%05d", F.floor(i / 3)).alias("parent_image_id"),
        label.cast("string").alias("capture_session"),
        pick(STAGE_NAMES, label % N_STAGES).alias("macro_stage"),
    )


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 64-bit average hashes: a bit for each of 64 values above their mean."""
    from ..operators.neardup import average_hash

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", average_hash(F.col("embedding")).alias("h"))


def topic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark texts as queries of a topic."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), pick(TOPICS, F.col("item_id") % 9).alias("topic"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pixel counts of six classes."""
    i = table(spark, sf_dir, "lineitem")
    part, n = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    return i.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("image"),
        F.concat(F.lit("p"), (F.col("l_orderkey") % 500).cast("string")).alias("parent"),
        ((part * 7 + n) % 900).alias("class_0"),
        ((F.col("l_quantity").cast("long") * 37 + part) % 800).alias("class_1"),
        ((part * 3 + n * 11) % 120).alias("class_2"),
        F.when(part % 3 == 0, (part + n) % 40).otherwise(F.lit(0)).cast("long").alias("class_3"),
        (part % 25).alias("class_4"),
        (n * 2).alias("class_5"),
    )


__all__ = ["GENERAL_TOPIC", "beliefs", "chunks", "compat_of", "hashes", "manifest", "pick", "pixels", "table", "topic_queries"]
