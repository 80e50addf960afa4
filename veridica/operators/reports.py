"""Composite reports: comparisons of models, of loss variants and of retrieval methods; leak pairs; weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from . import stats

LOWER_IS_BETTER = ("sirr_at_k",)


def aligned(a: DataFrame, b: DataFrame, key: str = "image_id", truth: str = "truth", value: str = "predicted") -> DataFrame:
    """(key, truth, a, b) of the images that both runs have; an image with two truths fails the job."""
    right = b.select(key, F.col(truth).alias("_t"), F.col(value).alias("b"))
    both = a.select(key, F.col(truth).alias(truth), F.col(value).alias("a")).join(right, key)
    clash = F.raise_error(F.concat(F.lit("labels differ: "), F.col(key).cast("string"))).cast("int")
    return both.select(key, F.when(F.col(truth).eqNullSafe(F.col("_t")), F.col(truth)).otherwise(clash).alias(truth), "a", "b")


def loss_variants(a: DataFrame, b: DataFrame, key: str = "image_id", replicates: int = 1000, **names: str) -> DataFrame:
    """(metric, diff, low, high, boot_p, test, p_value) of run ``a`` less run ``b``: correctness with McNemar's test, stage
    distance with Wilcoxon's. Both runs' rows meet once."""
    rows = saved(aligned(a, b, key, **names), "aligned")
    truth = names.get("truth", "truth")
    right = lambda c: (F.col(c) == F.col(truth)).cast("int")
    far = lambda c: F.abs(F.col(c) - F.col(truth))
    long = rows.select(key, F.explode(F.array(F.struct(F.lit("correct").alias("metric"), (right("a") - right("b")).cast("double").alias("d")), F.struct(F.lit("distance").alias("metric"), (far("a") - far("b")).cast("double").alias("d")))).alias("x")).select(key, "x.*")
    boot = stats.bootstrap(long, replicates, key=key, by=["metric"]).withColumnRenamed("p", "boot_p")
    cells = rows.agg(F.count_if((right("a") == 1) & (right("b") == 0)).alias("x"), F.count_if((right("a") == 0) & (right("b") == 1)).alias("y"))
    paired = cells.select(F.lit("correct").alias("metric"), F.lit("mcnemar").alias("test"), stats.mcnemar_p(F.col("x"), F.col("y")).alias("p_value"))
    ranked = stats.wilcoxon(long.where("metric = 'distance'")).select(F.lit("distance").alias("metric"), F.lit("wilcoxon").alias("test"), stats.two_sided_p(F.col("z")).alias("p_value"))
    return boot.join(F.broadcast(paired.union(ranked)), "metric")


def retrieval_significance(metrics: DataFrame, candidate: str, baselines: list[str], columns: list[str], replicates: int = 1000) -> DataFrame:
    """(metric, baseline, diff, low, high, p, significant, favors): paired differences of ``candidate`` less each baseline.

    ``metrics``: (scenario_id, method, columns). Methods of one scenario meet in one row; scenarios that lack either
    method are not compared. ``significant``: the interval excludes 0; ``favors``: the candidate or the baseline, turned round
    for metrics of which less is better, "neither" for a difference of 0.
    """
    long = _differences(metrics, candidate, baselines, columns, ["scenario_id"])
    out = stats.bootstrap(long, replicates, key="scenario_id", by=["metric", "baseline"])
    gain = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -F.round("diff", 9)).otherwise(F.round("diff", 9))
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0)).withColumn("favors", F.when(gain > 0, candidate).when(gain < 0, F.col("baseline")).otherwise("neither"))


def _differences(metrics: DataFrame, candidate: str, baselines: list[str], columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, metric, baseline, d), written: a scenario's methods meet in one row."""
    of = lambda c, m: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = metrics.groupBy(*keys).agg(*(of(c, m).alias(f"{c}__{m}") for c in columns for m in (candidate, *baselines)))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.lit(m).alias("baseline"), (F.col(f"{c}__{candidate}") - F.col(f"{c}__{m}")).alias("d")) for c in columns for m in baselines)))
    return saved(wide.select(*keys, cells.alias("x")).select(*keys, "x.*"), "differences")


def clustered_significance(metrics: DataFrame, cluster: Column, candidate: str, baselines: list[str], columns: list[str], replicates: int = 1000) -> DataFrame:
    """(metric, baseline, images, scenarios, diff, low, high, p, p_holm): as ``retrieval_significance``, but scenarios of one
    ``cluster`` (an expression over scenario_id: the image that they were made of) are drawn together, and p is adjusted by Holm
    over all metrics and baselines, which are few."""
    long = _differences(metrics.withColumn("cluster", cluster), candidate, baselines, columns, ["scenario_id", "cluster"])
    by = ["metric", "baseline"]
    out = stats.bootstrap_clustered(long, replicates, by=by)
    sizes = long.where("d is not null").groupBy(*by).agg(F.count_distinct("cluster").alias("images"), F.count("*").alias("scenarios"))
    named = out.join(sizes, by).withColumn("_test", F.concat_ws(" ", *by))
    return stats.holm(named, "p", "_test").drop("_test").select(*by, "images", "scenarios", "diff", "low", "high", "p", "p_holm")


def model_accuracy(rows: DataFrame, key: str = "image_id", replicates: int = 1000) -> DataFrame:
    """(model, diff, low, high, p): a model's share of right answers with its interval. ``rows``: (key, model, correct)."""
    return stats.bootstrap(rows.select(key, "model", F.col("correct").cast("double").alias("d")), replicates, key=key, by=["model"])


def model_comparison(rows: DataFrame, models: list[str], key: str = "image_id", replicates: int = 1000) -> DataFrame:
    """(model_a, model_b, accuracy_a, accuracy_b, diff, low, high, p_value, p_holm) of every pair: Wilcoxon's test of the
    differences, adjusted by Holm. ``models`` are the few models to compare; images that lack either are left out of a pair."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    wide = rows.groupBy(key).agg(*(F.max(F.when(F.col("model") == m, F.col("correct").cast("double"))).alias(f"m{i}") for i, m in enumerate(models)))
    at = {m: F.col(f"m{i}") for i, m in enumerate(models)}
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), at[a].alias("a"), at[b].alias("b"), (at[a] - at[b]).alias("d")) for a, b in pairs)))
    long, by = saved(wide.select(key, cells.alias("x")).select(key, "x.*").where("d is not null"), "differences"), ["model_a", "model_b"]
    boot = stats.bootstrap(long, replicates, key=key, by=by).drop("p")
    shares = long.groupBy(*by).agg(F.avg("a").alias("accuracy_a"), F.avg("b").alias("accuracy_b"))
    # a pair without a difference has no statistic and p is 1
    tests = shares.join(stats.wilcoxon(long, by=by), by, "left").select(*by, "accuracy_a", "accuracy_b", stats.two_sided_p(F.col("z")).alias("p_value"))
    named = tests.withColumn("_test", F.concat_ws(" ", *by))
    return stats.holm(named, "p_value", "_test").drop("_test").join(boot, by)


def leak_pairs(pairs: DataFrame, splits: DataFrame, key: str = "vec_id") -> DataFrame:
    """(a, b, distance, split_a, split_b) of near pairs over two splits. ``pairs``: (a, b, distance); ``splits``: (key, split)."""
    side = lambda n: splits.select(F.col(key).alias(n), F.col("split").alias(f"split_{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("split_a <> split_b").select("a", "b", "distance", "split_a", "split_b")


def weighted_draw(rows: DataFrame, key: str, stage: str, seed: int = 42) -> DataFrame:
    """``rows`` with ``copies``: a draw of as many rows as there are, with replacement, in which all stages count alike.

    A row is expected n / (stages * rows of its stage) times and comes that often, rounded up or down by a number from
    md5("seed-key"): expectations hold exactly, reruns agree, no row is brought to the driver.
    """
    counts = rows.groupBy(F.col(stage).alias("_s")).agg(F.count("*").alias("_k"))
    total = counts.agg(F.sum("_k").alias("_n"), F.count("*").alias("_g"))
    sized = counts.join(F.broadcast(total)).select("_s", (F.col("_n") / (F.col("_g") * F.col("_k"))).alias("_e"))
    u = F.conv(F.substring(F.md5(F.encode(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")), "UTF-8")), 1, 8), 16, 10).cast("long") / 4294967296.0
    return rows.join(F.broadcast(sized), F.col(stage).eqNullSafe(F.col("_s"))).withColumn("copies", F.floor(F.col("_e") + u)).drop("_s", "_e")
