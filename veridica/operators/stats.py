"""Paired significance tests: bootstrap, clustered bootstrap, McNemar, Wilcoxon, Holm, two proportions.

Resampling is Poisson resampling: in a replicate each row (or cluster) counts as often as a Poisson number of mean 1 says,
which is what n draws with replacement give each row of many. The numbers come from hashes of (seed, replicate, key)
instead of a generator's stream, so results depend neither on partitions nor on the engine, and one pass with sums
combined in the tasks makes all replicates: there is no join, no numbering and no array of draws.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import cumulated


#: of 2**32 equally likely numbers those from the k-th entry on give k + 1 or more: the distribution function of Poisson(1)
POISSON = tuple(int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(11))


def weight(seed: int, replicate: Column, key: Column) -> Column:
    """A Poisson number of mean 1 from the first eight hex digits of md5("seed-replicate-key")."""
    text = F.concat_ws("-", F.lit(str(seed)), replicate.cast("string"), key.cast("string"))
    u = F.array(F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("long"))
    return F.transform(u, lambda x: F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda t: x >= t)))[0]


def holm(rows: DataFrame, p: str = "p", key: str = "test", out: str = "p_holm") -> DataFrame:
    """Step-down adjustment over all rows (a family of tests is few rows)."""
    order = W.orderBy(p, key)
    m = F.count("*").over(W.partitionBy())
    return rows.withColumn("_a", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))).withColumn(out, F.max("_a").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_a")


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided: 2 sum over i <= min(b, c) of C(n, i) / 2^n, at most 1; terms by recurrence in logarithms, so that
    large counts do not underflow early."""
    n, m = (b + c).cast("double"), F.least(b, c).cast("int")
    zero = F.struct((-n * F.ln(F.lit(2.0))).alias("log"), F.exp(-n * F.ln(F.lit(2.0))).alias("sum"))

    def step(s, i):
        log = s["log"] + F.ln((n - i + 1) / i)
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, zero, step, lambda s: s["sum"])))


def mcnemar(rows: DataFrame, key: str = "image_id", model: str = "model", correct: str = "correct") -> DataFrame:
    """(model_a, model_b, b, c, p_value) for every pair of models over the keys that both have: ``rows`` long, correct 0 or 1.

    Rows of one key meet once, as a map of its models, and pairs are made of it: no self-join of the rows.
    """
    each = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col(model).alias("m"), F.col(correct).cast("int").alias("c")))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["m"] > a["m"]), lambda b: F.struct(a["m"].alias("model_a"), b["m"].alias("model_b"), a["c"].alias("a"), b["c"].alias("b")))))
    p = each.select(F.explode(pairs).alias("p")).select("p.*").groupBy("model_a", "model_b").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("b"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("c"))
    return p.withColumn("p_value", mcnemar_p(F.col("b"), F.col("c")))


def wilcoxon(rows: DataFrame, difference: str = "d", by: list[str] | None = None) -> DataFrame:
    """Signed-rank statistic min(W+, W-) with average ranks of ties, zeros dropped, and z of the normal approximation
    with tie correction. Equal absolute differences are pre-aggregated; ranks come from counts cumulated over range
    partitions, so differences that are all distinct are no window of one task. Sums of ranks are exact decimals."""
    by = by or []
    d = F.col(difference)
    g = rows.where(d != 0).groupBy(*by, F.abs(d).alias("a")).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("up"))
    g = cumulated(g, [*(F.col(c) for c in by), F.col("a")], "n")
    # ranks, doubled to be whole, count from the first row of all; what lies before a group is taken off its sums
    double = (2 * F.col("up_to") - F.col("n") + 1).cast("decimal(19,0)")
    down = F.col("n") - F.col("up")
    s = g.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("up").alias("up"), F.min(F.col("up_to") - F.col("n")).alias("before"),
        F.sum(double * F.col("up").cast("decimal(18,0)")).alias("plus"), F.sum(double * down.cast("decimal(18,0)")).alias("minus"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties"),
    )

    def own(total: str, count: Column) -> Column:
        off = F.col("before").cast("decimal(18,0)") * (2 * count).cast("decimal(19,0)")
        return (F.col(total) - off).cast("double") / 2

    s = s.withColumn("plus", own("plus", F.col("up"))).withColumn("minus", own("minus", F.col("n") - F.col("up")))
    n = F.col("n").cast("double")
    s = s.withColumn("statistic", F.least("plus", "minus")).withColumn("sd", F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24))
    return s.select(*by, "n", "statistic", F.try_divide(F.col("statistic") - n * (n + 1) / 4, F.col("sd")).alias("z"))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """From the normal distribution; null: 1. SQL has no error function."""
    return z.map(lambda v: 1.0 if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def bootstrap(differences: DataFrame, replicates: int = 1000, seed: int = 42, value: str = "d", key: str = "i", by: list[str] | None = None) -> DataFrame:
    """(diff, low, high, p): mean difference, percentile interval of 95 %, and 2 min(share <= 0, share >= 0).

    ``differences``: (key, value); rows of one key are drawn together. Without rows p is 1 and the rest null. With ``by``
    a row for each of its values, which share the draws of a key.
    """
    by = by or []
    return _resampled(differences.where(F.col(value).isNotNull()).select(*by, F.col(key).alias("id"), F.col(value).cast("double").alias("s"), F.lit(1).alias("k")), replicates, seed, by)


def bootstrap_clustered(differences: DataFrame, replicates: int = 1000, seed: int = 42, value: str = "d", cluster: str = "cluster", by: list[str] | None = None) -> DataFrame:
    """As ``bootstrap``, drawing whole clusters: the mean is a ratio of pooled sums, so clusters are reduced to (sum, count)."""
    by = by or []
    units = differences.where(F.col(value).isNotNull()).groupBy(*by, F.col(cluster).alias("id")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("k"))
    return _resampled(units, replicates, seed, by)


#: Keys whose draws are made at once: as many times the replicates are held by a task.
DRAWN = 1000


def drawn_sums(units: DataFrame, replicates: int, seed: int, by: list[str]) -> DataFrame:
    """(by, r, s, k): sums of ``weight`` times s and k, one row a task, value of ``by`` (few) and replicate.

    Draws are ``weight``'s, made in arrays: a row a replicate is never made, and rows of one key in a batch share its draws.
    """
    text = F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit("-"), F.col("id").cast("string")))
    rows = units.select(F.struct(*by).alias("by") if by else F.lit(0).alias("by"), text.alias("id"), F.col("s").cast("double").alias("s"), F.col("k").cast("long").alias("k"))
    limits, heads = np.array(POISSON, dtype=np.int64), [f"{seed}-{r}".encode() for r in range(replicates)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        names: list = []
        for batch in batches:
            values = batch.column("by").to_pylist()
            kinds = {repr(v): v for v in values}
            coded = batch.column("id").dictionary_encode()
            node, s, k = coded.indices.to_numpy(), batch.column("s").to_numpy(), batch.column("k").to_numpy()
            of = np.array([repr(v) for v in values], dtype=object)
            ids = [i.encode() for i in coded.dictionary.to_pylist()]
            for at in range(0, len(ids), DRAWN):
                cut = ids[at : at + DRAWN]
                digests = b"".join(hashlib.md5(h + i, usedforsecurity=False).digest()[:4] for i in cut for h in heads)
                w = np.searchsorted(limits, np.frombuffer(digests, dtype=">u4").astype(np.int64), side="right").reshape(len(cut), replicates).astype(np.float64)
                here = (node >= at) & (node < at + len(cut))
                for name, value in kinds.items():
                    mine = here & (of == name)
                    if name not in totals:
                        totals[name] = (np.zeros(replicates), np.zeros(replicates, dtype=np.int64))
                        names.append((name, value))
                    one, two = (np.bincount(node[mine] - at, v[mine], len(cut)) for v in (s, k))
                    totals[name][0][:] += one @ w
                    totals[name][1][:] += (two @ w).astype(np.int64)
        for name, value in names:
            a, b = totals[name]
            yield pa.RecordBatch.from_arrays([pa.array([value] * replicates, kind), pa.array(np.arange(replicates, dtype=np.int32)), pa.array(a), pa.array(b)], ["by", "r", "s", "k"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["by"].dataType)
    schema = T.StructType([rows.schema["by"], T.StructField("r", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("k", T.LongType())])
    # a small table is read by few tasks, but makes many draws; rows of one key share theirs
    context = units.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.repartition(tasks, "id").mapInArrow(sums, schema)
    return found.select(*([F.col("by")[c].alias(c) for c in by]), "r", "s", "k")


def _resampled(units: DataFrame, replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """``units``: (by, id, s, k). A task hands on one pair of sums a replicate (and value of ``by``)."""
    by = by or []
    means = drawn_sums(units, replicates, seed, by).groupBy(*by, "r").agg(F.sum("s").alias("s"), F.sum("k").alias("k")).where("k > 0")
    out = _summary(means.select(*by, (F.col("s") / F.col("k")).alias("m")), units.groupBy(*by).agg(F.try_divide(F.sum("s"), F.sum("k")).alias("diff")), by)
    return out.withColumn("p", F.coalesce("p", F.lit(1.0)))


def _summary(means: DataFrame, whole: DataFrame, by: list[str]) -> DataFrame:
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    s = means.withColumn("m", F.round("m", 9)).groupBy(*by).agg(q[0].alias("low"), q[1].alias("high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p"))
    return (whole.join(s, by, "left") if by else whole.join(F.broadcast(s))).select(*by, "diff", "low", "high", "p")


def two_proportions(rows: DataFrame, group: str, hit: str, first: str, second: str) -> DataFrame:
    """Pooled z of the difference of two shares."""
    a, b = F.col(group) == first, F.col(group) == second
    s = rows.agg(F.count_if(a).alias("n1"), F.count_if(b).alias("n2"), F.count_if(a & F.col(hit)).alias("x1"), F.count_if(b & F.col(hit)).alias("x2"))
    p = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    return s.withColumn("z", F.try_divide(F.col("x1") / F.col("n1") - F.col("x2") / F.col("n2"), F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n2")))))
