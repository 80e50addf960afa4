"""Metrics of classification, calibration and ranking, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vec
from ..schema import N_STAGES


def classification(rows: DataFrame, by: list[str] | None = None, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """accuracy, macro_f1 (over labels seen in either column), masd (mean absolute stage distance)."""
    by = by or []
    base = rows.groupBy(*by).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), F.avg(F.abs(F.col(truth) - F.col(predicted)).cast("double")).alias("masd"))
    # one row a label: pre-aggregated confusion counts, each cell counting for its truth and its prediction
    cells = rows.groupBy(*by, truth, predicted).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    each = cells.withColumn("s", sides).groupBy(*by, "s.label").agg(F.sum(F.when((F.col("s.t") == 1) & (F.col(truth) == F.col(predicted)), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("s.t")).alias("t"), F.sum(F.col("n") * F.col("s.p")).alias("p"))
    f1 = each.groupBy(*by).agg(F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"))
    return base.join(f1, by) if by else base.join(F.broadcast(f1))


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(truth, predicted, n) for every pair of stages, zeros included."""
    grid = rows.sparkSession.range(N_STAGES * N_STAGES).select(F.floor(F.col("id") / N_STAGES).cast("int").alias("truth"), (F.col("id") % N_STAGES).cast("int").alias("predicted"))
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["truth", "predicted"], "left").na.fill(0, ["n"])


def per_class_recall(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(stage_id, support, recall) for every stage; without support 0."""
    c = confusion(rows, truth, predicted).groupBy(F.col("truth").alias("stage_id")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    return c.select("stage_id", "support", F.coalesce(F.try_divide("hits", "support"), F.lit(0.0)).alias("recall"))


def edges(bins: int) -> list[float]:
    return [k / bins for k in range(bins + 1)]


def bin_of(confidence: Column, bins: int = 15) -> Column:
    """Number of the bin (low, high], from 0; null outside (0, 1]. Edges are an explicit table, not a product."""
    e = edges(bins)
    out = F.lit(None).cast("int")
    for k in reversed(range(bins)):
        out = F.when((confidence > e[k]) & (confidence <= e[k + 1]), k).otherwise(out)
    return out


def ece_bins(rows: DataFrame, bins: int = 15, truth: str = "truth", predicted: str = "predicted", confidence: str = "confidence") -> DataFrame:
    """(bin, n, accuracy, confidence, share): expected calibration error is sum(share * |accuracy - confidence|)."""
    g = rows.select(bin_of(F.col(confidence), bins).alias("bin"), (F.col(truth) == F.col(predicted)).cast("double").alias("hit"), F.col(confidence).alias("c"))
    total = rows.agg(F.count("*").alias("total"))
    g = g.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("c").alias("mean_confidence"))
    return g.join(F.broadcast(total)).select("bin", "n", "accuracy", "mean_confidence", (F.col("n") / F.col("total")).alias("share"))


def ece(rows: DataFrame, bins: int = 15) -> DataFrame:
    return ece_bins(rows, bins).agg(F.coalesce(F.sum(F.col("share") * F.abs(F.col("accuracy") - F.col("mean_confidence"))), F.lit(0.0)).alias("ece"))


def brier(belief: Column, truth: Column) -> Column:
    return vec.total(F.transform(belief, lambda p, k: (p - (k == truth).cast("double")) * (p - (k == truth).cast("double"))))


def nll(belief: Column, truth: Column, eps: float = 1e-12) -> Column:
    return -F.ln(vec.clip(F.element_at(belief, truth.cast("int") + 1), eps, 1.0))


def calibration(rows: DataFrame, by: list[str], belief: str = "belief", truth: str = "truth") -> DataFrame:
    b, t = F.col(belief), F.col(truth)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((vec.argmax(b) == t).cast("double")).alias("accuracy"), F.avg(F.array_max(b)).alias("mean_confidence"), F.avg(brier(b, t)).alias("brier"), F.avg(nll(b, t)).alias("nll"))


#: 0.30 to 0.95 by 0.05
THRESHOLDS = tuple(round(0.30 + 0.05 * k, 2) for k in range(14))


def abstention(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, truth: str = "truth", predicted: str = "predicted", confidence: str = "confidence") -> DataFrame:
    """(threshold, kept, coverage, accuracy): one pass, a pair of conditional sums for each threshold. Nothing kept: null."""
    hit = F.col(truth) == F.col(predicted)
    one = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(confidence) >= t).alias(f"k{i}") for i, t in enumerate(thresholds)), *(F.count_if((F.col(confidence) >= t) & hit).alias(f"h{i}") for i, t in enumerate(thresholds)))
    cells = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("kept"), F.col(f"h{i}").alias("hits")) for i, t in enumerate(thresholds))))
    return one.select("n", cells.alias("c")).select("c.threshold", "c.kept", F.try_divide("c.kept", "n").alias("coverage"), F.try_divide("c.hits", "c.kept").alias("accuracy"))


def aurc(curve: DataFrame) -> DataFrame:
    """Trapezoids of risk over coverage, divided by the range of coverage; and the risk at the largest coverage."""
    w = W.orderBy("coverage", F.col("threshold").desc())
    c = curve.where("kept > 0").withColumn("risk", 1 - F.col("accuracy"))
    c = c.withColumn("area", (F.col("coverage") - F.lag("coverage").over(w)) * (F.col("risk") + F.lag("risk").over(w)) / 2)
    span = F.max("coverage") - F.min("coverage")
    return c.agg(F.try_divide(F.sum("area"), span).alias("aurc"), F.max_by("risk", "coverage").alias("full_risk"))


def operating_point(curve: DataFrame, target: float) -> DataFrame:
    """The row of the curve whose coverage is nearest to ``target``; ties to the lower threshold."""
    return curve.where("kept > 0").agg(F.min_by(F.struct("threshold", "coverage", "accuracy"), F.struct(F.abs(F.col("coverage") - target), "threshold")).alias("r")).select("r.*")


def losses(logits: Column, truth: Column, gamma: float = 2.0, lam: float = 0.5) -> dict[str, Column]:
    """Cross entropy, focal and ordinal-expectation loss of a row."""
    p = vec.softmax(logits)
    ce = nll(p, truth, 1e-300)
    gap = vec.total(F.transform(p, lambda v, k: v * k)) - truth
    return {"ce": ce, "focal": F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce, "ordinal": ce + lam * gap * gap}


def temperature_grid(rows: DataFrame, low: float = 0.05, high: float = 10.0, steps: int = 200, logits: str = "logits", truth: str = "truth") -> DataFrame:
    """(temperature, nll) on a logarithmic grid. Rows are exploded against the grid inside each task and summed there."""
    grid = [low * (high / low) ** (k / (steps - 1)) for k in range(steps)]
    t = rows.select(F.col(logits).alias("x"), F.col(truth).alias("y"), F.explode(F.array(*map(F.lit, grid))).alias("temperature"))
    z = F.transform("x", lambda v: v / F.col("temperature"))
    top = F.array_max("x") / F.col("temperature")
    loss = F.ln(vec.total(F.transform(z, lambda v: F.exp(v - top)))) + top - F.element_at("x", F.col("y") + 1) / F.col("temperature")
    return t.groupBy("temperature").agg(F.avg(loss).alias("nll"))


def fit_temperature(rows: DataFrame, by: str | None = None, low: float = 0.05, high: float = 10.0, most: int = 60, logits: str = "logits", truth: str = "truth") -> dict:
    """The temperature in [``low``, ``high``] of least mean negative log-likelihood, for each value of ``by`` (or for None).

    In the inverse temperature the loss is convex; its slope and curvature are sums over the rows, one pass a step for all
    values of ``by`` together, and one row a value comes to the driver. Newton's steps are kept within the bracket that slopes
    have shown, and halve it where they leave it. At a bound where the slope still points outwards the bound is the answer. A
    value without rows has none; 1.0 for None without rows.
    """
    bounds = (1 / high, 1 / low)
    at, bracket, done = {}, {}, {}
    rows = rows.select(*([F.col(by).alias("_by")] if by else [F.lit(None).cast("int").alias("_by")]), F.col(logits).alias("x"), F.col(truth).cast("int").alias("y"))
    for _ in range(most):
        beta = F.lit(1.0)
        for value, b in at.items():
            beta = F.when(F.col("_by").eqNullSafe(F.lit(value)), b).otherwise(beta)
        p = vec.softmax(F.transform("x", lambda v: v * F.col("_beta")))
        made = rows.withColumn("_beta", beta).select("_by", F.element_at("x", F.col("y") + 1).alias("own"), F.struct(vec.dot(p, F.col("x")).alias("m"), vec.dot(p, F.transform("x", lambda v: v * v)).alias("q")).alias("z"))
        slope, bend = F.avg(F.col("z.m") - F.col("own")), F.avg(F.col("z.q") - F.col("z.m") * F.col("z.m"))
        for r in made.groupBy("_by").agg(slope.alias("slope"), bend.alias("bend")).collect():
            value, b = r["_by"], at.get(r["_by"], 1.0)
            lo, hi = bracket.get(value, bounds)
            lo, hi = (lo, b) if r.slope > 0 else (b, hi)
            step = b - r.slope / r.bend if r.bend > 0 else None
            new = step if step is not None and lo < step < hi else (lo + hi) / 2
            bracket[value], at[value] = (lo, hi), new
            done[value] = abs(new - b) <= 1e-12 * b or hi - lo <= 1e-12 * hi
        if all(done.values()):
            break
    found = {v: min(max(1 / b, low), high) for v, b in at.items()}
    return found if by else {None: found.get(None, 1.0)}


def ranking_metrics(top: DataFrame, relevant: DataFrame, k: int = 5, by: tuple[str, ...] = ("scenario_id", "method"), key: str = "chunk_id") -> DataFrame:
    """Precision, recall, nDCG and SIRR at k.

    ``top``: (by, key, rank), every list with at least one row; ``relevant``: (scenario_id, key, grade, incompatible).
    """
    return graded_metrics(top.where(F.col("rank") <= k).join(relevant, ["scenario_id", key], "left"), ideals(relevant, ["scenario_id"], k, key), k, by)


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def ideals(relevant: DataFrame, by: list[str], k: int = 5, key: str = "chunk_id") -> DataFrame:
    """(by, n_relevant, idcg): the ideal ranking is made of all graded ids; only the first k of a group are ranked."""
    good = relevant.where("grade > 0")
    first = good.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(F.col("grade").desc(), key))).where(F.col("n") <= k)
    return good.groupBy(*by).agg(F.count("*").alias("n_relevant")).join(first.groupBy(*by).agg(F.sum(_gain(F.col("grade"), F.col("n"))).alias("idcg")), by)


def graded_metrics(hits: DataFrame, goals: DataFrame, k: int = 5, by: tuple[str, ...] = ("scenario_id", "method"), on: tuple[str, ...] = ("scenario_id",)) -> DataFrame:
    """As ``ranking_metrics``, of lists that carry their grades. ``hits``: (by, on, rank, grade, incompatible), null grades: not
    relevant; ``goals``: ``ideals`` by ``on``, which may be classes that many scenarios share. Precision and SIRR divide by k even
    for shorter lists; recall without relevant ids is 0."""
    grade = F.coalesce("grade", F.lit(0.0))
    keys = list(dict.fromkeys([*by, *on]))
    m = hits.where(F.col("rank") <= k).groupBy(*keys).agg(F.sum((grade > 0).cast("double")).alias("hits"), F.sum(_gain(grade, F.col("rank"))).alias("dcg"), F.sum(F.coalesce("incompatible", F.lit(False)).cast("double")).alias("bad"))
    m = m.join(goals, list(on), "left")
    return m.select(*by, (F.col("hits") / k).alias("precision_at_k"), F.coalesce(F.try_divide("hits", "n_relevant"), F.lit(0.0)).alias("recall_at_k"), F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), F.lit(0.0)).alias("ndcg_at_k"), (F.col("bad") / k).alias("sirr_at_k"))


def error_condition(truth: Column, predicted: Column) -> Column:
    d = F.abs(truth - predicted)
    return F.when(d == 0, "correct").when(d == 1, "adjacent").otherwise("nonadjacent")


def error_summary(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    d = F.abs(F.col(truth) - F.col(predicted))
    return rows.agg(F.avg((d == 0).cast("double")).alias("accuracy"), F.avg(d.cast("double")).alias("masd"), F.avg((d >= 2).cast("double")).alias("nonadjacent"), F.avg((d == 1).cast("double")).alias("adjacent"))
