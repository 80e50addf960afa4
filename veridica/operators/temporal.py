"""Temporal fusion of beliefs in order, of series of any length."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from ..functions import vec
from ..schema import N_STAGES
from ..sources.scratch import saved

#: Beliefs that differ by no more are one state.
SAME = 1e-13


class Fold:
    """The first belief as it is; after it the transition prior of the last fused belief, fused log-linearly with the new one."""

    def __init__(self, matrix: list[list[float]], prior_weight: float = 1.0, evidence_weight: float = 1.0):
        n = len(matrix)
        self.into = [[(i, matrix[i][j]) for i in range(n) if matrix[i][j]] for j in range(n)]
        self.prior_weight, self.evidence_weight = prior_weight, evidence_weight

    def __call__(self, last: list[float] | None, belief: list[float]) -> list[float]:
        if last is None:
            e = [max(v, 1e-12) for v in belief]
        else:
            prior = [sum(last[i] * m for i, m in x) for x in self.into]
            s, t = sum(prior), sum(belief)
            z = [self.prior_weight * log(min(max(p / s, 1e-9), 1.0)) + self.evidence_weight * log(min(max(b / t, 1e-9), 1.0)) for p, b in zip(prior, belief, strict=True)]
            top = max(z)
            e = [exp(v - top) for v in z]
        s = sum(e)
        return [v / s for v in e]


def _folded(batches: Iterator[pa.RecordBatch], step: Fold, width: int, task: int | None, starts: dict[int, list[float]]) -> Iterator[pa.RecordBatch]:
    """Reads sorted rows whose first ``width`` columns are the series, its order and the belief. Adds task, i (the place from 1 in
    the task's part of the series), head (whether the series is the first of its task) and fused. With ``task`` null the
    rows are parts that have these columns; the part of a task begins in the state ``starts`` has for it."""
    last = state = None
    i, head = 0, None
    for b in batches:
        n, names = b.num_rows, b.schema.names
        tasks = b.column(names.index("task")).to_pylist() if task is None else [task] * n
        at, heads, fused = [], [], []
        for t, series, belief in zip(tasks, b.column(0).to_pylist(), b.column(width - 1).to_pylist(), strict=True):
            key = (t, series)
            if key != last:
                head = head is None or task is None
                last, i, state = key, 0, starts.get(t)
            i, state = i + 1, step(state, belief)
            at.append(i)
            heads.append(head)
            fused.append(state)
        made = [pa.array(tasks, pa.int64()), pa.array(at, pa.int64()), pa.array(heads, pa.bool_()), pa.array(fused, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:width], *made], [*names[:width], *(f.name for f in _MADE)])


_MADE = [StructField("task", LongType()), StructField("i", LongType()), StructField("head", BooleanType()), StructField("fused", ArrayType(DoubleType()))]


def tracks(rows: DataFrame, series: str, order: list[str], belief: str = "belief", matrix: list[list[float]] | None = None, prior_weight: float = 1.0, evidence_weight: float = 1.0) -> DataFrame:
    """(series, *order, pos, belief, fused) for every row of every series, in ``order``; pos from 0.

    Rows are range-partitioned by (series, order), so a series of any length is many tasks. A task folds its part of a series
    from the part's first row; then each later part is folded again from the state in which the part before it ended, all
    parts at once, until no part ends otherwise than before (by ``SAME``). After k rounds the first k + 1 parts are right
    whatever the states, floors included; as evidence outweighs old states, one round and one that confirms it are usual.
    Only ends of parts, two a task at most, come to the driver. Rows of equal order stand in the order of their beliefs;
    rows without belief are left out.
    """
    step = Fold(matrix or vec.transition_matrix(N_STAGES), prior_weight, evidence_weight)
    kept = list(dict.fromkeys([series, *order, belief]))
    width = len(kept)
    schema = StructType([*rows.select(*kept).schema.fields, *_MADE])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _folded(batches, step, width, TaskContext.get().partitionId(), {})

    given = rows.select(*kept).where(F.col(belief).isNotNull())
    put = saved(given.repartitionByRange(*kept).sortWithinPartitions(*kept).mapInArrow(begun, schema), "tracks")
    parts = put.groupBy(series, "task").agg(F.max("i").alias("n"), F.max_by("fused", "i").alias("last"))
    parts = parts.withColumn("_parts", F.count("*").over(W.partitionBy(series))).where("_parts > 1").select(F.col(series).alias("s"), "task", "n", "last")
    each: dict = {}
    for p in sorted(parts.collect(), key=lambda p: p.task):
        each.setdefault(p.s, []).append(p)
    ends = {(s, p.task): p.last for s, ps in each.items() for p in ps}
    follows = {p.task: (s, ps[k].task) for s, ps in each.items() for k, p in enumerate(ps[1:])}  # the part before a task's head
    before = [(p.task, sum(q.n for q in ps[: k + 1])) for ps in each.values() for k, p in enumerate(ps[1:])]
    first = F.col("i") - 1
    cols = [*kept[:-1], first.alias("pos"), belief, "fused"]
    if not follows:
        return put.select(*cols)
    late = F.col("head") & F.col("task").isin(list(follows))
    ranges = put.where(late).repartition("task").sortWithinPartitions("task", "i")
    while True:
        starts = {t: ends[of] for t, of in follows.items()}

        def again(batches: Iterator[pa.RecordBatch], starts: dict = starts) -> Iterator[pa.RecordBatch]:
            return _folded(batches, step, width, None, starts)

        redone = saved(ranges.mapInArrow(again, schema), "tracks")
        now = {(each_s, r.task): r.last for r in redone.groupBy("task").agg(F.max_by("fused", "i").alias("last")).collect() for each_s in (follows[r.task][0],)}
        moved = max(abs(a - b) for k, v in now.items() for a, b in zip(v, ends[k], strict=True))
        ends |= now
        if moved <= SAME:
            break
    shift = F.broadcast(put.sparkSession.createDataFrame(before, "task long, before long"))
    return put.where(~late).select(*cols).union(redone.join(shift, "task").select(*kept[:-1], (first + F.col("before")).alias("pos"), belief, "fused"))


def over_orders(rows: DataFrame, key: str, truth: str, belief: str = "belief", orders: int = 20, **how) -> DataFrame:
    """(``orders`` rows: draw, n, accuracy, masd, non_adjacent, adjacent) of series that stand by true stage, shuffled within it
    by each draw, and are fused online: how far the prior of an ordered season alone mends single predictions."""
    from .neardup import group_rank

    draws = rows.select(F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("draw"), F.col(truth).cast("int").alias("truth"), key, belief)
    draws = draws.withColumn("rank", F.element_at(F.array(*(group_rank(seed, F.col(key)) for seed in range(orders))), F.col("draw") + 1))
    fused = tracks(draws, "draw", ["truth", "rank", key], belief, **how)
    off = F.abs(vec.argmax(F.col("fused")) - F.col("truth"))
    return fused.groupBy("draw").agg(F.count("*").alias("n"), F.avg((off == 0).cast("int")).alias("accuracy"), F.avg(off).alias("masd"), F.count_if(off >= 2).alias("non_adjacent"), F.count_if(off == 1).alias("adjacent"))


def fold(beliefs: Column, matrix: list[list[float]] | None = None, prior_weight: float = 1.0, evidence_weight: float = 1.0) -> Column:
    """The fold of one short array of beliefs, in column functions: the array of fused beliefs."""
    matrix = matrix or vec.transition_matrix(N_STAGES)
    start = F.struct(F.lit(None).cast("array<double>").alias("last"), F.array().cast("array<array<double>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        new = F.when(s["last"].isNull(), vec.normalized(b)).otherwise(vec.log_linear_fusion(vec.transition_prior(s["last"], matrix), [(b, evidence_weight)], prior_weight))
        return F.transform(F.array(new), lambda n: F.struct(n.alias("last"), F.concat(s["out"], F.array(n)).alias("out")))[0]

    return F.aggregate(beliefs, start, step, lambda s: s["out"])
