"""Fixed-length vector and probability functions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def normalized(x: Column, eps: float = 1e-12) -> Column:
    """Clipped below at ``eps``, divided by the sum."""
    return _scaled(F.transform(x, lambda v: clip(v, eps)))


def _scaled(x: Column) -> Column:
    return F.transform(F.array(F.struct(x.alias("x"), total(x).alias("s"))), lambda r: F.transform(r["x"], lambda v: v / r["s"]))[0]


def softmax(x: Column) -> Column:
    return _scaled(F.transform(F.array(F.struct(x.alias("x"), F.array_max(x).alias("m"))), lambda r: F.transform(r["x"], lambda v: F.exp(v - r["m"])))[0])


def argmax(x: Column) -> Column:
    """Place from 0 of the first largest entry."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def one_hot(i: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == i).cast("double"))


def entropy_concentration(p: Column, n: int) -> Column:
    """1 - H(p) / ln n, within [0, 1]."""
    q = normalized(p)
    return clip(1 + total(F.transform(q, lambda v: v * F.ln(v))) / F.ln(F.lit(float(n))), 0.0, 1.0)


def top_two_margin(p: Column) -> Column:
    s = F.sort_array(normalized(p), asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)


def jsd_agreement(p: Column, q: Column) -> Column:
    """1 - JSD(p, q) / ln 2, within [0, 1]; natural logarithms."""
    pairs = F.zip_with(normalized(p), normalized(q), lambda a, b: a * F.ln(2 * a / (a + b)) / 2 + b * F.ln(2 * b / (a + b)) / 2)
    return clip(1 - total(pairs) / F.ln(F.lit(2.0)), 0.0, 1.0)


def combined_confidence(p: Column, n: int, temporal: Column | None = None, entropy: float = 0.6, margin: float = 0.4, agreement: float = 0.0) -> Column:
    """Weighted mean of concentration, margin and, with ``temporal``, agreement; weights are renormalised."""
    agreement = 0.0 if temporal is None else agreement
    weight = entropy + margin + agreement
    if weight <= 0:
        raise ValueError("weights must have a positive sum")
    out = entropy * entropy_concentration(p, n) + margin * top_two_margin(p)
    if temporal is not None:
        out = out + agreement * jsd_agreement(p, temporal)
    return clip(out / weight, 0.0, 1.0)


def transition_matrix(n: int, stay: float = 0.55, one: float = 0.35, two: float = 0.10) -> list[list[float]]:
    """Band matrix: stay, one stage on, two stages on; rows are renormalised at the end."""
    rows = [[{0: stay, 1: one, 2: two}.get(j - i, 0.0) for j in range(n)] for i in range(n)]
    return [[v / sum(r) for v in r] for r in rows]


def transition_prior(belief: Column, matrix: list[list[float]]) -> Column:
    n = len(matrix)
    return _scaled(F.array(*(sum((belief[i] * matrix[i][j] for i in range(n) if matrix[i][j]), F.lit(0.0)) for j in range(n))))


def log_linear_fusion(prior: Column, evidence: list[tuple[Column, float]], prior_weight: float = 1.0, eps: float = 1e-9) -> Column:
    """softmax(w0 ln prior + sum wi ln(pi / sum pi)), arguments of ln clipped to [eps, 1]."""
    score = F.transform(prior, lambda v: prior_weight * F.ln(clip(v, eps, 1.0)))
    for p, w in evidence:
        score = _plus(score, _scaled(p), w, eps)
    return softmax(score)


def _plus(score: Column, p: Column, weight: float, eps: float) -> Column:
    return F.zip_with(score, p, lambda s, v: s + weight * F.ln(clip(v, eps, 1.0)))
