"""Quality classifier (operator 3): a byte-level convolutional network in numpy.

Input: a text's UTF-8 bytes in cells of ``CELL`` bytes. A byte has a learned vector; a cell also has the shares of its
bytes that equal the byte 2, 3 ... ``LAGS`` + 1 places before, by which filters see repetition whatever is repeated.
Filters span two cells and move by one, so chunks of 16 bytes overlap by 8 and cover the whole text. Rectified
responses are max-pooled over the document, and a logistic layer makes the maxima one probability. Long texts are read
in pieces, with running maxima, so memory does not grow with the text.

Training: Adam on the log loss over a bounded sample of labelled rows: at most ``sample`` rows, those of least hash, and
``SAMPLE_BYTES`` bytes of text, of which one text has a 64th at most. Each is read whole, in pieces: as a maximum passes its
gradient to one chunk alone, a step needs no more than the chunks at which the filters have their maxima. Only the text is
an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, unused

CELL, LAGS, VECTOR, FILTERS = 8, 16, 8, 24
PIECE = 1 << 16
#: Bytes of the training texts that come to the driver.
SAMPLE_BYTES = 1 << 26


@dataclass
class Network:
    vectors: np.ndarray  # (256, VECTOR)
    filters: np.ndarray  # (2 * (CELL * VECTOR + LAGS), FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    base: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.out, self.base]


def cells(data: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in cells, shares of repeats). ``data``: a multiple of CELL bytes; ``before``: the LAGS + 1 bytes ahead of it."""
    whole = np.concatenate([before, data])
    n, skip = len(data), len(before)
    same = np.empty((n // CELL, LAGS), dtype=np.float32)
    for k in range(LAGS):
        equal = (data == whole[skip - k - 2 : skip - k - 2 + n]).view(np.uint8).reshape(-1, CELL)
        # eight bytes of 0 or 1 as one number; the product gathers their sum in its highest byte
        same[:, k] = (equal.view("<u8")[:, 0] * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.float32) / CELL
    return data.reshape(-1, CELL), same


def _padded(text: bytes) -> np.ndarray:
    """At least one chunk; zeros after the text."""
    n = max(2, -(-len(text) // CELL)) * CELL
    out = np.zeros(n, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out


def _inputs(net: Network, byte_cells: np.ndarray, same: np.ndarray) -> np.ndarray:
    x = net.vectors[byte_cells].reshape(len(byte_cells), CELL * VECTOR)
    return np.hstack([x, same])


def _responses(net: Network, x: np.ndarray) -> np.ndarray:
    half = len(net.filters) // 2
    return np.maximum((x @ net.filters[:half])[:-1] + (x @ net.filters[half:])[1:] + net.bias, 0)


def _pieces(net: Network, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first cell, bytes in cells, inputs, responses) of pieces. Pieces share a cell, so all chunks are seen."""
    data, step = _padded(text), PIECE // CELL * CELL
    for lo in range(0, len(data) - CELL, step):
        before = np.concatenate([np.zeros(max(0, LAGS + 1 - lo), np.uint8), data[max(0, lo - LAGS - 1) : lo]])
        byte_cells, same = cells(data[lo : lo + step + CELL], before)
        x = _inputs(net, byte_cells, same)
        yield lo // CELL, byte_cells, x, _responses(net, x)


def pooled(net: Network, text: bytes) -> np.ndarray:
    """Each filter's largest response."""
    top = np.zeros(FILTERS, dtype=np.float32)
    for _, _, _, r in _pieces(net, text):
        top = np.maximum(top, r.max(axis=0))
    return top


def probability(net: Network, text: bytes) -> float:
    z = float(pooled(net, text).astype(np.float64) @ net.out + net.base[0])
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _gradients(net: Network, text: bytes, label: int) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients, from the chunk (two cells) of each filter's first largest response."""
    each = np.arange(FILTERS)
    h = np.full(FILTERS, -1, dtype=np.float32)
    chunk_bytes, chunk = np.zeros((FILTERS, 2, CELL), dtype=np.uint8), np.zeros((FILTERS, 2, CELL * VECTOR + LAGS), dtype=np.float32)
    for _, byte_cells, x, r in _pieces(net, text):
        which = r.argmax(axis=0)
        more = np.flatnonzero(r[which, each] > h)
        h[more] = r[which[more], more]
        for side in (0, 1):
            chunk_bytes[more, side], chunk[more, side] = byte_cells[which[more] + side], x[which[more] + side]
    p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.base[0], -60, 60)))
    d = np.float32(p - label)
    back = d * net.out * (h > 0)
    half = len(net.filters) // 2
    grad_filters = np.vstack([chunk[:, 0].T * back, chunk[:, 1].T * back])
    grad_vectors = np.zeros((256, VECTOR), dtype=np.float32)
    for side in (0, 1):
        of_filter = net.filters[side * half : side * half + CELL * VECTOR].T * back[:, None]
        np.add.at(grad_vectors, chunk_bytes[:, side].ravel(), of_filter.reshape(-1, VECTOR))
    loss = -float(np.log(p if label else 1 - p)) if 0 < p < 1 else 60.0
    return loss, [grad_vectors, grad_filters, back, d * h, np.array([d], dtype=np.float32)]


def train(rows: list[tuple[bytes, int]], epochs: int = 4, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Network:
    """Without rows, or with one class only, the network still scores: near the share of label 1."""
    rng = np.random.default_rng(seed)
    width = 2 * (CELL * VECTOR + LAGS)
    net = Network(*(a.astype(np.float32) for a in (rng.normal(0, 0.5, (256, VECTOR)), rng.normal(0, (2 / width) ** 0.5, (width, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, FILTERS), np.zeros(1))))
    share = min(max(np.mean([y for _, y in rows]) if rows else 0.5, 0.01), 0.99)
    net.base[0] = np.log(share / (1 - share))
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    total = max(1, epochs * -(-len(rows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            sums = [np.zeros_like(p) for p in net.parts()]
            for i in some:
                for s, g in zip(sums, _gradients(net, *rows[i])[1], strict=True):
                    s += g
            step += 1
            now = rate * (1 - step / total) + 1e-4
            for p, s, m, v in zip(net.parts(), sums, first, second, strict=True):
                g = s / len(some)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text "null"."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("null")), "UTF-8")) % folds


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample_bytes: int = SAMPLE_BYTES, **how) -> Network:
    """Trains on at most ``sample`` rows, those of least hash of the id, whose texts have at most ``sample_bytes`` bytes together
    and a 64th of that each; null labels and ids, and labels other than 0 and 1, teach nothing; of a repeated id one row."""
    key = F.xxhash64("doc_id")
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # the texts of this bounded list alone move
    chosen = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(key, "doc_id").limit(sample)
    size = F.octet_length("text").cast("long")
    rows = texts.join(F.broadcast(chosen), "doc_id").where(size <= sample_bytes // 64).dropDuplicates(["doc_id"])
    so_far = F.sum(size).over(W.orderBy(key, "doc_id").rowsBetween(W.unboundedPreceding, 0))  # over the rows of the sample
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).orderBy(key, "doc_id").select("text", "y").toArrow()
    return train([(x.as_py().encode(), y) for x, y in zip(rows["text"], rows["y"].to_pylist(), strict=True)], **how)


def score(docs: DataFrame, net: Network, text: str = "text", keys: list[str] | None = None, out: str = "score") -> DataFrame:
    """``keys`` (by default all columns) and ``out``, the probability of label 1, for every row; null texts are empty.

    Repeated rows are scored each; an empty table gives no rows; columns may have any names but ``out``, which is an error.
    """
    kept = docs.columns if keys is None else keys
    if out.lower() in [c.lower() for c in kept]:
        raise ValueError(f"there is a column {out} already")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    (scored,) = unused(kept, "_scored")
    some = docs.select(F.col(f"`{text}`").alias(scored), *(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = pa.array([probability(shared.value, x) for x in as_bytes(b.column(0))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], p], [*b.schema.names[1:], out])

    return some.mapInArrow(run, some.drop(scored).schema.add(out, "double"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; learns from rows outside fold 0 only. Null texts are empty, a null id
    is of the fold of "null", repeated rows are scored each, an empty table gives no rows, further columns are not read."""
    net = fit(docs, labels.where(fold(F.col("doc_id"), folds) != 0), **how)
    rows = score(docs.select("doc_id", "text"), net, "text", ["doc_id"])
    return rows.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
