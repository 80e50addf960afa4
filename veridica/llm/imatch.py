"""I-Match document fingerprints over randomised lexicons (operator 1).

The lexicon keeps the terms whose share of the documents lies in [``LOW``, ``HIGH``], which is a band of inverse
document frequency; there are at most (mean distinct terms of a document) / ``LOW`` of them, whatever the corpus,
so it can be broadcast. A document's distinct terms in the lexicon are sorted; a subset of the lexicon keeps a term
with a fixed pseudo-random decision, and what it keeps of the document is hashed. A subset's hash survives an edit
if none of the changed terms is in it, so subsets must be thinner for longer documents: densities are powers of two,
and a fingerprint holds the ``SUBSETS`` hashes of each of the ``LEVELS`` densities about one term in the document.

Likeness: of the subsets of densities that both fingerprints hold, the share with equal hashes among those that keep
a term of either document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes

LOW, HIGH = 0.0005, 0.05
SUBSETS, LEVELS = 16, 3
#: Distinct terms that a task counts before it hands them on.
HELD = 1 << 19
#: A-Z in lower case; ASCII that is neither letter nor digit parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> set[bytes]:
    return set(text.translate(_FOLD).split())


def hashes(found: set[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, found), dtype=np.uint64, count=len(found))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band; every document counts, null texts as empty. A term of one document alone is never in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes(held).view(np.int64)), pa.array(held.values(), pa.int64())], ["term", "df"])

        for batch in batches:
            for x in as_bytes(batch.column(0)):
                for t in terms(x):
                    held[t] = held.get(t, 0) + 1
                if len(held) > HELD:
                    yield out()
                    held = {}
        if held:
            yield out()

    total = docs.count()
    df = docs.select(F.col(f"`{text}`")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    kept = df.where((F.col("df") >= max(2, low * total)) & (F.col("df") <= high * total)).select("term").toArrow()
    return np.sort(kept["term"].to_numpy().view(np.uint64))


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def fingerprint(text: bytes, known: np.ndarray, subsets: int = SUBSETS, levels: int = LEVELS) -> str:
    """"<terms>:<first level>:<hashes, 4 hex digits each, 0000 for an empty subset>". A text without a term of the
    lexicon is taken with all its terms; without any term it is "0:0:"."""
    from xxhash import xxh64_intdigest

    every = np.sort(hashes(terms(text)))
    at = np.searchsorted(known, every)
    own = every[known[np.minimum(at, len(known) - 1)] == every] if len(known) else every[:0]
    own = own if len(own) else every
    if not len(own):
        return "0:0:"
    first = max(0, len(own).bit_length() - 2)
    parts = []
    draws = [_mixed(own, s + 1) for s in range(subsets)]
    for level in range(first, first + levels):
        least = np.uint64(1 << (64 - level)) if level else None
        for d in draws:
            some = own if least is None else own[d < least]
            parts.append(f"{xxh64_intdigest(some.tobytes()) % 65535 + 1:04x}" if len(some) else "0000")
    return f"{len(own)}:{first}:{''.join(parts)}"


def likeness(a: str, b: str, subsets: int = SUBSETS) -> float:
    if a == b:
        return 1.0
    (n, la, x), (m, lb, y) = ((int(p), int(q), r) for p, q, r in (a.split(":"), b.split(":")))
    if not n or not m:
        return 0.0
    held = {lb + i // (4 * subsets): None for i in range(0, len(y), 4 * subsets)}
    same = some = 0
    for i in range(0, len(x), 4):
        level = la + i // (4 * subsets)
        if level in held:
            other = y[(level - lb) * 4 * subsets + i % (4 * subsets) :][:4]
            mine = x[i : i + 4]
            some += mine != "0000" or other != "0000"
            same += mine == other != "0000"
    return same / some if some else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text (or all it has)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_COLS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", low: float = LOW, high: float = HIGH) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and the likeness to that and to the next document's.

    The next document follows in ascending (doc_id, text), null ids first; the last is followed by the first. Null
    texts are empty; repeated rows follow each other; a lone row follows itself; an empty table gives no rows;
    further columns are not read. Tasks hold ranges of doc_id in order; only the first and last row of each task
    are put together afterwards.
    """
    spark = docs.sparkSession
    some = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(lexicon(some, "text", low, high))
    names = [c.split()[0] for c in _COLS.split(", ")]

    def rows(pairs: list[tuple]) -> list[tuple]:
        """(id, text, fingerprint, next text, next fingerprint) to result rows."""
        out = []
        for key, own, fp, following, fp_next in pairs:
            new = edited(own, following)
            data = new.encode()
            fp_new = fp if new == own else fingerprint(data, shared.value)
            out.append((key, len(own), hashlib.sha256(data).hexdigest(), fp, fp_new, likeness(fp, fp_new), likeness(fp, fp_next)))
        return out

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found = []
            for key, own in zip(*batch.columns, strict=True):
                key, own = key.as_py(), own.as_py()
                fp = fingerprint(own.encode(), shared.value)
                if last is not None:
                    found += rows([(*last, own, fp)])
                last = (key, own, fp)
            if found:
                yield batch_of(found)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_pylist() for c in batch.columns]
            prints = [[fingerprint(t.encode(), shared.value) for t in cols[i]] for i in (1, 2)]
            found = rows(list(zip(cols[0], cols[1], prints[0], cols[2], prints[1], strict=True)))
            yield batch_of(found)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last row of the task in order, without sorting: only rows of an extreme id are looked at."""
        place = lambda r: (r[0] is not None, r[0] or 0, r[1])
        low = high = None
        for batch in batches:
            ids = batch.column(0)
            for at in {*pc.min_max(ids).as_py().values()} | ({None} if ids.null_count else set()):
                rows_at = pc.is_null(ids) if at is None else pc.equal(ids, at)
                for row in zip(*(c.to_pylist() for c in batch.filter(pc.fill_null(rows_at, False)).columns), strict=True):
                    low = row if low is None or place(row) < place(low) else low
                    high = row if high is None or place(row) > place(high) else high
        if low is not None:
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.string()]
            row = [TaskContext.get().partitionId(), low[1], *high]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["task", "first_text", "doc_id", "text"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = some.repartitionByRange(tasks, "doc_id")  # one exchange, which both branches below read
    most = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, _COLS)
    # a row for each task that has rows, so the window's one partition is short
    order = W.orderBy("task")
    following = F.coalesce(F.lead("first_text").over(order), F.first("first_text").over(order.rowsBetween(W.unboundedPreceding, 0)))
    ends = dealt.mapInArrow(edges, "task int, first_text string, doc_id long, text string").select("doc_id", "text", following.alias("next_text")).mapInArrow(close, _COLS)
    return most.union(ends)
