"""Importance resampling towards a target's distribution of hashed word n-grams (operator 13).

Every run of 1 to ``N`` consecutive words is a feature; its bucket is its crc32 modulo ``BUCKETS``. A bucket's gain is the
log ratio of its smoothed shares in the target and in the corpus, a document's weight the sum of its features' gains, and the
documents of the highest weight plus Gumbel noise (drawn from the id's hash) are a sample without replacement.

Overlap chunking: a text of over ``LONG`` bytes is split at word boundaries into chunks of about ``CHUNK`` bytes. A chunk owns
the features that start in its words and carries the N - 1 words that follow, so no feature is lost or counted twice. Chunks
are dealt to all tasks by hash, so a very long text is work for many of them; counts and weights of chunks are summed by
document. Shorter texts are one chunk each and stay where they are read.

Counts of the corpus leave a task as one row a bucket; the gains (``BUCKETS`` numbers, whatever the corpus) go to all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import as_bytes, saved

N, BUCKETS = 3, 10_000
LONG, CHUNK = 1 << 16, 1 << 15
_BATCH = 1 << 16

#: Letters A to Z in lower case; every other byte that is no digit, no letter and below 0x80 parts words.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _zeros() -> np.ndarray:
    """[k, j, x]: what byte j of value x adds to a crc when 2**k zero bytes follow (a linear map over bits)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)

    def by_zero(c: np.ndarray) -> np.ndarray:
        return one[c & 255] ^ (c >> 8)

    x = np.arange(256, dtype=np.uint32)
    maps = [np.stack([by_zero(x << np.uint32(8 * j)) for j in range(4)])]
    for _ in range(31):
        maps.append(np.stack([_applied(maps[-1], row) for row in maps[-1]]))
    return np.stack(maps)


def _applied(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return m[0][c & 255] ^ m[1][(c >> 8) & 255] ^ m[2][(c >> 16) & 255] ^ m[3][c >> 24]


_ZEROS = _zeros()


def extended(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``crc`` of texts, as it counts in the crc of those texts with ``n`` more bytes: xor the crc of these bytes to it."""
    crc = crc.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> k & 1)
        crc[at] = _applied(_ZEROS[k], crc[at])
    return crc


def chunks(text: bytes, size: int = CHUNK) -> Iterator[tuple[bytes, bytes]]:
    """(own words, the N - 1 words that follow), parted by spaces, of pieces of about ``size`` bytes; a word is never split."""
    text = text.translate(_LETTERS)
    following, at = re.compile(rb" *(?:[^ ]+ *){0,%d}" % (N - 1)), 0
    while True:
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end], following.match(text, end)[0]
        if end == len(text):
            return
        at = end


def features(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own words of each part, the part of each feature, its bucket) of parts as ``chunks`` gives them."""
    words, own, all_ = [], [], []
    for mine, after in parts:
        n = len(words)
        words += mine.split()
        own.append(len(words) - n)
        words += after.split() if own[-1] else ()
        all_.append(len(words) - n)
    own, all_ = np.array(own, dtype=np.int64), np.array(all_, dtype=np.int64)
    end = np.cumsum(all_)
    part = np.repeat(np.arange(len(parts)), all_)
    at = np.arange(len(words))
    starts, stop = at < (end - all_ + own)[part], end[part]
    crc = np.fromiter(map(crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    tail = extended(np.full(len(words), crc32(b" "), dtype=np.uint32), size) ^ crc  # of a space and the word
    run, found = crc, []
    for k in range(N):
        if k:
            run = extended(run[:-1], size[k:] + 1) ^ tail[k:]
        live = np.flatnonzero(starts[: len(run)] & (at[: len(run)] + k < stop[: len(run)]))
        found.append((part[live], run[live] % BUCKETS))
    return own, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)


def _grouped(parts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Lists of (own, carry, ...) of about ``_BATCH`` bytes."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= _BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _parts(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple]:
    """(own, carry, row, doc_id) of rows (row, doc_id, text), or of rows (row, doc_id, own, carry) of long texts."""
    for b in batches:
        keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        if whole:
            for (row, doc), x in zip(keys, as_bytes(b.column(2)), strict=True):
                yield x.translate(_LETTERS), b"", row, doc
        else:
            for (row, doc), own, carry in zip(keys, as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True):
                yield own, carry, row, doc


def _counter(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for group in _grouped(_parts(batches, whole)):
            total += np.bincount(features([p[:2] for p in group])[2], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def _weigher(gains: np.ndarray, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(_parts(batches, whole)):
            words, part, bucket = features([p[:2] for p in group])
            weight = np.zeros(len(group), dtype=np.int64)
            np.add.at(weight, part, gains[bucket])
            n = np.bincount(part, minlength=len(group)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([p[2] for p in group], pa.int64()), pa.array([p[3] for p in group], pa.int64()), *map(pa.array, (words, n, weight))], _FACTS.replace(" long", "").split(", "))

    return run


_FACTS = "row long, doc_id long, n_words long, n_features long, weight long"


def _dealt(texts: DataFrame, long: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """``texts``: (doc_id, text). (row, doc_id, text) of the short ones and (row, doc_id, own, carry) of chunks of the long ones."""
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(as_bytes(b.column(2))):
                for at, (own, carry) in enumerate(chunks(x, chunk)):
                    yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], b.column(1)[i : i + 1], pa.array([at], pa.int64()), pa.array([own], pa.binary()), pa.array([carry], pa.binary())], ["row", "doc_id", "at", "own", "carry"])

    split = rows.where(size > long).mapInArrow(run, "row long, doc_id long, at long, own binary, carry binary").repartition("row", "at")
    return rows.where(size <= long), split.select("row", "doc_id", "own", "carry")


def counts(texts: DataFrame, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """(bucket, n) of all features of ``texts`` (doc_id, text); buckets without any are absent."""
    short, split = _dealt(texts, long, chunk)
    each = short.mapInArrow(_counter(True), "bucket int, n long").union(split.mapInArrow(_counter(False), "bucket int, n long"))
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) for every bucket, from the ``counts`` of both: floor(1000 * ln of the ratio of shares, one added to each)."""
    each = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = each.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))

    def d(c: str, add: int) -> Column:
        return F.col(c).cast("double") + F.lit(float(add))

    ratio = d("t", 1) * d("all_s", BUCKETS) / (d("s", 1) * d("all_t", BUCKETS))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(texts: DataFrame, gain: list[int], long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row for each of ``texts`` (doc_id, text)."""
    short, split = _dealt(texts, long, chunk)
    g = np.array(gain, dtype=np.int64)
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    of_long = split.mapInArrow(_weigher(g, False), _FACTS).groupBy("row", "doc_id").agg(*sums).drop("row")
    return short.mapInArrow(_weigher(g, True), _FACTS).drop("row").union(of_long)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, at_least: int = 20, seed: int = 42, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``, drawn towards the texts of ``target``.

    Of the N rows with ``at_least`` words, floor(``percent`` * N / 100) of the highest scores get a rank from 1; ties go to the
    smaller doc_id (null first, then fewer features); rank is null elsewhere. Null and empty texts have no features and
    weight 0; repeated rows are drawn each; a null doc_id is hashed as the word null; an empty table gives no rows, and with an
    empty target gains follow the corpus alone. Further columns are not read.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    other = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{target_text}`").alias("text"))
    # one number a bucket, BUCKETS in all
    gain = [r.gain for r in gains(counts(own, long, chunk), counts(other, long, chunk)).orderBy("bucket").collect()]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = saved(weights(own, gain, long, chunk).withColumn("score", F.col("weight") + noise), "scored")
    fit = F.col("n_words") >= at_least
    drawn = percent * scored.where(fit).count() // 100
    placed = numbered(scored, [(~fit).asc(), F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")], "place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(fit & (F.col("place") <= drawn), F.col("place")).cast("long").alias("rank"))
