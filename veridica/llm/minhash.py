"""MinHash near-duplicates by tensored banding, every link confirmed on full sets (operator 12).

A text's set holds its distinct word shingles. Two collections of ``M`` half keys are made, each half key of ``K`` min-hashes;
a table is a pair of half keys, one of each collection, so 2 * M * K = 96 min-hashes serve M**2 = 256 tables of 2 * K = 6,
which took 1,536 of their own. A pair of sets with a share J of common shingles meets in a table if one half key of each
collection agrees: with probability (1 - (1 - J**K)**M)**2, which is 0.99998 at 0.8 and grows with J.

Only half keys that two different sets have can make a table with two rows, so the others go first and most texts file no
table at all. Then table keys are counted and those of one row go. A table of up to ``HEAVY`` sets returns stars
that connect the pairs that differ in at most ``SKETCH`` of the 96 bits that their min-hashes give; the sets of a larger one are all
linked to its least by a join, so no task holds a table. Links make groups of candidates, and in a group links are confirmed
by full sets of shingles, in pieces of bounded size (``simhash.exact_links``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import as_bytes, saved
from .simhash import SEED, _hashes, exact_links, named

K, M = 3, 16
HEAVY = 4096
#: (1 - J) / 2 of the 96 bits of two sketches differ: 9.6 at 0.8, with a deviation of 2.9.
SKETCH = 25
_COUNT = 2 * M * K
_A, _B = (np.random.default_rng(12).integers(0, 1 << 63, (2, _COUNT, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def half_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a bit of each min-hash in two words, the 2 * M half keys) of the hashes of a set's shingles."""
    least = np.full(_COUNT, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[None, i : i + (1 << 12)] * _A + _B).min(axis=1))
    keys = np.arange(2 * M, dtype=np.uint64)  # the same min-hashes in another place are another key
    for part in least.reshape(2 * M, K).T:
        keys = (keys ^ part) * _MIX
        keys ^= keys >> np.uint64(32)
    bits = np.zeros(128, dtype=np.uint8)
    bits[:_COUNT] = least * _MIX >> np.uint64(63)
    return np.packbits(bits, bitorder="little").view("<u8"), keys


_PRINT = ["w1", "w2", "n_shingles", "s0", "s1"]


def _prints(rows: DataFrame, words: int) -> DataFrame:
    """``rows``: text last. Its other columns, the text's words as two hashes, the size of its set, sketches and half keys."""
    from xxhash import xxh3_128_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, keys = np.zeros((len(_PRINT), b.num_rows), dtype=np.uint64), np.zeros((b.num_rows, 2 * M), dtype=np.uint64)
            for i, x in enumerate(as_bytes(b.column(b.num_columns - 1))):
                seq = x.lower().split()
                whole = xxh3_128_intdigest(b" ".join(seq))
                hashes = np.unique(_hashes(seq, words, SEED))
                found[:3, i] = whole >> 64, whole & (2**64 - 1), len(hashes)
                found[3:, i], keys[i] = half_keys(hashes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * 2 * M, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(f.view(np.int64)) for f in found), lists], [*b.schema.names[:-1], *_PRINT, "halves"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{c} long" for c in _PRINT), "halves array<long>"])
    return rows.mapInArrow(run, schema)


def _stars(ids: np.ndarray, s0: np.ndarray, s1: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs connect whose sketches differ in at most ``radius`` bits: to the least of all that hang together."""
    left, found = np.arange(len(ids)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        own = queue[:]
        while queue and len(left):
            c = queue.pop()
            near = np.bitwise_count(s0[left] ^ s0[c]).astype(np.int64) + np.bitwise_count(s1[left] ^ s1[c]) <= radius
            own += left[near].tolist()
            queue += left[near].tolist()
            left = left[~near]
        least = ids[own].min()
        found += [(least, i) for i in ids[own] if i != least]
    return found


def _near(radius: int):
    """Reads (t, id, s0, s1) sorted by t, of bounded tables; returns links to the least of each table's rows that hang together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the last table so far
        for b in chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns] if b is not None else None
            cols = new if held is None else held if new is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            if cols is None:
                return
            starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            ends, done = np.append(starts[1:], len(cols[0])), len(starts) - (new is not None)
            found = []
            for s, e in zip(starts[:done], ends[:done], strict=True):
                if e - s > 1:
                    found += _stars(cols[1][s:e], cols[2][s:e].view(np.uint64), cols[3][s:e].view(np.uint64), radius)
            held = [c[starts[-1] :] for c in cols]
            both = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def candidates(own: DataFrame, heavy: int = HEAVY, radius: int = SKETCH) -> DataFrame:
    """``own``: (id, s0, s1, halves), saved, ids distinct. Links (a, b) of ids that connect what meets in some table."""
    halves = own.select("id", "s0", "s1", F.posexplode("halves").alias("at", "half"))
    # the place is part of a half key already, so keys of different places do not meet
    live = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    first, second = (F.collect_list(F.when((F.col("at") < M) == F.lit(side), F.col("half"))) for side in (True, False))
    both = halves.join(live.hint("merge"), "half").groupBy("id", "s0", "s1").agg(first.alias("first"), second.alias("second"))
    both = saved(both.where((F.size("first") > 0) & (F.size("second") > 0)), "halves")
    tables = both.select("id", "s0", "s1", "second", F.explode("first").alias("x")).select("id", "s0", "s1", F.explode(F.transform("second", lambda y: F.xxhash64("x", y))).alias("t"))
    sizes = saved(tables.groupBy("t").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "tables")
    light = tables.join(sizes.where(F.col("n") <= heavy).select("t").hint("merge"), "t").select("t", "id", "s0", "s1")
    near = light.repartition("t").sortWithinPartitions("t").mapInArrow(_near(radius), "a long, b long")
    large = sizes.where(F.col("n") > heavy)
    if large.isEmpty():
        return near
    return near.union(tables.join(large.hint("merge"), "t").where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, similarity: float = 0.8, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked if ``similarity`` of the union of their sets of ``words``-word shingles is common; a text of fewer words
    has one shingle of them all. component_id is the least doc_id that links reach, kept whether it is the row's own.

    Null and empty texts and texts without words have an empty set and no link: they are kept, each alone. Repeated rows
    stay repeated and are linked like other copies; null ids count only where a component has no other; an empty table gives
    no rows; further columns are not read.
    """
    every = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    id_of_text = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    prints = saved(_prints(every.select("doc_id", *id_of_text, size, "text"), words), "minhash")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "size", "s0", "s1", "halves")).alias("one")
    own = prints.where("n_shingles > 0").groupBy("w1", "w2").agg(one).select("w1", "w2", "one.*")
    own = saved(own.withColumn("id", F.monotonically_increasing_id()), "sets")
    roots = components(candidates(own, heavy)).withColumnRenamed("node", "id")
    some = saved(own.join(roots, "id").select("root", "id", "size", F.col("doc_id").alias("doc"), F.col("h1").alias("k1"), F.col("h2").alias("k2")), "candidates")
    # the row that stands for a set is met by its id and text, so copies of it fall out before they gather anywhere
    same = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    texts = every.select("doc_id", *id_of_text, "text").join(some.hint("merge"), same).select("root", "id", "size", "text").dropDuplicates(["id"])
    links = exact_links(saved(texts, "texts"), words, similarity)
    classes = saved(own.join(named(own.select("id", F.col("doc_id").alias("least")), links), "id").select("w1", "w2", "component_id"), "classes")
    out = prints.select("doc_id", "w1", "w2", "n_shingles").join(classes, ["w1", "w2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
