"""SimHash near-duplicate classes by multi-index hashing (operator 2).

Fingerprint: 64 bits, bit i set if it is set in more than half of the XXH64 hashes (seed 42) of the
text's word shingles. Two fingerprints are linked if they differ in at most ``RADIUS`` = 3 bits.

Index: a fingerprint has two segments of 32 bits. If two fingerprints differ in three bits, one of
the segments differs in at most one, so each fingerprint is filed under its own segment values and
probes the Hamming ball of radius 1 around each. A pair that differs in one bit of a segment needs
one probe only, so just the side whose bit is 0 probes. What meets under a key is verified on all 64
bits, and a bucket returns a spanning forest of its links, never all pairs. A bucket of over
``HEAVY`` rows goes to a second index of 16-bit segments of the other half, whose buckets share 48
bits and so hold at most 2**16 values and their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..operators.graph import components
from .common import as_bytes, saved, unused

RADIUS = 3
HEAVY = 4096
SEED = 42
_BLOCK = 1 << 15


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text as an unsigned 64-bit number; no words: 0; too few for a shingle: one of them all."""
    return _fingerprint(text.lower().split(), words, seed)


def _hashes(seq: list[bytes], words: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if not seq:
        return np.zeros(0, dtype="<u8")
    grams = [b" ".join(seq)] if len(seq) < words else map(b" ".join, zip(*(seq[i:] for i in range(words)), strict=False)) if words > 1 else seq
    return np.array([xxh64_intdigest(g, seed) for g in grams], dtype="<u8")


def _fingerprint(seq: list[bytes], words: int, seed: int) -> int:
    return _majority(_hashes(seq, words, seed))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, keys: list[str], kinds: list[tuple[int, int]]) -> DataFrame:
    """The ``keys`` columns and, for each (words, seed) of ``kinds``, ``fp0``, ``fp1`` ... bigint (the bits, signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros((len(kinds), b.num_rows), dtype=np.uint64)
            for i, x in enumerate(as_bytes(b.column(b.num_columns - 1))):
                seq = x.lower().split()
                for k, (words, seed) in enumerate(kinds):
                    found[k, i] = _fingerprint(seq, words, seed)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(f.view(np.int64)) for f in found)], [*b.schema.names[:-1], *(f"fp{k}" for k in range(len(kinds)))])

    some = docs.select(*keys, text)
    schema = some.drop(text).schema
    for k in range(len(kinds)):
        schema = schema.add(f"fp{k}", "long")
    return some.mapInArrow(run, schema)


def _ball(value: Column, width: int) -> Column:
    """(value, true) and, for every 0 bit, (value with that bit set, false)."""
    flips = [F.when(value.bitwiseAND(F.lit(1 << i)) == 0, F.struct(value.bitwiseOR(F.lit(1 << i)).alias("value"), F.lit(False).alias("own"))) for i in range(width)]
    return F.filter(F.array(F.struct(value.alias("value"), F.lit(True).alias("own")), *flips), lambda x: x.isNotNull())


def _filed(rows: DataFrame, keep: list[str], segments: list[tuple[Column, Column]], width: int) -> DataFrame:
    """A row for each entry and probe: ``keep``, part, value, own, id, fp, chk. segments: (whole fingerprint, segment)."""
    parts = F.array(*(F.struct(F.lit(i).alias("part"), f.alias("fp"), _ball(s, width).alias("ball")) for i, (f, s) in enumerate(segments)))
    one = rows.select(*keep, "id", "chk", F.explode(parts).alias("p")).select(*keep, "id", "chk", "p.part", "p.fp", F.explode("p.ball").alias("b"))
    return one.select(*keep, "part", "b.value", "b.own", "id", "fp", "chk")


def forest(ids: np.ndarray, fps: np.ndarray, chk: np.ndarray, radius: int, chk_radius: int) -> np.ndarray:
    """(n, 2): links of a spanning forest of the graph of pairs within both radii; every link is a true one."""
    ids, first = np.unique(ids, return_index=True)
    fps, chk, found = fps[first].view(np.uint64), chk[first].view(np.uint64), []
    while len(ids):
        queue, ids, fps, chk = [(ids[0], fps[0], chk[0])], ids[1:], fps[1:], chk[1:]
        while queue and len(ids):
            i, f, c = queue.pop()
            near = (np.bitwise_count(fps ^ f) <= radius) & (np.bitwise_count(chk ^ c) <= chk_radius)
            if near.any():
                found.append(np.column_stack([np.full(near.sum(), i), ids[near]]))
                queue += list(zip(ids[near], fps[near], chk[near], strict=True))
                ids, fps, chk = ids[~near], fps[~near], chk[~near]
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


_FOUND = "part int, value long, a long, b long, c long"


def _buckets(keys: int, heavy: int | None, radius: int, chk_radius: int, star: bool = False):
    """Reads rows sorted by ``keys`` leading columns; then come own, id, fp, chk. Returns links (part -1, a and b
    the ids) and the rows of buckets of over ``heavy`` rows (part and value theirs; id, fp, chk). With ``star`` the rows of
    such a bucket are all linked instead, whatever their radii, so that a task holds ``heavy`` rows and a batch of it."""

    def out(part, value, a, b, c) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (value, a, b, c))], ["part", "value", "a", "b", "c"])

    def late(cols) -> pa.RecordBatch:
        if star:  # the last row of a piece is the first of the next
            ids = cols[-3]
            zero = np.zeros(len(ids) - 1, dtype=np.int64)
            return out(zero - 1, zero, np.full(len(zero), ids[0]), ids[1:], zero)
        return out(cols[0], cols[1], *cols[-3:])

    def joined(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if pairs:
            both = np.concatenate(pairs)
            zero = np.zeros(len(both), dtype=np.int64)
            yield out(zero - 1, zero, both[:, 0], both[:, 1], zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the last bucket so far
        passed = False  # some of them went on as heavy

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, passed
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            if cols and (passed or heavy and len(cols[0]) > heavy):
                yield late(cols)
            elif cols and cols[keys].any() and len(cols[0]) > 1:
                yield from joined([forest(*cols[-3:], radius, chk_radius)])
            held, passed = [], False

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [batch.num_rows]])
            if held and all(held[-1][i][-1] == cols[i][0] for i in range(keys)):
                held.append([c[: ends[0]] for c in cols])
                starts, ends = starts[1:], ends[1:]
                if heavy and sum(len(h[0]) for h in held) > heavy:
                    yield late([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, passed = [[c[-1:] for c in held[-1]]], True  # that row goes twice, which does no harm
                if not len(starts):
                    continue
            yield from close()
            own, pairs = np.add.reduceat(cols[keys].astype(np.int64), starts), []
            for k in np.flatnonzero((ends - starts > 1) & (own > 0)):
                if k == len(starts) - 1:
                    break
                here = [c[starts[k] : ends[k]] for c in cols]
                if heavy and len(here[0]) > heavy:
                    yield late(here)
                else:
                    pairs.append(forest(*here[-3:], radius, chk_radius))
            yield from joined(pairs)
            held = [[c[starts[-1] :] for c in cols]]
        yield from close()

    return run


def links(prints: DataFrame, fps: list[str], radius: int = RADIUS, chk_radius: int = 64, heavy: int = HEAVY) -> DataFrame:
    """``prints``: bigint columns ``id`` (distinct), ``chk`` and ``fps``, saved. Two rows are linked if one of the ``fps``
    differs in at most ``radius`` (at most 3) bits and ``chk`` in at most ``chk_radius``. Returns links (a, b) of ids
    that connect just what all links connect."""
    if radius > 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    segments = [(F.col(f), s) for f in fps for s in (F.col(f).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f, 32))]
    rows = _filed(prints, [], segments, 32).repartition("part", "value").sortWithinPartitions("part", "value")
    found = saved(rows.mapInArrow(_buckets(2, heavy, radius, chk_radius), _FOUND), "buckets")
    first = found.where("part = -1").select("a", "b")
    rest = found.where("part >= 0").select(F.col("part").alias("outer"), F.col("value").alias("key"), F.col("a").alias("id"), F.col("b").alias("fp"), F.col("c").alias("chk")).distinct()
    if rest.isEmpty():
        return first
    other = F.when(F.col("outer") % 2 == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    again = _filed(rest, ["outer", "key"], [(F.col("fp"), other.bitwiseAND(F.lit(0xFFFF))), (F.col("fp"), F.shiftrightunsigned(other, 16))], 16)
    keys = ["outer", "key", "part", "value"]
    return first.union(again.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_buckets(4, None, radius, chk_radius), _FOUND).where("part = -1").select("a", "b"))


def named(own: DataFrame, found: DataFrame) -> DataFrame:
    """``own``: (id, least), saved; ``found``: links of ids. Returns (id, component_id): the least of ``least`` that links reach."""
    roots = saved(components(found).withColumnRenamed("node", "id"), "roots")
    least = roots.join(own, "id").groupBy("root").agg(F.min("least").alias("component_id"))
    met = roots.join(least, "root").select("id", "component_id")
    return own.join(met, "id", "left").select("id", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id: the least doc_id that links reach.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows stay repeated; null ids
    count only where a component has no other; an empty table gives no rows; further columns are not read.
    """
    prints = saved(with_fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], [(words, SEED)]).withColumnRenamed("fp0", "fp"), "simhash")
    own = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumnRenamed("fp", "id"), "prints")
    # written first, so that the join with all rows is a plain one, whose hot keys Spark can split
    classes = saved(named(own, links(own.select("id", F.col("id").alias("fp"), F.col("id").alias("chk")), ["fp"], radius)), "classes")
    return prints.join(classes.withColumnRenamed("id", "fp"), "fp", "left").select("doc_id", "fp", "component_id")


#: Min-hashes of a text's shingles and the bands of them that ``keep_one`` files it under: two texts with a share J of
#: common shingles meet in one of the bands with probability 1 - (1 - J**5)**24, which is 0.9999 at 0.8.
MINHASHES, BANDS, BAND = 128, 24, 5
_A, _B = (np.random.default_rng(SEED).integers(0, 1 << 63, (2, MINHASHES, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits in which each of the two sketches may differ; (1 - J) / 2 of 64 are expected, 6.4 at 0.8 with a deviation of 2.4.
SKETCH = 15


def minhashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(two sketches of one bit of each of 64 min-hashes, ``BANDS`` keys) of the hashes of a text's shingles."""
    least = np.full(MINHASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[None, i : i + (1 << 12)] * _A + _B).min(axis=1))
    keys = np.zeros(BANDS, dtype=np.uint64)
    for part in least[: BANDS * BAND].reshape(BANDS, BAND).T:
        keys = (keys ^ part) * _MIX
        keys ^= keys >> np.uint64(32)
    return np.packbits((least * _MIX >> np.uint64(63)).astype(np.uint8), bitorder="little").view("<u8"), keys


def _with_minhashes(docs: DataFrame, text: str, keys: list[str], words: int) -> DataFrame:
    """The ``keys`` columns, the shingle fingerprint ``fp``, the sketches ``s0`` and ``s1``, and ``bands``."""
    names = ["fp", "s0", "s1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, bands = np.zeros((len(names), b.num_rows), dtype=np.uint64), np.zeros((b.num_rows, BANDS), dtype=np.uint64)
            for i, x in enumerate(as_bytes(b.column(b.num_columns - 1))):
                hashes = _hashes(x.lower().split(), words, SEED)
                found[0, i] = _majority(hashes)
                found[1:, i], bands[i] = minhashes(hashes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(f.view(np.int64)) for f in found), lists], [*b.schema.names[:-1], *names, "bands"])

    some = docs.select(*keys, text)
    schema = some.drop(text).schema
    for name in names:
        schema = schema.add(name, "long")
    return some.mapInArrow(run, schema.add("bands", ArrayType(LongType())))


def _common(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many of each set's numbers are in ``own``; all sorted, distinct, not empty."""
    every, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    return np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)


def shared_shingles(ids: list[int], sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """(n, 2): links of a spanning forest of the graph of pairs whose sets (sorted, distinct, not empty) share ``similarity`` of their union."""
    sizes, left, found = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            c = queue.pop()
            fit = left[np.minimum(sizes[left], sizes[c]) >= similarity * np.maximum(sizes[left], sizes[c]) - 1e-9]
            common = np.zeros(len(fit), dtype=np.int64)
            for i in range(0, len(fit), 256):
                common[i : i + 256] = _common(sets[c], [sets[k] for k in fit[i : i + 256]])
            near = fit[common >= similarity * (sizes[fit] + sizes[c] - common) - 1e-9]
            found += [(ids[c], ids[k]) for k in near]
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def _shingles(text: bytes, words: int) -> np.ndarray:
    hashes = _hashes(text.lower().split(), words, SEED)
    return np.unique(hashes) if len(hashes) else np.zeros(1, dtype=np.uint64)


def _links(pairs) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _verified(words: int, similarity: float):
    """Reads (unit, id, text) sorted by unit; returns the links of each unit's texts that hold by their exact sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            for unit, i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                if unit != last and held:
                    yield _links(shared_shingles(list(held), list(held.values()), similarity))
                    held = {}
                last = unit
                if i not in held:
                    held[i] = _shingles(x, words)
        if held:
            yield _links(shared_shingles(list(held), list(held.values()), similarity))

    return run


def _across(words: int, similarity: float):
    """Reads (unit, side, id, class, text) sorted by unit and side. Holds a unit's texts of side 0 and compares each of side 1
    with those of other classes; returns one link that holds for each pair of classes that have any in the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, met = None, [], set()
        for batch in batches:
            found = []
            for unit, side, i, c, x in zip(*(batch.column(k).to_pylist() for k in range(4)), as_bytes(batch.column(4)), strict=True):
                if unit != last:
                    last, held, met = unit, [], set()
                own = _shingles(x, words)
                if side == 0:
                    held.append((i, c, own))
                    continue
                fit = [h for h in held if h[1] != c and (h[1], c) not in met and min(len(h[2]), len(own)) >= similarity * max(len(h[2]), len(own)) - 1e-9]
                if fit:
                    sizes, common = np.array([len(h[2]) for h in fit]), _common(own, [h[2] for h in fit])
                    for k in np.flatnonzero(common >= similarity * (sizes + len(own) - common) - 1e-9):
                        if (fit[k][1], c) not in met:
                            met.add((fit[k][1], c))
                            found.append((i, fit[k][0]))
            yield _links(found)

    return run


#: Texts, and their bytes, that an exact comparison holds at once; a larger group of candidates is dealt to several.
UNIT, UNIT_BYTES = 256, 1 << 20
_SALTS = 64


def _units(n: Column, size: Column, unit: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(unit)), F.ceil(size / F.lit(UNIT_BYTES)), F.lit(1)).cast("int")


def _of_root(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """``rows`` with the ``facts`` of their root; the rows of one root meet them in ``_SALTS`` tasks."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).join(salted, ["root", "salt"], how).drop("salt")


def exact_links(texts: DataFrame, words: int, similarity: float, unit: int = UNIT) -> DataFrame:
    """``texts``: (root, id, size, text), saved, ids distinct. Links (a, b) that connect just what the pairs of one root with
    ``similarity`` connect.

    A root of up to ``unit`` texts is compared in one piece. A larger one is dealt twice, at random, into pieces, whose
    links make classes; then every text outside its root's largest class meets, in tiles of bounded size, all texts of the
    other classes of its root, so no pair of different classes is left out.
    """
    facts = texts.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    large = saved(facts.select("root", _units(F.col("n"), F.col("bytes"), unit).alias("units")).where("units > 1"), "large")
    deals = F.when(F.col("units").isNull(), F.array(F.xxhash64("root"))).otherwise(F.array(*(F.xxhash64("root", F.lit(d), F.pmod(F.xxhash64("id", F.lit(d)), F.col("units"))) for d in (0, 1))))
    dealt = _of_root(texts, large, "left").select(F.explode(deals).alias("unit"), "id", "text")
    found = saved(dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verified(words, similarity), "a long, b long"), "exact")
    if large.isEmpty():
        return found
    members = _of_root(texts.select("root", "id", "size"), large, "inner")
    mine = found.join(members.select(F.col("id").alias("a")), "a", "left_semi")
    classes = components(mine).select(F.col("node").alias("id"), F.col("root").alias("class"))
    members = saved(members.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id")), "members")
    each = members.groupBy("root", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("units").alias("units"))
    whole = each.groupBy("root").agg(F.max("units").alias("units"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "class")).alias("main"))
    split = whole.where("n > main.n").select("root", F.col("main.class").alias("main"), _units(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"), unit).alias("others"))
    split = saved(split, "split")
    if split.isEmpty():
        return found
    open_ = _of_root(members, split, "inner").join(texts.select("id", "text").hint("merge"), "id")

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(2)), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def tile(side: int) -> Column:
        return F.xxhash64("root", "row", "at").alias("unit"), F.lit(side).alias("side"), "id", "class", "text"

    rest = open_.where("class != main").withColumn("row", part("others")).withColumn("at", every("units")).select(*tile(0))
    all_ = open_.withColumn("at", part("units")).withColumn("row", every("others")).select(*tile(1))
    more = rest.union(all_).repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_across(words, similarity), "a long, b long")
    return found.union(more)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8, unit: int = UNIT) -> DataFrame:
    """The rows of ``docs`` but, of each class of near duplicates, only that of least (doc_id, hash of the row).

    Two rows are near duplicates if ``similarity`` of the union of their five-word shingles is common. Candidates are texts
    whose shingle fingerprints lie within 3 bits, found by multi-index hashing, and, as a fingerprint of 64 bits tells
    likeness too roughly for edits in one place, texts that share one of ``BANDS`` bands of min-hashes and differ in at most
    ``SKETCH`` bits of two sketches each (under a band of over ``HEAVY`` texts all are candidates). What candidates connect is compared by exact sets of shingles (``exact_links``), in
    pieces of about ``unit`` texts, however large the group.

    Null ids come last; of rows that are equal in every column one stays; texts without words, null ones among them, are one
    class; an empty table gives no rows. Columns are unchanged, whatever their names.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    h1, h2, k1, k2 = unused(docs.columns, "_h1", "_h2", "_k1", "_k2")
    key = [F.xxhash64(*every).alias(h1), F.hash(*every).alias(h2)]
    keys = [F.xxhash64(*every).alias("h1"), F.hash(*every).alias("h2")]
    twice = [F.xxhash64(F.col(f"`{text}`")).alias("t1"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("t2")]  # 128 bits tell texts apart
    some = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *keys, *twice, F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("size"), F.col(f"`{text}`").alias("text"))
    prints = saved(_with_minhashes(some, "text", ["doc_id", "h1", "h2", "t1", "t2", "size"], words), "simhash")
    least = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h1", "h2")
    own = prints.groupBy("t1", "t2").agg(F.min(least).alias("least"), *(F.first(f).alias(f) for f in ("size", "fp", "s0", "s1", "bands"))).drop("t1", "t2")
    own = saved(own.withColumn("id", F.monotonically_increasing_id()), "prints")
    near = links(own.select("id", "fp", F.col("fp").alias("chk")), ["fp"])
    banded = own.select(F.posexplode("bands").alias("part", "value"), F.lit(True).alias("own"), "id", F.col("s0").alias("fp"), F.col("s1").alias("chk"))
    met = banded.repartition("part", "value").sortWithinPartitions("part", "value").mapInArrow(_buckets(2, HEAVY, SKETCH, SKETCH, star=True), _FOUND)
    roots = components(met.select("a", "b").union(near)).withColumnRenamed("node", "id")
    some = saved(own.join(roots, "id").select("root", "id", "size", F.col("least.h1").alias("k1"), F.col("least.h2").alias("k2")), "candidates")
    # texts are met by a merge at every size: what a few rows would allow is no plan for many
    texts = docs.select(*keys, F.col(f"`{text}`").alias("text")).dropDuplicates(["h1", "h2"])
    texts = texts.join(some.hint("merge"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select("root", "id", "size", "text")
    exact = exact_links(saved(texts, "texts"), words, similarity, unit)
    classes = named(own.select("id", "least"), exact)
    chosen = saved(classes.select(F.col("component_id.h1").alias(k1), F.col("component_id.h2").alias(k2)).distinct(), "kept")
    rows = docs.select(*every, *key)
    kept = rows.join(chosen.hint("merge"), (F.col(h1) == F.col(k1)) & (F.col(h2) == F.col(k2)), "left_semi")
    return kept.dropDuplicates([h1, h2]).select(*every)
