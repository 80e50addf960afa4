"""The prefix trie of conversations as succinct level-order tries (operator 11).

Turns are range-partitioned by (conversation, place), so a conversation of any length is many tasks. A prefix is known by a
polynomial hash of 127 bits, sum(x_i * B**(d - i)) over its turns' hashes x_i: a task hashes what it holds of a conversation
from nothing, and the part before it, if any, is added afterwards by one product. Rows with equal hashes are one node, and
counts, least members and sizes of nodes are plain aggregates, combined before they are shuffled.

A node weighs the turns of its members from it on, which is no less than the nodes below it. Nodes of over ``LIMIT`` are the
heavy upper levels; the subtrees under them are light. Light subtrees are dealt to shards; in a shard numpy lays out a LOUDS
bitvector and label arrays in level order and rolls counts up in reverse order by ``add.at``. The tops of the subtrees are
summed by parent, and the heavy levels, of at most turns / ``LIMIT`` nodes each, are merged in one pass from the deepest up
that holds one level at a time.

A node's members that end there are hashed from blocks of sorted ids, so many of them are a few rows for the one task that
has to feed them to SHA-256 in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import as_bytes, saved

LIMIT = 1 << 16
_P, _B = (1 << 127) - 1, 0x5DEECE66D1A3B5C7F0E9D8B7A6958473 % ((1 << 127) - 1)
_LOW = (1 << 64) - 1
#: Bytes of joined ids in a block.
_BLOCK = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------ places


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and a row's place, from 1, among the rows of its first column's value in it; reads sorted rows."""
    task, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(0).to_numpy(zero_copy_only=False)
        at = np.arange(b.num_rows)
        new = np.concatenate([[c[0] != last], c[1:] != c[:-1]])
        place = at - np.maximum.accumulate(np.where(new, at, -n if not new[0] else 0)) + 1
        last, n = c[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task, dtype=np.int64)), pa.array(place)], [*b.schema.names, "task", "i"])


def _indexed_schema(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("task", LongType()), StructField("i", LongType())])


def _before(parts: DataFrame) -> DataFrame:
    """``parts``: (c, task, n), one row each. (c, task, before) of those with earlier parts: at most one a task."""
    earlier = W.partitionBy("c").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("before", F.sum("n").over(earlier)).where("before is not null").select("c", "task", "before")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows``: bigint c first. Adds ``pos``, the place from 1 in ``order`` among the rows of c; equal rows in any order."""
    ranges = rows.repartitionByRange("c", *order).sortWithinPartitions("c", *order)
    put = saved(ranges.mapInArrow(_indexed, _indexed_schema(rows)), "turns")
    before = _before(put.groupBy("c", "task").agg(F.max("i").alias("n")))
    return put.join(F.broadcast(before), ["c", "task"], "left").withColumn("pos", F.col("i") + F.coalesce("before", F.lit(0))).drop("task", "i", "before")


def rebuilt(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations whose head is taken from another: the first h turns of conversation c - c % 5 and c's own after its first
    h, h = crc32(decimal c) % 9. Returns rows (c, part, pos, role, text, total) in the order (part, pos) and (c, total) of all c.

    Turns are ordered by ``turn`` (null first), then role and text; null roles and texts are empty; rows without conv_id are in
    no conversation and left out; repeated rows are turns each; no rows give nothing; further columns are not read.
    """
    t = turns.select(F.col(f"`{conv_id}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), *(F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(y) for x, y in ((role, "role"), (text, "text"))))
    t = placed(t.where("c is not null"), [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    own = t.groupBy("c").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 9
    facts = own.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % 5)
    facts = facts.join(own.select(F.col("c").alias("base"), F.col("n").alias("given")), "base", "left")
    facts = saved(facts.select("c", "base", "h", (F.least("h", F.coalesce("given", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("total")), "conversations")
    after = t.join(facts.hint("merge"), "c").where("pos > h").select("c", F.lit(1).alias("part"), "pos", "role", "text", "total")
    heads = t.where("pos <= 8").withColumnRenamed("c", "base").join(facts.hint("merge"), "base").where("pos <= h")
    return heads.select("c", F.lit(0).alias("part"), "pos", "role", "text", "total").union(after), facts.select("c", "total")


# ------------------------------------------------------------ prefixes


def _signed(x: int) -> int:
    x &= _LOW
    return x - (1 << 64) if x >> 63 else x


def _split(keys: list[int]) -> tuple[pa.Array, pa.Array]:
    return pa.array([k >> 64 for k in keys], pa.int64()), pa.array([_signed(k) for k in keys], pa.int64())


def turn_hash(role: bytes, text: bytes) -> int:
    from xxhash import xxh3_128_intdigest

    return xxh3_128_intdigest(pack("<Q", len(role)) + role + text) % _P


_CHAIN = "c long, total long, task long, i long, k1 long, k2 long, p1 long, p2 long, size long"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (c, total, role, text) in order; hashes of prefixes, and of those without the last turn, from the task's first on."""
    key, last = 0, None
    for b in batches:
        c, keys, before, sizes = b.column(0), [], [], []
        for x, role, text in zip(c.to_pylist(), as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True):
            key = 0 if x != last else key
            before.append(key)
            last, key = x, (key * _B + turn_hash(role, text)) % _P
            keys.append(key)
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([c, b.column(1), b.column(4), b.column(5), *_split(keys), *_split(before), pa.array(sizes, pa.int64())], _CHAIN.replace(" long", "").split(", "))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows of ``_CHAIN``, before, b1, b2: the turns before this part of a conversation and their hash, which is added."""
    for b in batches:
        cols = {n: b.column(n).to_pylist() for n in ("i", "k1", "k2", "p1", "p2", "b1", "b2")}
        keys, before = [], []
        for i, k1, k2, p1, p2, b1, b2 in zip(*cols.values(), strict=True):
            up = (b1 << 64 | b2 & _LOW) * pow(_B, i - 1, _P)
            before.append((up + (p1 << 64 | p2 & _LOW)) % _P)
            keys.append((up * _B + (k1 << 64 | k2 & _LOW)) % _P)
        depth = pa.array([i + n for i, n in zip(cols["i"], b.column("before").to_pylist(), strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("total"), depth, *_split(keys), *_split(before), b.column("size")], _PREFIX.replace(" long", "").split(", "))


_PREFIX = "c long, total long, depth long, k1 long, k2 long, p1 long, p2 long, size long"


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` as ``rebuilt`` gives them. (c, total, depth, k1, k2, p1, p2, size): the node that a conversation's first ``depth``
    turns are, its parent, and the bytes of its last text. The root is (0, 0)."""
    order = ["c", "part", "pos"]
    sorted_ = rows.select("c", "total", "role", "text", "part", "pos").repartitionByRange(*order).sortWithinPartitions(*order).select("c", "total", "role", "text")
    indexed = sorted_.mapInArrow(_indexed, _indexed_schema(sorted_))
    put = saved(indexed.mapInArrow(_chained, _CHAIN), "chains")
    parts = put.groupBy("c", "task").agg(F.max("i").alias("n"), F.max_by(F.struct("k1", "k2"), "i").alias("k"))
    # conversations that more than one task holds: at most one for each edge of a task
    parts = parts.withColumn("parts", F.count("*").over(W.partitionBy("c"))).where("parts > 1")
    known, carried = {}, []
    for r in sorted(parts.collect(), key=lambda r: (r.c, r.task)):
        n, key = known.get(r.c, (0, 0))
        if n:
            carried.append((r.c, r.task, n, *(x.as_py() for x in (a[0] for a in _split([key])))))
        known[r.c] = n + r.n, (key * pow(_B, r.n, _P) + (r.k.k1 << 64 | r.k.k2 & _LOW)) % _P
    cols = ["c", "total", F.col("i").alias("depth"), "k1", "k2", "p1", "p2", "size"]
    if not carried:
        return put.select(*cols)
    late = put.sparkSession.createDataFrame(carried, "c long, task long, before long, b1 long, b2 long")
    again = put.join(F.broadcast(late), ["c", "task"]).mapInArrow(_joined, _PREFIX)
    return saved(put.join(F.broadcast(late), ["c", "task"], "left_anti").select(*cols).union(again), "prefixes")


# ------------------------------------------------------------ tries


class Louds:
    """A level-order trie under one root, whose children are the nodes of level 0: ``bits`` has, for each node from the root on,
    a 1 for each child and a 0; ``order`` are the rows in that order, so that row order[j] is node j + 1."""

    def __init__(self, level: np.ndarray, key: np.ndarray, parent: np.ndarray):
        """``key`` and ``parent``: whole numbers below 2 * rows; rows of level 0 are children of the root whatever their parent."""
        n, at = len(level), np.argsort(level, kind="stable")
        self.starts = np.searchsorted(level[at], np.arange(level.max(initial=-1) + 2))
        place, order, up = np.zeros(2 * n + 1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for d in range(len(self.starts) - 1):
            rows = at[self.starts[d] : self.starts[d + 1]]
            above = place[parent[rows]] if d else np.zeros(len(rows), dtype=np.int64)
            by = np.lexsort((key[rows], above))
            span = slice(self.starts[d], self.starts[d + 1])
            order[span], up[span] = rows[by], above[by]
            place[key[rows[by]]] = np.arange(span.start, span.stop) + 1
        self.order = order
        self.bits = np.ones(2 * n + 1, dtype=bool)
        self.bits[np.cumsum(np.bincount(up, minlength=n + 1) + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """The parent of each node but the root: the zeros before its 1."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def children(self) -> np.ndarray:
        """Of each node, the root too: the ones between its zero and the zero before."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros, prepend=-1) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over the subtree of each row of ``values`` (in rows' order), which it returns in that order."""
        parent, total = self.parents(), np.concatenate([[0], values[self.order]])
        for d in range(len(self.starts) - 2, 0, -1):
            s, e = self.starts[d] + 1, self.starts[d + 1] + 1
            np.add.at(total, parent[s - 1 : e - 1], total[s:e])
        out = np.empty(len(values), dtype=np.int64)
        out[self.order] = total[1:]
        return out


_ROLLED = "k1 long, k2 long, p1 long, p2 long, top boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _shard(t: pa.Table) -> pa.Table:
    """A shard's nodes with their rollups."""
    cols = {c: t.column(c).to_numpy() for c in ("k1", "k2", "p1", "p2", "depth", "top_depth", "n_convs", "size")}
    both = np.stack([np.concatenate([cols["k1"], cols["p1"]]), np.concatenate([cols["k2"], cols["p2"]])], axis=1)
    code = np.unique(both, axis=0, return_inverse=True)[1].reshape(-1)
    trie = Louds(cols["depth"] - cols["top_depth"], code[: t.num_rows], code[t.num_rows :])
    children = np.empty(t.num_rows, dtype=np.int64)
    children[trie.order] = trie.children()[1:]
    leaves, saves = trie.rolled_up((children == 0).astype(np.int64)), trie.rolled_up((cols["n_convs"] - 1) * cols["size"])
    out = t.append_column("n_children", pa.array(children)).append_column("n_leaves", pa.array(leaves)).append_column("saved_tokens", pa.array(saves))
    return out.select([x.split()[0] for x in _ROLLED.split(", ")])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads heavy nodes, deepest first, whose three last columns hold the sums of their light children; adds those of the heavy
    ones. Holds the sums for the nodes of one level."""
    depth, now, above = None, {}, {}
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("k1", "k2", "p1", "p2", "depth", "n_convs", "size", "n_children", "n_leaves", "saved_tokens")]
        found = []
        for k1, k2, p1, p2, d, n, size, children, leaves, saves in zip(*cols, strict=True):
            if d != depth:
                depth, now, above = d, above, {}
            c, v, s = now.get((k1, k2), (0, 0, 0))
            c, v, s = c + children, v + leaves, s + saves + (n - 1) * size
            v += c == 0
            found.append((c, v, s))
            x = above.get((p1, p2), (0, 0, 0))
            above[p1, p2] = x[0] + 1, x[1] + v, x[2] + s
        sums = np.array(found, dtype=np.int64).reshape(-1, 3)
        names = [x.split()[0] for x in _ROLLED.split(", ")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:-3]), *(pa.array(sums[:, k]) for k in range(3))], names)


# ------------------------------------------------------------ ends


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (k1, k2, c) sorted; joins the ids of a node in blocks."""

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "low", "ids"])

    node, ids, size, rows = None, [], 0, []
    for b in batches:
        for k1, k2, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if (k1, k2) != node or size > _BLOCK:
                if ids:
                    rows.append((*node, int(ids[0]), ",".join(ids)))
                node, ids, size = (k1, k2), [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if rows:
            yield out(rows)
            rows = []
    if ids:
        yield out([(*node, int(ids[0]), ",".join(ids))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (k1, k2, low, ids) sorted; the SHA-256 of a node's ids, a block after the other."""
    node, sha = None, None

    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0][0] for d in done], pa.int64()), pa.array([d[0][1] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["k1", "k2", "ends_sha256"])

    for b in batches:
        done = []
        for k1, k2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(3)), strict=True):
            if (k1, k2) == node:
                sha.update(b"," + ids)
                continue
            if node is not None:
                done.append((node, sha.hexdigest()))
            node, sha = (k1, k2), hashlib.sha256(ids)
        if done:
            yield out(done)
    if node is not None:
        yield out([(node, sha.hexdigest())])


def ends_of(ends: DataFrame) -> DataFrame:
    """``ends``: (k1, k2, c), distinct. (k1, k2, ends_sha256)."""
    by = ["k1", "k2", "c"]
    blocks = ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_blocks, "k1 long, k2 long, low long, ids string")
    return blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "low").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


# ------------------------------------------------------------ all


def prefix_trie(rows: DataFrame, convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows``: (c, part, pos, role, text, total), turns in the order (part, pos) of conversations of ``total`` turns; ``convs``:
    (c, total) of all, turnless ones too, which are members of the root. ``limit``: the weight from which a node is of the
    heavy upper levels. No conversation, no node.
    """
    turns = prefixes(rows)
    weight = F.sum(F.col("total") - F.col("depth") + 1).alias("w")
    same = [F.first(c).alias(c) for c in ("p1", "p2", "depth", "size")]
    nodes = turns.groupBy("k1", "k2").agg(*same, F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), weight)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), zero.alias("size"), "conv_id", "n_convs", F.lit((1 << 63) - 1).alias("w"))
    nodes = saved(nodes.unionByName(root), "nodes")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), (F.col("w") > limit).alias("under"))
    top = (F.col("w") <= limit) & F.col("under")
    nodes = saved(nodes.join(above.hint("merge"), ["p1", "p2"], "left").withColumn("top", F.coalesce(top, F.lit(False))).drop("under"), "nodes")

    # every member of a light node passes the same top, the least too
    tops = nodes.where("top").select("k1", "k2", F.col("depth").alias("top_depth"), F.xxhash64("k1", "k2").alias("shard"))
    cuts = turns.join(tops.hint("merge"), ["k1", "k2"]).select(F.col("c").alias("conv_id"), "top_depth", "shard")
    total = nodes.where("top").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    shards = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // limit))
    light = nodes.where(F.col("w") <= limit).join(cuts.hint("merge"), "conv_id").withColumn("shard", F.pmod("shard", F.lit(shards)))
    rolled = saved(light.groupBy("shard").applyInArrow(_shard, _ROLLED), "tries")

    sums = rolled.where("top").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    sums = sums.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children", "n_leaves", "saved_tokens")
    heavy = nodes.where(F.col("w") > limit).join(sums.hint("merge"), ["k1", "k2"], "left").fillna(0, sums.columns[2:])
    upper = heavy.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_merged, _ROLLED)

    last = turns.where("depth = total").select("k1", "k2", "c").union(convs.where("total = 0").select(zero, zero, "c"))
    out = rolled.union(upper).join(ends_of(last).hint("merge"), ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
