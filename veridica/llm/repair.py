"""Token ids in shards compressed by Re-Pair grammars (operator 6).

Documents are dealt out by ranges of (doc_id, hash of the text) and sorted, so that shards follow each other in
ascending order. A shard holds whole documents of about ``SHARD`` ids. A round replaces all frequent pairs of
neighbours, those seen ``LEAST`` times or more, by nonterminals; where two of them overlap, the more frequent one
goes first. Rounds go on until no pair is frequent: neither rounds nor rules are limited. After the first round only
pairs with a symbol of the round before are counted, and a count of all pairs ends the work. A pair whose places are
nearly all taken by others, under half of ``LEAST``, waits for a later round, since its rule would not pay. No pair
begins with an end id, so every document begins at a symbol of its own.

A shard is one binary image (little-endian)::

    b"RPG1", int64 x 5: base (first nonterminal), rules, symbols, documents, ids
    uint32 left[rules], uint32 right[rules], uint32 expansion length[rules]
    int64 doc_id[documents], uint8 doc_id is null[documents]
    uint32 first symbol[documents], uint32 ids[documents]
    uint16 low part[symbols], then zlib of uint8 high part[symbols]

It is stored as a cell of a Parquet table (``TABLE``; before: the ids before it in its task), so that Spark's writers commit it and
any store that Spark reads can hold it. ``Shard`` decodes one document without the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, new_path
from .packing import blocks
from .tokens import encoder, gather

SHARD, LEAST = 1 << 21, 16
#: Bytes of text that are encoded at once.
BLOCK = 2 << 20
MAGIC = b"RPG1"
TABLE = "task long, part long, before long, n_ids long, image binary"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIERS, _SLOTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD), 18


def _ranks(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Place of each key in ``pairs`` (distinct), -1 if it is not there: by tables of slots, and by search for what no table could take."""
    rank, left = np.full(len(keys), -1, dtype=np.int32), np.arange(len(pairs), dtype=np.int32)
    open_ = None  # places of the keys that are not found yet and share a slot with a pair
    for m in _MULTIPLIERS:
        table = np.full(1 << _SLOTS, -1, dtype=np.int32)
        slot = (pairs[left] * np.uint64(m) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        table[slot] = left
        lost = left[table[slot] != left]
        some = keys if open_ is None else keys[open_]
        got = table[(some * np.uint64(m) >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        taken = np.flatnonzero(got >= 0)
        right = pairs[got[taken]] == some[taken]
        hit = taken[right]
        rank[hit if open_ is None else open_[hit]] = got[hit]
        if not len(lost):
            return rank
        # a key of a pair that lost its slot meets the winner there
        open_, left = taken[~right] if open_ is None else open_[taken[~right]], lost
    order = left[np.argsort(pairs[left])]
    at = np.minimum(np.searchsorted(pairs[order], keys[open_]), len(order) - 1)
    right = pairs[order][at] == keys[open_]
    rank[open_[right]] = order[at[right]]
    return rank


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of overlapping places (ascending; neighbours differ by 1) those that are replaced: a lower rank goes first, of equal
    ones every other. What stays overlaps with a chosen one."""
    chosen = np.zeros(len(at), dtype=bool)
    left = np.arange(len(at))
    for _ in range(3):
        a, r = at[left], rank[left].astype(np.int64)
        before = np.concatenate([[False], np.diff(a) == 1])
        after = np.concatenate([before[1:], [False]])
        worse_before = ~before | (r < np.concatenate([[0], r[:-1]]))
        worse_after = ~after | (r < np.concatenate([r[1:], [0]]))
        best = worse_before & worse_after
        chosen[left[best]] = True
        near = best | (after & np.concatenate([best[1:], [False]])) | (before & np.concatenate([[False], best[:-1]]))
        left = left[~near]
        if not len(left):
            return chosen
    a = at[left]
    run = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(a) != 1]), np.arange(len(a)), 0))
    chosen[left[(np.arange(len(a)) - run) % 2 == 0]] = True
    return chosen


def compress(ids: np.ndarray, base: int, end_id: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules as (n, 2)). Symbols from ``base`` on are nonterminals; no pair of the result that may be replaced is seen ``least`` (2 or more) times."""
    least = max(2, least)
    a, made, total = ids.astype(np.uint32), [], base
    closed = np.zeros(base + 1, dtype=bool)
    closed[end_id] = True
    places = None  # of pairs that are counted: all, or those with a new symbol
    while len(a) > 1:
        first, second = (a[:-1], a[1:]) if places is None else (a[places], a[places + 1])
        keys = first.astype(np.uint64) << np.uint64(32) | second
        keys[closed[first]] = _NONE
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts, pairs = np.diff(np.append(edge, len(ordered))), ordered[edge]
        often = (counts >= least) & (pairs != _NONE)
        if not often.any():
            if places is None:
                break
            places = None
            continue
        counts, pairs = counts[often], pairs[often]
        pairs = pairs[np.argsort(-counts, kind="stable")]
        rank = _ranks(keys, pairs)
        hit = np.flatnonzero(rank >= 0)
        at, rank = hit if places is None else places[hit], rank[hit]
        go = _apart(at, rank)
        at, rank = at[go], rank[go]
        used = np.bincount(rank, minlength=len(pairs)) * 2 >= least
        go = used[rank]
        at, rank = at[go], rank[go]
        pairs = pairs[used]
        a[at] = (total - 1 + np.cumsum(used))[rank]
        keep = np.ones(len(a), dtype=bool)
        keep[at + 1] = False
        a = a[keep]
        rule = np.column_stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
        if total + len(rule) >= len(closed):
            closed = np.concatenate([closed, np.zeros(max(len(closed), len(rule)), dtype=bool)])
        closed[total : total + len(rule)] = closed[rule[:, 1]]
        total += len(rule)
        made.append(rule)
        new = at - np.arange(len(at))  # their places now
        near = np.zeros(len(a) + 1, dtype=bool)
        near[new] = near[new - 1] = True  # a place of -1 is the spare one at the end
        places = np.flatnonzero(near[: len(a) - 1])
    return a, np.concatenate(made) if made else np.zeros((0, 2), dtype=np.uint32)


def _sizes(base: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to."""
    sizes = np.ones(len(rules), dtype=np.int64)
    inner = rules.astype(np.int64) - base
    while True:  # a round for each level of nesting
        now = np.where(inner >= 0, sizes[np.maximum(inner, 0)], 1).sum(axis=1) if len(rules) else sizes
        if np.array_equal(now, sizes):
            return sizes
        sizes = now


def image(ids: np.ndarray, counts: np.ndarray, doc_ids: list[int | None], base: int, end_id: int, **how: int) -> bytes:
    """``ids``: those of all documents, each closed by ``end_id``; ``counts``: ids of each document."""
    symbols, rules = compress(ids, base, end_id, **how)
    sizes = _sizes(base, rules)
    each = np.where(symbols < base, 1, sizes[np.maximum(symbols.astype(np.int64) - base, 0)] if len(rules) else 1)
    starts = np.searchsorted(np.cumsum(each) - each, np.cumsum(counts) - counts)
    head = np.array([base, len(rules), len(symbols), len(counts), len(ids)], dtype="<i8")
    parts = [head, rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), sizes.astype("<u4"), np.array([x or 0 for x in doc_ids], dtype="<i8"), np.array([x is None for x in doc_ids], dtype=np.uint8), starts.astype("<u4"), counts.astype("<u4"), (symbols & 0xFFFF).astype("<u2")]
    return b"".join([MAGIC, *(p.tobytes() for p in parts), zlib.compress((symbols >> 16).astype(np.uint8).tobytes(), 1)])


class Shard:
    """Reads an image; ``ids(k)`` expands document k alone, ``all_ids()`` everything."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        self.base, rules, symbols, docs, self.total = np.frombuffer(data, "<i8", 5, 4).tolist()
        at = 44

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        left, right, self.sizes = take("<u4", rules), take("<u4", rules), take("<u4", rules).astype(np.int64)
        self.rules = np.column_stack([left, right]).astype(np.int64)
        keys, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else k for k, n in zip(keys.tolist(), null.tolist(), strict=True)]
        self.first, self.counts = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        low = take("<u2", symbols).astype(np.int64)
        self.symbols = low | np.frombuffer(zlib.decompress(data[at:]), np.uint8).astype(np.int64) << 16

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        while len(inner := np.flatnonzero(symbols >= self.base)):
            width = np.ones(len(symbols), dtype=np.int64)
            width[inner] = 2
            out = np.repeat(symbols, width)
            at = (np.cumsum(width) - width)[inner]
            out[at], out[at + 1] = self.rules[symbols[inner] - self.base].T
            symbols = out
        return symbols

    def ids(self, k: int) -> np.ndarray:
        end = self.first[k + 1] if k + 1 < len(self.first) else len(self.symbols)
        return self.expand(self.symbols[self.first[k] : end])

    def all_ids(self) -> np.ndarray:
        """By a table of the rules' expansions, each made of earlier ones."""
        base, n = self.base, len(self.rules)
        flat, starts, sizes = np.arange(base, dtype=np.int64), np.arange(base + n, dtype=np.int64), np.ones(base + n, dtype=np.int64)
        sizes[base:] = self.sizes
        done = 0
        while done < n:  # the rules up to the first that needs one of themselves
            late = np.flatnonzero(self.rules[done:].max(axis=1) >= base + done)
            upto = done + int(late[0]) if len(late) else n
            both = self.rules[done:upto].ravel()
            new = gather(flat, starts[both], sizes[both])
            starts[base + done : base + upto] = len(flat) + np.cumsum(sizes[base + done : base + upto]) - sizes[base + done : base + upto]
            flat, done = np.concatenate([flat, new]), upto
        return gather(flat, starts[self.symbols], sizes[self.symbols])


def write(docs: DataFrame, path: str, tokenizer: str, byte_level: bool, end_id: int, text: str = "text", doc_id: str = "doc_id", tasks: int | None = None, shard: int = SHARD) -> None:
    """Writes the shards of all rows in ascending (doc_id, hash of the text, text), null ids first, as a Parquet table at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, part = encoder(tokenizer, byte_level), TaskContext.get().partitionId(), 0
        base = max(known.tokenizer.get_vocab_size(), end_id + 1)
        keys, parts, counts, size, before = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keys, parts, counts, size, part, before
            data = image(np.concatenate(parts), np.concatenate(counts), keys, base, end_id)
            row = [pa.array([task], pa.int64()), pa.array([part], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())]
            keys, parts, counts, size, part, before = [], [], [], 0, part + 1, before + size
            return pa.RecordBatch.from_arrays(row, [x.split()[0] for x in TABLE.split(", ")])

        for batch in batches:
            for ids_of, texts in blocks(batch.column(0), as_bytes(batch.column(1)), BLOCK):
                ids, lengths = known.encode(texts)
                out = np.insert(ids, np.cumsum(lengths), end_id)
                keys += ids_of
                parts.append(out.astype(np.uint32))
                counts.append(lengths + 1)
                size += len(out)
                if size >= shard:
                    yield close()
        if keys:
            yield close()

    some = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    tasks = tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the rows of one id, or of none, are dealt out by their texts' hash
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = some.repartitionByRange(tasks, *order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(run, TABLE).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all before it), n_tokens, ids_crc32. Only totals of tasks reach the driver."""
    shards = spark.read.schema(TABLE).parquet(path)
    total, base = 0, {}
    for task, n in sorted(shards.groupBy("task").agg(F.sum("n_ids")).collect()):
        base[task], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, before, data in zip(*batch.columns, strict=True):
                s = Shard(data.as_py())
                ids = s.all_ids().astype("<u4").tobytes()
                ends = np.cumsum(s.counts)
                starts = ends - s.counts
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = (s.doc_ids, starts + base[task.as_py()] + before.as_py(), s.counts, crc)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("task", "before", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, byte_level: bool, end_id: int, **how) -> DataFrame:
    """Writes ``docs`` to a new table in the shared folder and returns what ``read`` finds there.

    Null and empty texts have the end id alone; repeated rows and ids stay repeated, in the order of the hashes of their texts;
    an empty table gives no rows; further columns are not read.
    """
    path = new_path(docs.sparkSession, "shards")
    write(docs, path, tokenizer, byte_level, end_id, **how)
    return read(docs.sparkSession, path)
