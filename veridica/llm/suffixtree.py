"""LM scoring with a probabilistic suffix tree (operator 7).

A text is its words (``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case), each closed by one space, and one end
symbol (line feed): a sequence of bytes. The tree gives every byte a probability after its context, the up to ``DEPTH``
bytes before it (line feeds ahead of the text); a token's is the product over its bytes and a text's that over its tokens, so
known and unseen words alike pay their spelling and the probabilities of all texts add up to 1 at most (the base score is no
such probability: it gives any unseen word one share, however spelt). What precedes a word (its language above all) counts
for its spelling.

Tree: a context is kept if it is at least ``SHARE`` of all training symbols and the next-symbol distribution diverges
from that of its suffix (count times Kullback-Leibler divergence of at least ``DIVERGENCE`` nats for each next symbol), or if a longer kept
context ends in it. ``SHARE`` is the least empirical probability that algorithms for such trees ask of a context; there are at most
DEPTH / SHARE such contexts whatever the corpus, so the tree has a proven bound and can be broadcast.
Distributions are smoothed by the suffix's: (count + k * P(suffix)) / (total + k) with k = ``PRIOR`` times the number of
different next symbols, down to a uniform one.

Scoring follows the longest kept suffix. Closing the tree under prefixes makes it an automaton: one look-up a byte.
Texts are cut into segments that are read side by side, each after the DEPTH bytes before it.

For the base score the same pass counts words. Words that are ``FREQUENT`` of all tokens or more (at most 1 / FREQUENT of them) go out as a
table; the others, none of which can be a hot key, meet their counts in a join. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, saved
from .quality import fold

DEPTH, SHARE, DIVERGENCE, PRIOR = 6, 8e-6, 2.0, 2.0
FREQUENT = 5e-7
SEGMENT, CHUNK, HELD = 512, 1 << 20, 1 << 18
END = 10
#: symbols that a sequence can hold: all bytes but A-Z and the white space that separates
_POSSIBLE = np.array([b == END or b == 32 or not (9 <= b <= 13 or 65 <= b <= 90) for b in range(256)])


def canonical(text: bytes) -> tuple[bytes, list[bytes]]:
    words = text.lower().split()
    return b" ".join([*words, b"\n"]), words


def grams(data: bytes, depth: int = DEPTH) -> np.ndarray:
    """Every run of depth + 1 bytes as a number, the last byte lowest."""
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = len(a) - depth
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(depth + 1):
        out = out << np.uint64(8) | a[k : k + n]
    return out


def _counted(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, dtype=np.int64)
    return v[first], np.add.reduceat(c, first) if len(first) else c


def gathered(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs``: (text, training boolean). Returns (kind, key, learnt, every): counts of word hashes (kind 0; key null
    is the end), and of runs of depth + 1 symbols of the training texts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        pad, ends = b"\n" * depth, [0, 0]
        words: dict[bytes, int] = {}  # training tokens, and in the higher half all tokens
        kept, parts, size, empty = ([], []), [], 0, 0

        def out(kind: int, key, learnt, every) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(learnt), kind), pa.int32()), pa.array(key, pa.int64()), pa.array(learnt, pa.int64()), pa.array(every, pa.int64())], ["kind", "key", "learnt", "every"])

        def flush() -> pa.RecordBatch:
            nonlocal words
            both = np.fromiter(words.values(), dtype=np.int64, count=len(words))
            keys = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
            words = {}
            return out(0, keys.view(np.int64), both & 0xFFFFFFFF, both >> 32)

        def add() -> None:
            nonlocal kept, parts, size
            g = grams(b"".join(parts), depth)
            parts, size = [], 0
            g = np.sort(g[g & np.uint64(0xFFFF) != np.uint64(END << 8 | END)])  # what ends in the padding is no symbol of a text
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
            kept[0].append(g[first])
            kept[1].append(np.diff(np.append(first, len(g))))
            kept = tuple([x] for x in _counted(*kept))

        for batch in batches:
            for text, learn in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                line, own = canonical(text)
                one = 1 << 32 | bool(learn)
                for w in own:
                    words[w] = words.get(w, 0) + one
                ends[1] += 1
                if len(words) > HELD:
                    yield flush()
                if learn:
                    ends[0] += 1
                    empty += not own
                    if own:
                        parts += [pad, line]
                        size += len(line)
                        if size > CHUNK:
                            add()
        if words:
            yield flush()
        if ends[1]:
            yield out(0, [None], [ends[0]], [ends[1]])
        if parts:
            add()
        if empty:
            kept[0].append(np.array([int.from_bytes(b"\n" * (depth + 1), "big")], dtype=np.uint64))
            kept[1].append(np.array([empty]))
        if kept[0]:
            key, n = _counted(*kept)
            yield out(1, key.view(np.int64), n, n)

    found = docs.mapInArrow(run, "kind int, key long, learnt long, every long")
    return found.groupBy("kind", "key").agg(F.sum("learnt").alias("learnt"), F.sum("every").alias("every"))


def contexts(runs: DataFrame, depth: int = DEPTH, share: float = SHARE, divergence: float = DIVERGENCE) -> DataFrame:
    """``runs``: (key, n), the counts of runs of depth + 1 symbols. Returns (d, ctx, sym, c, total) of kept contexts and of the empty one."""
    level = runs.select(F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1)).alias("ctx"), F.col("key").bitwiseAND(F.lit(255)).alias("sym"), F.col("n").alias("c"))
    levels = {depth: level}
    for d in reversed(range(depth)):  # each level sums the one above it, which is written and far smaller each time
        level = saved(level.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx"), "sym").agg(F.sum("c").alias("c")), "contexts")
        levels[d] = level
    symbols = levels[0].agg(F.sum("c")).first()[0] or 0
    rows = None
    for d, level in levels.items():
        often = level.groupBy("ctx").agg(F.sum("c").alias("total")).where(F.col("total") >= share * symbols)
        some = level.join(often, "ctx").select(F.lit(d).alias("d"), "ctx", "sym", "c", "total")
        rows = some if rows is None else rows.union(some)
    rows = saved(rows, "contexts")
    up = rows.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("up"), "sym", F.col("c").alias("uc"), F.col("total").alias("ut"))
    down = rows.where("d > 0").withColumn("up", F.expr("ctx & (shiftleft(1L, 8 * (d - 1)) - 1)"))
    gain = F.sum(F.col("c") * F.log(F.col("c") / F.col("total") / (F.col("uc") / F.col("ut"))))
    far = down.join(up, ["d", "up", "sym"]).groupBy("d", "ctx").agg(gain.alias("gain"), F.count("*").alias("n")).where(F.col("gain") >= divergence * F.col("n")).select("d", "ctx")
    return rows.join(far, ["d", "ctx"], "left_semi").union(rows.where("d = 0"))


class Tree:
    """The automaton: ``step[state, class of byte]`` and ``log10[state, class of byte]``; state 0 is the empty context."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]], depth: int = DEPTH, prior: float = PRIOR):
        own: dict[bytes, tuple[int, list[tuple[int, int]]]] = {}
        for d, ctx, sym, c, total in rows:
            own.setdefault(ctx.to_bytes(d, "big") if d else b"", (total, []))[1].append((sym, c))
        states = {b""}
        for s in own:
            states |= {s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        start = b"\n" * depth
        states |= {start[:i] for i in range(depth + 1)}
        ordered = sorted(states, key=lambda s: (len(s), s))
        index = {s: i for i, s in enumerate(ordered)}
        seen = sorted({sym for _, nexts in own.values() for sym, _ in nexts} | {b for s in states for b in s} | {END, 32})
        self.classes = np.full(256, len(seen), dtype=np.int64)  # bytes that no context tells of share one class
        self.classes[seen] = np.arange(len(seen))
        width = len(seen) + 1
        index_up = np.array([index[s[1:]] for s in ordered])
        child_of, child, sym = (np.array(x, dtype=np.int64) for x in zip(*((index[s[:-1]], i, self.classes[s[-1]]) for s, i in index.items() if s), strict=True))
        ends = np.searchsorted([len(s) for s in ordered], np.arange(depth + 2))
        p = np.empty((len(ordered), width), dtype=np.float32)
        step = np.zeros((len(ordered), width), dtype=np.int32)
        p[0] = 1 / _POSSIBLE.sum()
        for size in range(depth + 1):  # rows of one length come from rows of the length before
            lo, hi = ends[size], ends[size + 1]
            if size:
                p[lo:hi], step[lo:hi] = p[index_up[lo:hi]], step[index_up[lo:hi]]
            for i in range(lo, hi):
                if ordered[i] in own:
                    total, nexts = own[ordered[i]]
                    weight = prior * len(nexts)
                    p[i] *= weight / (total + weight)
                    p[i, self.classes[[a for a, _ in nexts]]] += np.array([c for _, c in nexts]) / (total + weight)
            mine = (child_of >= lo) & (child_of < hi)
            step[child_of[mine], sym[mine]] = child[mine]
        self.width, self.start, self.depth = width, index[start], depth
        self.step, self.log10 = step.ravel(), np.log10(p, out=p).ravel()

    def logs(self, lines: list[bytes]) -> np.ndarray:
        """log10 probability of each byte of the canonical lines, one after the other."""
        sizes = np.array([len(x) for x in lines], dtype=np.int64)
        pad = np.full(self.depth, END, dtype=np.uint8)
        data = self.classes[np.concatenate([y for x in lines for y in (pad, np.frombuffer(x, dtype=np.uint8))])].astype(np.int32)
        begins = np.cumsum(sizes + self.depth) - sizes
        segments = -(-sizes // SEGMENT)
        line = np.repeat(np.arange(len(lines)), segments)
        nth = np.arange(len(line)) - np.repeat(np.cumsum(segments) - segments, segments)
        at, left = begins[line] + nth * SEGMENT, np.minimum(sizes[line] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        # after the depth symbols before it a segment is in the state of a whole read, whatever it began with
        state = np.full(len(at), self.start, dtype=np.int32)
        for k in range(-self.depth, 0):
            state = self.step[state * self.width + data[at + k]]
        out = np.zeros(len(data), dtype=np.float32)
        alive = np.searchsorted(-left, -np.arange(SEGMENT), side="left")  # segments longer than k come first
        for k in range(int(left.max(initial=0))):
            n = alive[k]
            cell = state[:n] * self.width + data[at[:n] + k]
            out[at[:n] + k] = self.log10[cell]
            state[:n] = self.step[cell]
        own = np.ones(len(data), dtype=bool)
        own[(begins[:, None] - 1 - np.arange(self.depth)).ravel()] = False
        return out[own]

    def tokens(self, lines: list[bytes]) -> np.ndarray:
        """log10 probability of each token (a word with its space, or the end)."""
        raw = np.frombuffer(b"".join(lines), dtype=np.uint8)
        last = np.flatnonzero((raw == 32) | (raw == END))
        return np.add.reduceat(self.logs(lines), np.concatenate([[0], last[:-1] + 1]), dtype=np.float64) if len(raw) else np.zeros(0)


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, share: float = SHARE, divergence: float = DIVERGENCE, prior: float = PRIOR, frequent: float = FREQUENT) -> DataFrame:
    """For every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score, both log10.

    Learns from rows where ``held_out`` is false. Null and empty texts are one end token; repeated rows count and
    are scored each; without training rows every token is unseen; an empty table gives no rows; further columns are
    not read.
    """
    spark = docs.sparkSession
    some = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), held_out.alias("held_out"))
    counts = saved(gathered(some.select("text", ~F.col("held_out")), depth), "counts")
    runs = contexts(counts.where("kind = 1").select("key", F.col("learnt").alias("n")), depth, share, divergence).toArrow()
    tree = Tree(list(zip(*(c.to_pylist() for c in runs.columns), strict=True)), depth, prior)
    words = counts.where("kind = 0")
    totals = words.agg(F.sum("learnt"), F.count_if(F.col("learnt") > 0), F.sum("every"), F.max(F.when(F.col("key").isNull(), F.col("learnt")))).first()
    n, known, tokens, end = (x or 0 for x in totals)
    often = words.where(F.col("key").isNotNull() & (F.col("every") >= max(1.0, frequent * tokens))).select("key", "learnt").toArrow()
    order = np.argsort(often["key"].to_numpy().view(np.uint64))
    table = (often["key"].to_numpy().view(np.uint64)[order], often["learnt"].to_numpy()[order])
    shared = spark.sparkContext.broadcast((tree, *table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        tree, keys, learnt = shared.value
        cached: dict[bytes, int] = {}  # counts of frequent words, -1 of others

        def look_up(new: list[bytes]) -> None:
            h = np.fromiter(map(xxh64_intdigest, new), dtype=np.uint64, count=len(new))
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            found = np.where(keys[at] == h, learnt[at], -1) if len(keys) else np.full(len(new), -1)
            cached.update(zip(new, found.tolist(), strict=True))

        for batch in batches:
            lo, size, lines, own_of = 0, 0, [], []
            for i, x in enumerate(as_bytes(batch.column(1))):
                line, own = canonical(x)
                if len(cached) > HELD:
                    cached.clear()
                if new := set(own).difference(cached):
                    look_up(list(new))
                lines.append(line)
                own_of.append((own, np.fromiter(map(cached.__getitem__, own), dtype=np.int64, count=len(own))))
                size += len(line)
                if size > CHUNK or i == batch.num_rows - 1:
                    spelt, at, rows, rare, rare_at = tree.tokens(lines), 0, [], [], [0]
                    for own, got in own_of:
                        total, at = float(spelt[at : at + len(own) + 1].sum()), at + len(own) + 1
                        late = got < 0
                        rare += [xxh64_intdigest(own[k]) for k in np.flatnonzero(late)]
                        rare_at.append(len(rare))
                        c = np.append(got[~late], end)
                        rows.append((len(own) + 1, int((c > 0).sum()), float(np.log10(c + 1.0).sum()), total))
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                    lists = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(np.array(rare, dtype=np.uint64).view(np.int64)))
                    ids = [batch.column(0).slice(lo, len(lines)), batch.column(2).slice(lo, len(lines))]
                    yield pa.RecordBatch.from_arrays([*ids, *cols, lists], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare"])
                    lo, size, lines, own_of = i + 1, 0, [], []

    made = some.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<long>")
    made = saved(made.withColumn("row", F.monotonically_increasing_id()), "scores")
    pairs = made.select("row", F.explode("rare").alias("key"))
    c = F.col("learnt")
    seen = pairs.join(words.where("key is not null").select("key", "learnt"), "key").groupBy("row").agg(F.count_if(c > 0).alias("k"), F.sum(F.log10(c + 1.0)).alias("l"))
    whole = made.drop("rare").join(seen, "row", "left")
    base = F.col("logs") + F.coalesce("l", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + known + 1)))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def held(doc_id: str = "doc_id", folds: int = 7, which: int = 2) -> Column:
    return fold(F.col(f"`{doc_id}`"), folds) == which
