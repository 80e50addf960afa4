"""Operators 11 to 13 against brute force and SQL; nulls, ties, repeats, empty tables, hot keys, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connection
from tests.llm.test_llm import TEXTS, WORD, doubled, empty, rows
from veridica.llm import minhash, queries, resample, trie


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_tensored_minhash", "op13_importance_resampling"])
def test_against_sql(spark, sf, name):
    assert_same(spark, sf, connection(sf), queries.QUERIES[name], queries.ORACLE_SQL[name])


# ------------------------------------------------------------ 11


def brute_trie(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = []
    below = {}
    for p in sorted(members, key=len, reverse=True):
        children = [below[k] for k in below if k[:-1] == p and len(k) == len(p) + 1]
        saves = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(x[1] for x in children)
        below[p] = (sum(x[0] for x in children) or 1, saves)
        ends = ",".join(map(str, sorted(c for c in members[p] if whole[c] == p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def conversations(spark, data):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    return df.withColumn("c", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("task", F.lit("x")).withColumn("k1", F.lit(2.5))


def trie_rows(spark, data, **how):
    return Counter(map(tuple, trie.prefix_trie(*trie.rebuilt(conversations(spark, data)), **how).collect()))


def talk(n, seed):
    """Conversations with common heads, one of very many turns, exact copies, and ids that are missing as bases."""
    rng, data = np.random.default_rng(seed), []
    for c in rng.choice(4 * n, n, replace=False).tolist():
        common = rng.integers(0, 6)
        for k in range(int(rng.integers(1, 14))):
            data.append((c, k, "user" if k % 2 == 0 else "assistant", f"héllo {k}" if k < common else f"w{rng.integers(0, 3)}"))
    data += [(90_000 + 5 * c, k, "user", f"copy {k}") for c in range(40) for k in range(6)]
    return data + [(80_000, k, "user", f"turn {k % 7}") for k in range(600)]


@pytest.mark.parametrize("limit", [1, 40, trie.LIMIT])
def test_op11_brute_force(spark, limit):
    data = talk(120, limit)
    assert trie_rows(spark, data, limit=limit) == brute_trie(data)


def test_op11_conversation_of_many_tasks(spark):
    data = [(7, k, "user", f"turn {k % 11}") for k in range(500)] + [(5, k, "user", "x") for k in range(3)] + [(12, 0, "user", "x")]
    df = conversations(spark, data)
    turns, convs = trie.rebuilt(df)
    assert turns.where("c = 7").count() == convs.where("c = 7").first().total
    parts = trie.prefixes(turns).where("c = 7").orderBy("depth").collect()
    assert [r.depth for r in parts] == list(range(1, len(parts) + 1))
    assert all((b.p1, b.p2) == (a.k1, a.k2) for a, b in zip(parts, parts[1:], strict=False)) and (parts[0].p1, parts[0].p2) == (0, 0)
    assert trie_rows(spark, data, limit=16) == brute_trie(data)


def test_op11_odd_rows(spark):
    data = [
        (None, 1, "user", "lost"), (1, None, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 1, "system", None), (-3, 0, "user", "a"), (-3, 5, "user", "b"),
        (0, 0, "user", "x"), (0, None, "user", "y"), (6, 0, "u", "ser"), (6, 1, "us", "er"), (8, 0, "user", "é" * 5000),
    ]
    for limit in (1, 1000):
        assert trie_rows(spark, data, limit=limit) == brute_trie(data)
        assert trie_rows(spark, data + data, limit=limit) == brute_trie(data + data)
    assert trie_rows(spark, []) == Counter() and trie_rows(spark, [(None, 1, "user", "lost")]) == Counter()
    assert trie_rows(spark, [(4, 1, "user", "a")]) == brute_trie([(4, 1, "user", "a")])


def test_op11_louds():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 300):
        up = np.array([int(rng.integers(-1, i)) if i else -1 for i in range(n)], dtype=np.int64)
        level = np.zeros(n, dtype=np.int64)
        for i in range(n):
            level[i] = 0 if up[i] < 0 else level[up[i]] + 1
        t = trie.Louds(level, np.arange(n), np.where(up < 0, n, up))
        assert len(t.bits) == 2 * n + 1 and t.bits.sum() == n
        parent, children = t.parents(), t.children()
        assert [(-1 if parent[j] == 0 else t.order[parent[j] - 1]) for j in range(n)] == up[t.order].tolist()
        assert children[0] == (up < 0).sum() and children[1:].tolist() == [(up == i).sum() for i in t.order]
        values = rng.integers(0, 9, n)
        want = values.copy()
        for i in reversed(range(n)):
            if up[i] >= 0:
                want[up[i]] += want[i]
        assert t.rolled_up(values).tolist() == want.tolist()


def test_op11_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "_BLOCK", 10)
    ids = list(range(-5, 300, 3))
    got = trie.ends_of(spark.createDataFrame([(1, k % 2, c) for k, c in enumerate(ids)], "k1 long, k2 long, c long")).collect()
    assert {r.k2: r.ends_sha256 for r in got} == {k: hashlib.sha256(",".join(map(str, ids[k::2])).encode()).hexdigest() for k in (0, 1)}


# ------------------------------------------------------------ 12


def shingles(text, n=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute_near(docs):
    sets, least = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return Counter((d, len(s), ids.get(root(i)), d == ids.get(root(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def edited(rng, words, vocabulary, share):
    out = list(words)
    for _ in range(max(1, int(share * len(out)))):
        out[int(rng.integers(len(out)))] = str(rng.choice(vocabulary))
    return out


@pytest.mark.parametrize("heavy", [2, 10, minhash.HEAVY])
def test_op12_brute_force(spark, heavy):
    rng, vocabulary = np.random.default_rng(heavy), [f"w{i}" for i in range(400)]
    passage, docs = [str(w) for w in rng.choice(vocabulary, 60)], []
    for k in range(50):
        base = [str(w) for w in rng.choice(vocabulary, int(rng.integers(3, 200)))] + (passage if k % 3 == 0 else [])
        docs.append(base)
        for _ in range(int(rng.integers(0, 5))):
            docs.append(edited(rng, docs[-1 if rng.random() < 0.3 else docs.index(base)], vocabulary, rng.choice([0.0, 0.01, 0.03, 0.05])))
    data = [(1000 - k, " ".join(d).replace("w1", "W1") if k % 4 == 0 else " ".join(d)) for k, d in enumerate(docs)]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(5), heavy=heavy)
    want = brute_near(data)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(not k[3] for k in want) > 20


def test_op12_threshold_and_blocks(spark):
    """Two texts that share two thirds of their union are linked through a third that has just four fifths of either."""
    rng, data = np.random.default_rng(8), []
    for k in range(120):
        n = int(rng.integers(40, 300))
        one = [f"a{k}_{i}" for i in range(n + 3)]
        common = -(-8 * n // 10) + 1
        two = one[: common + 3] + [f"b{k}_{i}" for i in range(n - common)]  # 80 % of each, so 2/3 of the union: no link of their own
        cut = one[: -(-8 * n // 10) + 3]  # a part of four fifths: just linked
        data += [(3 * k, " ".join(one)), (3 * k + 1, " ".join(two)), (3 * k + 2, " ".join(cut) + ("" if k % 2 else " "))]
    got = Counter(map(tuple, minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()))
    want = brute_near(data)
    assert got == want and sum(not k[3] for k in want) == 240


def test_op12_odd_rows(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    for d in (rows(spark), doubled(spark)):
        d = d.withColumn("id", F.lit(1)).withColumn("root", F.lit("r")).withColumn("halves", F.lit(3))
        got = Counter(map(tuple, minhash.near_duplicates(d).collect()))
        want = brute_near([(r.doc_id, r.text) for r in d.collect()])
        want = Counter({(a, n, c if n else a, d if n else True): v for (a, n, c, d), v in want.items()})
        assert got == Counter({(a, n, c, a == c): v for (a, n, c, _), v in want.items()})
    alone = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " \t", "one two", "ONE two"])], "doc_id long, text string")
    assert [tuple(r)[1:] for r in minhash.near_duplicates(alone).orderBy("doc_id").collect() if not r.n_shingles] == [(0, i, True) for i in (0, 1, 2)]


def test_op12_hot_group(spark):
    """A third of all rows are copies, another third near copies of one text; one passage is in every other text."""
    rng, vocabulary = np.random.default_rng(2), [f"w{i}" for i in range(5000)]
    hot, passage = ([str(w) for w in rng.choice(vocabulary, n)] for n in (300, 60))
    texts = [hot] * 300 + [edited(rng, hot, vocabulary, 0.005) for _ in range(300)] + [passage + [str(w) for w in rng.choice(vocabulary, 120)] for _ in range(300)]
    data = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), heavy=50)
    assert Counter(map(tuple, got.collect())) == brute_near(data)


# ------------------------------------------------------------ 13

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    w = TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def brute_draw(docs, target):
    each = [brute_features(t) for _, t in docs]
    s, t = sum((f for _, f in each), Counter()), sum((brute_features(x)[1] for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for (d, _), (n, f) in zip(docs, each, strict=True):
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in f.items())
        out.append([d, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    places = {id(r): k + 1 for k, r in enumerate(fit[: 5 * len(fit) // 100])}
    return Counter((*r[:4], places.get(id(r))) for r in out)


@pytest.mark.parametrize(("long", "chunk"), [(resample.LONG, resample.CHUNK), (60, 20), (0, 1)])
def test_op13_brute_force(spark, long, chunk):
    rng = np.random.default_rng(chunk)
    words = ["the", "Of", "É", "日本", "x-y", "a_b", "7", "don't", "\x00", "z" * 40]
    data = [(k if k % 50 else None, " ".join(rng.choice(words, int(rng.integers(0, 120))))) for k in range(300)] + list(enumerate(TEXTS))
    target = [" ".join(rng.choice(words[:4], 30)) for _ in range(7)] + [None, ""]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumn("row", F.lit("x")).withColumn("n", F.lit(1)).withColumn("bucket", F.lit(2))
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = Counter(map(tuple, resample.resample(docs, goal, long=long, chunk=chunk).collect()))
    assert got == brute_draw(data, target)
    assert sum(v for k, v in got.items() if k[4]) >= 10


def test_op13_odd_rows(spark):
    goal = spark.createDataFrame([("a b c",)], "text string")
    assert resample.resample(empty(spark), goal).count() == 0
    twice = [(r.doc_id, r.text) for r in doubled(spark).collect()]
    assert Counter(map(tuple, resample.resample(doubled(spark), goal, long=100, chunk=30).collect())) == brute_draw(twice, ["a b c"])
    assert resample.resample(rows(spark), goal.where("false")).count() == len(TEXTS)


def test_op13_chunks_own_every_feature_once():
    rng = np.random.default_rng(1)
    for text in ["", " ", "a", *("".join(rng.choice(list("abC é1 -"), int(rng.integers(0, 300)))) for _ in range(100))]:
        n, want = brute_features(text)
        for size in (1, 7, 64):
            own, _, buckets = resample.features(list(resample.chunks(text.encode(), size)))
            assert own.sum() == n and Counter(buckets.tolist()) == want


def test_op13_crc_of_very_long_words():
    words = [b"x" * 3_000_000, b"y", b"z" * 70_000]
    own, _, buckets = resample.features([(b" ".join(words), b"")])
    want = [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(4 - k)]
    assert own.tolist() == [3] and buckets.tolist() == want
