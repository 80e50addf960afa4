"""The trained models of operators 3 and 7 against plain versions of themselves, and operator 1's fingerprints."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import TEXTS, WORD, documents, rows
from veridica.llm import imatch, quality, suffixtree

# ------------------------------------------------------------ 3


def plain_probability(net, text):
    """Chunk by chunk and filter by filter."""
    n = max(2, -(-len(text) // 8)) * 8
    data = text + bytes(n - len(text))
    cells = []
    for c in range(0, n, 8):
        vectors = [v for b in data[c : c + 8] for v in net.vectors[b].tolist()]
        repeats = [sum(data[i] == (data[i - k] if i >= k else 0) for i in range(c, c + 8)) / 8 for k in range(2, 18)]
        cells.append(vectors + repeats)
    best = [0.0] * len(net.bias)
    for one, two in zip(cells, cells[1:], strict=False):
        for f in range(len(best)):
            best[f] = max(best[f], float(np.dot(one + two, net.filters[:, f])) + float(net.bias[f]))
    return 1 / (1 + math.exp(-(float(np.dot(best, net.out)) + float(net.base[0]))))


def test_op3_forward_pass():
    rng = np.random.default_rng(2)
    net = quality.train([(b"words of a good text", 1), (b"!!! *** !!! ***", 0)] * 6, epochs=2)
    for text in (b"", b"a", b"12345678", bytes(rng.integers(0, 256, 333, dtype=np.uint8)), "été 日本 été 日本 été".encode() * 5):
        assert quality.probability(net, text) == pytest.approx(plain_probability(net, text), abs=1e-5)


def test_op3_gradients_do_not_depend_on_pieces(monkeypatch):
    net = quality.train([(b"good text of words", 1), (b"!!! *** !!!", 0)] * 4, epochs=1)
    text = bytes(np.random.default_rng(0).integers(0, 256, 50_000, dtype=np.uint8))
    whole = quality._gradients(net, text, 1)
    monkeypatch.setattr(quality, "PIECE", 1024)
    pieces = quality._gradients(net, text, 1)
    assert whole[0] == pytest.approx(pieces[0]) and all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole[1], pieces[1], strict=True))


def test_op3_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, **how: seen.append(rows))
    docs = spark.createDataFrame([(i, "x" * (10_000 if i == 3 else 100)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    quality.fit(docs, labels)
    quality.fit(docs, labels, sample_bytes=6400)
    quality.fit(docs, labels, sample_bytes=64 * 10_000)
    assert [len(r) for r in seen] == [50, 49, 50]
    quality.fit(docs, labels, sample_bytes=64 * 99)
    assert seen[-1] == []


# ------------------------------------------------------------ 7


def plain_scores(texts, held, depth, share, divergence, prior):
    words = [[w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for t in texts]
    lines = [b"".join(w + b" " for w in ws) + b"\n" for ws in words]
    counts = defaultdict(Counter)
    for line, out in zip(lines, held, strict=True):
        padded = b"\n" * depth + line
        for k in range(depth, len(padded) if not out else 0):
            for d in range(depth + 1):
                counts[padded[k - d : k]][padded[k]] += 1
    symbols, kept = sum(counts[b""].values()), {b""}
    for ctx, c in counts.items():
        total, up = sum(c.values()), counts[ctx[1:]]
        gain = sum(n * math.log(n / total / (up[s] / sum(up.values()))) for s, n in c.items()) if ctx else 0
        if ctx and total >= share * symbols and gain >= divergence * len(c):
            kept.add(ctx)

    def p(ctx, sym):
        out = 1 / suffixtree._POSSIBLE.sum()
        for d in range(len(ctx) + 1):
            if (own := ctx[len(ctx) - d :]) in kept and counts[own]:
                weight = prior * len(counts[own])
                out = (counts[own][sym] + weight * out) / (sum(counts[own].values()) + weight)
        return out

    scores = []
    for line in lines:
        padded = b"\n" * depth + line
        scores.append(sum(math.log10(p(padded[k - depth : k], padded[k])) for k in range(depth, len(padded))))
    return scores, len(kept)


@pytest.mark.parametrize("frequent", [1e-9, 0.01, 1.0])
def test_op7_scores(spark, frequent):
    rng = np.random.default_rng(6)
    some = ["the cat", "a dog sat", "katze und Hund", "le chat est là"]
    texts = [" ".join(rng.choice(some, int(rng.integers(0, 6)))) + rng.choice(["", " zzyx", " Q"]) for _ in range(60)] + [None, "", "unheard wörds", "a" * 40]
    held = [i % 7 == 2 for i in range(len(texts))]
    how = {"depth": 3, "share": 0.002, "divergence": 1.0, "prior": 2.0}
    want, kept = plain_scores(texts, held, **how)
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, out boolean").repartition(3)
    got = {r.doc_id: r.score for r in suffixtree.score(df, F.col("out"), frequent=frequent, **how).collect()}
    assert kept > 20 and [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-3)


def test_op7_probabilities_of_words_add_up_to_one_at_most(spark):
    """All words of one or two letters, seen and unseen, after nothing: each is scored as a text of its own, less the end's share."""
    letters = [bytes([b]) for b in range(33, 127) if not 65 <= b <= 90]
    words = [a.decode() for a in letters] + [(a + b).decode() for a in letters for b in letters]
    learn = ["a b c ab"] * 30 + ["q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*learn, *words])], "doc_id long, text string")
    got = suffixtree.score(df, F.col("doc_id") >= len(learn), depth=1, share=0.0, divergence=0.0).where(f"doc_id >= {len(learn)}").agg(F.sum(F.pow(F.lit(10.0), F.col("score")))).first()[0]
    assert 0.1 < got <= 1 + 1e-4  # longer texts have the rest


# ------------------------------------------------------------ 1


def test_op1_likeness_and_fingerprints_of_any_pair(spark, sf):
    """A text is like itself and its copies, and by more to its edit than to other texts, however short the common part."""
    df = spark.createDataFrame([(i, t) for i, t, _ in documents(sf)], "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.with_edits(df).collect()}
    for r in got.values():
        assert imatch.likeness(r.fingerprint, r.fingerprint) == 1
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    odd = imatch.with_edits(rows(spark, TEXTS, extra=False)).collect()
    assert all(imatch.likeness(r.fingerprint, r.fingerprint) == 1 for r in odd)
