"""Operators that keep hot keys apart, against plain versions of themselves: index, fold, Hamming joins, tiles, numbering."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridica.operators import index, neardup, reports, retrieval, segment, stats, temporal
from veridica.operators.graph import components

# ---------------------------------------------------------------- index


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(f"C{k:04d}", rng.choice(["a", "b", "general_crop_care", None]), " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for k in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, topic string, text string").repartition(3)


def asked(spark):
    rows = [(1, "w0 w1 w1 w40", "a"), (2, "w50 w0", "b"), (3, "w3 nothing", "unheard"), (4, "nothing at all", "a"), (5, "", "b"), (6, "w59 w58 w57 w2", "general_crop_care")]
    return spark.createDataFrame(rows, "query_id long, query string, topic string")


@pytest.mark.parametrize("depth", [3, 20, 1000])
def test_index_gives_what_a_full_scan_gives(spark, tmp_path, depth):
    c, q = corpus(spark), asked(spark)
    path = index.build(c, str(tmp_path / "index"), buckets=8, block=16)
    got = index.top(spark, path, q, depth)
    want = retrieval.bm25_top(c, q, depth)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize(("depth", "variant"), [(3, "plus_one"), (20, "floored"), (1000, "plus_one")])
def test_tiles_of_documents_and_queries_give_what_a_full_scan_gives(spark, tmp_path, depth, variant):
    c, q = corpus(spark), asked(spark)
    got = retrieval.bm25_tiles(c, q, depth, variant=variant, documents=30, asked=2)
    want = retrieval.bm25_top(c, q, depth) if variant == "plus_one" else index.top(spark, index.build(c, str(tmp_path / "index")), q, depth, variant=variant)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    no_topics = c.withColumn("topic", F.lit("other"))
    assert Counter(map(tuple, retrieval.bm25_tiles(no_topics, q, 5, documents=30).collect())) == Counter(map(tuple, retrieval.bm25_top(no_topics, q, 5).collect()))


def test_scores_of_queries_and_documents_are_exchanged_as_the_best_of_a_block(spark):
    """The sum over a query's terms is no aggregate: with many queries its rows would be documents times queries."""
    plan = retrieval.bm25_tiles(corpus(spark), asked(spark), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(" not in plan


def test_index_without_topics_falls_back_to_all(spark, tmp_path):
    c = corpus(spark).withColumn("topic", F.lit("other"))
    path = index.build(c, str(tmp_path / "index"), buckets=4)
    assert Counter(map(tuple, index.top(spark, path, asked(spark), 5).collect())) == Counter(map(tuple, retrieval.bm25_top(c, asked(spark), 5).collect()))
    none = c.where("false")
    path = index.build(none, str(tmp_path / "empty"))
    assert index.top(spark, path, asked(spark), 5).count() == 0


def test_index_reads_few_levels_and_pruned_buckets(spark, tmp_path):
    path = index.build(corpus(spark, 3000), str(tmp_path / "index"), buckets=16, block=16)
    q = spark.createDataFrame([(1, "w0", "a"), (2, "w0 w1", "a")], "query_id long, query string, topic string")
    levels, buckets, _ = index.needed(spark, path, q, 5)
    n = {(r.query_id, r.kept): r.n for r in levels.groupBy("query_id", "kept").agg(F.sum("n").alias("n")).collect()}
    assert n[1, True] < n[1, False] and n[2, False] > 0 and len(buckets) <= 2  # low levels of common words are not read
    plan = index.top(spark, path, q, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]
    most = spark.read.parquet(f"{path}/blocks").agg(F.max(F.size("posts"))).first()[0]
    assert most <= 16


# ---------------------------------------------------------------- temporal


def brute_fold(beliefs, step):
    last, out = None, []
    for b in beliefs:
        last = step(last, b)
        out.append(last)
    return out


@pytest.mark.parametrize("sharp", [False, True])
def test_one_long_series_over_many_tasks(spark, sharp):
    rng = np.random.default_rng(4)
    n = 1500
    x = rng.dirichlet(np.full(6, 0.02 if sharp else 1.0), n)
    data = [(7, k, x[k].tolist()) for k in range(n)] + [(s, k, x[k].tolist()) for s in (1, 9) for k in range(3)] + [(None, 0, x[0].tolist()), (7, -1, None)]
    df = spark.createDataFrame(data, "s long, at long, belief array<double>").repartition(5)
    tasks = temporal.tracks(df, "s", ["at"])
    got = {}
    for r in tasks.orderBy("s", "pos").collect():
        got.setdefault(r.s, []).append((r.pos, r.at, r.fused))
    assert {k: len(v) for k, v in got.items()} == {None: 1, 1: 3, 7: n, 9: 3}
    step = temporal.Fold(temporal.vec.transition_matrix(6))
    for s, rows in got.items():
        assert [p for p, _, _ in rows] == list(range(len(rows)))
        want = brute_fold([x[k].tolist() for _, k, _ in rows], step)
        assert np.abs(np.array([f for _, _, f in rows]) - np.array(want)).max() < 1e-12
    assert temporal.tracks(df.where("false"), "s", ["at"]).count() == 0


def test_parts_that_remember_take_more_rounds(spark):
    """Evidence without weight: every row carries the first state on, so each part depends on all before it."""
    data = [(1, k, [0.9, 0.02, 0.02, 0.02, 0.02, 0.02] if k == 0 else [1 / 6] * 6) for k in range(300)]
    df = spark.createDataFrame(data, "s long, at long, belief array<double>").repartition(3)
    stay = [[0.999 if i == j else 0.0002 for j in range(6)] for i in range(6)]
    got = [r.fused for r in temporal.tracks(df, "s", ["at"], matrix=stay).orderBy("pos").collect()]
    want = brute_fold([b for _, _, b in data], temporal.Fold(stay))
    assert np.abs(np.array(got) - np.array(want)).max() < 1e-12


def test_fold_in_columns_is_the_same(spark):
    rng = np.random.default_rng(0)
    x = rng.dirichlet(np.ones(6), 12).tolist()
    row = spark.createDataFrame([(x,)], "b array<array<double>>").select(temporal.fold(F.col("b")).alias("f")).first()
    assert np.abs(np.array(row.f) - np.array(brute_fold(x, temporal.Fold(temporal.vec.transition_matrix(6))))).max() < 1e-12


# ---------------------------------------------------------------- near duplicates


def hashes(n, seed, near=True):
    rng = np.random.default_rng(seed)
    out = [int(h) for h in rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, n, dtype=np.uint64)]
    if near:
        for k in range(0, n, 3):
            out[k] = out[k // 2] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 22), replace=False))
    return [h - (1 << 64) if h >> 63 else h for h in out]


def brute_pairs(rows, most):
    return {(a, b, d) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] for d in [((x ^ y) & (2**64 - 1)).bit_count()] if d <= most}


@pytest.mark.parametrize(("most", "count"), [(0, None), (3, None), (4, 10**6), (10, None), (10, 10**9), (14, 10**6), (20, None), (20, 10**5)])
def test_hamming_pairs(spark, most, count):
    rows = list(enumerate(hashes(240, most)))
    df = spark.createDataFrame([*rows, (999, None)], "vec_id long, h long").repartition(3)
    got = [tuple(r) for r in neardup.hamming_pairs(df, most, count=count).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, most)


def test_segments_leave_no_pair_out_and_keep_candidates_few():
    for most in range(0, 21):
        for rows in (10**3, 10**6, 10**9):
            cut = neardup.segments(most, rows)
            assert sum(s.width for s in cut) == 64 and sum(s.radius + 1 for s in cut) >= most + 1
    # meetings and entries of random hashes for each row, of a million rows: a band of most + 1 would meet a part of all
    for most, limit in ((4, 1_500), (10, 12_000), (14, 120_000)):
        cut, rows = neardup.segments(most, 10**6), 10**6
        balls = [[sum(math.comb(s.width, r) for r in range(x + 1)) for x in (s.near, s.far)] for s in cut]
        assert sum(a + b + rows * a * b / 2**s.width for s, (a, b) in zip(cut, balls, strict=True)) < limit


def brute_components(pairs, most):
    root = {}
    for a, b, d in pairs:
        if d <= most:
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = root[a], root[b]
            for k, v in root.items():
                if v == max(x, y):
                    root[k] = min(x, y)
    return root


def test_one_forest_serves_all_thresholds(spark):
    pairs = brute_pairs(list(enumerate(hashes(150, 5))), 20)
    df = spark.createDataFrame(sorted(pairs), "a long, b long, distance int")
    for t, rows in neardup.hierarchy(df, (4, 8, 14, 20)).items():
        want = brute_components(pairs, t)
        assert {r.node: r.root for r in rows.collect()} == {n: want.get(n, n) for p in pairs for n in p[:2]}


def test_links_connect_what_pairs_connect_and_copies_are_stars(spark):
    h = hashes(120, 8)
    rows = list(enumerate(h)) + [(1000 + k, h[0]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, h long")
    links = neardup.hamming_links(df, 10)
    assert links.where("b >= 1000").count() == 60
    assert {r.node: r.root for r in components(links).collect()} == brute_components(brute_pairs(rows, 10), 10)


def test_entries_of_hashes_are_not_broadcast(spark, tmp_path):
    """Their table is small, but each row of it is filed under hundreds of values."""
    spark.createDataFrame(list(enumerate(hashes(200, 2))), "vec_id long, h long").write.parquet(str(tmp_path / "h"))
    rows = spark.read.parquet(str(tmp_path / "h"))
    assert "Broadcast" not in neardup.hamming_pairs(rows, 4, count=10**9)._jdf.queryExecution().executedPlan().toString()
    neardup.hamming_links(rows, 18).write.mode("overwrite").parquet(str(tmp_path / "links"))  # all pairs cost less here, and are compared in tiles
    assert "FlatMapGroupsInArrow" in neardup.hamming_pairs(rows, 18)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [10, 1 << 20])
def test_tiles_find_all_pairs_and_their_forest_the_same_clusters(spark, held, monkeypatch):
    monkeypatch.setattr(neardup, "SLICE", 7)
    monkeypatch.setattr(neardup, "HELD", held)
    rows = list(enumerate(hashes(300, 7)))
    split = [(k, h, "ab"[k % 2], 1 + k % 3) for k, h in rows]
    units = spark.createDataFrame(split, "id long, h long, split string, n long")
    pairs = brute_pairs(rows, 20)
    got = [tuple(r) for r in neardup._tiled_pairs(units.select("id", "h"), 20, len(rows), tile=40).collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    found = neardup.tiled_forest(units, 20, (4, 12, 20), "split", tile=40).collect()
    edges = {tuple(r)[:3] for r in found if r.n is None}
    assert {(min(a, b), max(a, b), d) for a, b, d in edges} <= pairs
    for t in (4, 12, 20):
        assert brute_components(edges, t) == brute_components(pairs, t)
    sums, want = Counter(), Counter()
    for r in found:
        if r.n is not None:
            sums[(r.distance, *sorted((r.sa, r.sb)))] += r.n
    for a, b, d in pairs:
        want[(d, *sorted(("ab"[a % 2], "ab"[b % 2])))] += (1 + a % 3) * (1 + b % 3)
    assert sums == want


def test_audit_counts_copies_without_making_their_pairs(spark):
    rng = random.Random(3)
    h = hashes(90, 6)
    rows = list(enumerate(h)) + [(500 + k, h[k % 4]) for k in range(20)]
    split = {k: rng.choice(["train", "train", "validation", "test"]) for k, _ in rows}
    pairs = brute_pairs(rows, 20)
    df = spark.createDataFrame([*rows, (999, None)], "vec_id long, h long")
    got = {r.threshold: tuple(r)[1:] for r in neardup.audit(df, spark.createDataFrame([*split.items(), (999, "test")], "vec_id long, split string"), (4, 10, 20)).collect()}
    for t in (4, 10, 20):
        near, root = [p for p in pairs if p[2] <= t], brute_components(pairs, t)
        size = Counter(root.values())
        cross = [p for p in near if split[p[0]] != split[p[1]]]
        straddling = sum(len({split[k] for k, v in root.items() if v == r}) > 1 for r in size)
        assert got[t] == (len(near), len(size), max(size.values(), default=0), straddling, len(cross), len(cross))


# ---------------------------------------------------------------- dense


@pytest.mark.parametrize(("tile", "some"), [(7, 2), (1 << 14, 256)])
def test_dense_tiles(spark, tile, some):
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    topics = [("a", "b", None)[k % 3] for k in range(60)]
    rows = [(f"C{k:02d}", topics[k], v[k].tolist()) for k in range(60)] + [("X", "a", None), ("Y", "a", [1.0, None, 0.0, 0.0]), ("Z", "a", [float("nan"), 0.0, 0.0, 0.0])]
    q = [(k, v[k].tolist(), [["a"], ["a", "b"], None][k % 3]) for k in range(5)] + [(9, [0.0] * 4, ["a"])]
    vectors = spark.createDataFrame(rows, "chunk_id string, topic string, vector array<double>")
    queries = spark.createDataFrame(q, "query_id long, query_vector array<double>, allowed array<string>")
    unit = lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) else x
    want = set()
    for i, x, may in q:
        scores = sorted((-round(float(unit(np.array(x)) @ unit(v[k])), 6) + 0.0, f"C{k:02d}") for k in range(60) if may is None or topics[k] in may)
        want |= {(i, key, -s + 0.0, n + 1) for n, (s, key) in enumerate(scores[:6])}
    got = retrieval.dense_top(vectors, queries, 6, tile=tile, asked=some)
    assert {(r.query_id, r.chunk_id, r.cosine, r.dense_rank) for r in got.collect()} == want
    free = retrieval.dense_top(vectors, queries.drop("allowed"), 3, tile=tile, asked=some).collect()
    assert len(free) == 18
    assert retrieval.dense_top(vectors.where("false"), queries, 3).count() == 0


# ---------------------------------------------------------------- numbering, significance


def test_texts_alike_in_their_first_letters_both_stay(spark):
    long = "a" * 3000
    rows = [("s", 3, "t", long + "b"), ("s", 1, "t", long + "c"), ("s", 2, "t", (long + "C!").upper()), (None, 1, "t", "x"), ("r", 5, "t", "x"), ("s", 9, "u", long + "b")]
    got = segment.dedup_number(spark.createDataFrame(rows, "source_id string, position long, topic string, text string"))
    assert {(r.source_id, r.position, r.chunk_id) for r in got.collect()} == {("s", 1, "s_C0001"), ("s", 3, "s_C0002"), ("s", 9, "s_C0003"), ("r", 5, "r_C0001"), (None, 1, None)}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString() or "source_id" not in got._jdf.queryExecution().toString().split("windowspecdefinition", 1)[-1][:80]


def test_a_hot_source_is_numbered_without_gaps(spark):
    df = spark.range(12_000).select(F.lit("s").alias("source_id"), F.col("id").alias("position"), F.lit("t").alias("topic"), F.concat(F.lit("text "), (F.col("id") % 11_000).cast("string")).alias("text"))
    got = sorted(int(r.chunk_id[3:]) for r in segment.dedup_number(df).select("chunk_id").collect())
    assert got == list(range(1, 11_001))


def test_clustered_report_draws_clusters_and_adjusts(spark):
    rng = random.Random(1)
    rows = [(s, m, rng.random() + (m == "P") * 0.2) for s in range(40) for m in ("P", "B0", "B1")]
    df = spark.createDataFrame(rows, "scenario_id long, method string, ndcg_at_k double")
    got = {r.baseline: r for r in reports.clustered_significance(df, F.floor(F.col("scenario_id") / 4), "P", ["B0", "B1"], ["ndcg_at_k"], 200).collect()}
    value = {(s, m): v for s, m, v in rows}
    for b, r in got.items():
        assert (r.images, r.scenarios) == (10, 40)
        assert r.diff == pytest.approx(np.mean([value[s, "P"] - value[s, b] for s in range(40)]))
        assert r.low < r.diff < r.high and r.p <= r.p_holm <= min(1, 2 * r.p) + 1e-12


# ---------------------------------------------------------------- draws


def test_draws_in_arrays_are_those_of_the_expression_and_make_no_row_a_replicate(spark, monkeypatch):
    monkeypatch.setattr(stats, "DRAWN", 7)
    rows = [(m, i if i else None, i * 0.5, 1 + i % 3) for i in range(40) for m in ("x", "y")[: 1 + i % 2]]
    units = spark.createDataFrame(rows, "m string, id long, s double, k long").repartition(3)
    exploded = units.select("*", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("r")).withColumn("w", stats.weight(42, F.col("r"), F.col("id")))
    for by in ([], ["m"]):
        want = exploded.groupBy(*by, "r").agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum(F.col("w") * F.col("k")).alias("k"))
        drawn = stats.drawn_sums(units, 30, 42, by)
        got = drawn.groupBy(*by, "r").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "explode" not in drawn._jdf.queryExecution().optimizedPlan().toString()


def test_components_end_where_the_links_are_stars(spark, monkeypatch):
    """Stars take no round; two that meet take as many tables as rounds, and one for the links. Hot nodes change nothing."""
    from veridica.operators import graph

    made, put = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, what: made.append(what) or put(df, what))
    stars = [(10 * k, 10 * k + i) for k in range(5) for i in range(1, 8)]
    df = spark.createDataFrame(stars + stars[:9], "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == brute_components([(a, b, 0) for a, b in stars], 0)
    assert made == ["links"]
    rng = random.Random(4)
    links = [(900, i) for i in range(400)] + [(400 + rng.randrange(300), 400 + rng.randrange(300)) for _ in range(200)] + [(950, 399), (950, 960)]
    want = brute_components([(a, b, 0) for a, b in links if a != b], 0)
    for few in (3, 256):
        monkeypatch.setattr(graph, "FEW", few)
        got = components(spark.createDataFrame(links * 2, "a long, b long")).collect()
        assert len(got) == len(want) and {r.node: r.root for r in got} == want
