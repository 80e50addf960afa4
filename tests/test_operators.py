"""Hand-made cases: ties, empty and null inputs, closed forms, invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridica.functions import text as X
from veridica.functions import vec
from veridica.operators import corpus, evaluation, manifest, neardup, retrieval, segment, stats
from veridica.operators.graph import components
from veridica.schema import STAGE_NAMES, aliases


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_belief_edges(spark):
    uniform, hot = arr(*[1 / 6] * 6), arr(1, 0, 0, 0, 0, 0)
    assert one(spark, vec.entropy_concentration(uniform, 6)) == pytest.approx(0, abs=1e-9)
    assert one(spark, vec.entropy_concentration(hot, 6)) == pytest.approx(1, abs=1e-6)
    assert one(spark, vec.top_two_margin(hot)) == pytest.approx(1, abs=1e-6)
    assert one(spark, vec.top_two_margin(arr(0.5, 0.5, 0, 0, 0, 0))) == pytest.approx(0, abs=1e-9)
    assert one(spark, vec.jsd_agreement(hot, hot)) == pytest.approx(1)
    assert one(spark, vec.jsd_agreement(hot, arr(0, 1, 0, 0, 0, 0))) == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        vec.combined_confidence(hot, 6, entropy=0.0, margin=0.0)


def test_softmax_and_fusion(spark):
    a, b = one(spark, vec.softmax(arr(1, 2, 3))), one(spark, vec.softmax(arr(101, 102, 103)))
    assert a == pytest.approx(b) and sum(a) == pytest.approx(1)
    fused = one(spark, vec.log_linear_fusion(arr(*[1 / 3] * 3), [(arr(2, 1, 1), 1.0)]))
    assert fused == pytest.approx([0.5, 0.25, 0.25])
    assert all(sum(r) == pytest.approx(1) for r in vec.transition_matrix(6))
    prior = one(spark, vec.transition_prior(arr(0, 0, 0, 0, 0, 1), vec.transition_matrix(6)))
    assert prior == pytest.approx([0, 0, 0, 0, 0, 1])


def test_rrf_ties(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, bm25_rank int")
    den = spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "query_id int, chunk_id string, dense_rank int")
    rows = retrieval.ranked(retrieval.fuse(lex, den), "rrf", None, "rank", ties=retrieval.ties()).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["a", "b", "c"]
    assert rows[0].rrf == pytest.approx(2 / 61) and rows[1].rrf == rows[2].rrf


def test_minmax_constant_and_empty(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 5.0), (3, 0.0), (3, 4.0)], "query_id int, s double")
    got = {(r.query_id, r.s): r.base for r in retrieval.minmax(rows, "s").collect()}
    assert got == {(1, 2.0): 1.0, (2, 5.0): 1.0, (3, 0.0): 0.0, (3, 4.0): 1.0}
    assert retrieval.minmax(rows.where("false"), "s").count() == 0


def test_rerank_follows_the_belief(spark):
    hot = lambda k: [float(i == k) for i in range(6)]
    rows = spark.createDataFrame([("a", 0.5, hot(0), 0.5, False), ("b", 0.5, hot(1), 0.5, False), ("r", 1.0, hot(0), 1.0, True)], "chunk_id string, base double, stage_compatibility array<double>, authority_score double, restricted_action boolean")
    for k, best in ((0, "a"), (1, "b")):
        got = retrieval.rerank(rows, F.array(*map(F.lit, hot(k))), F.lit(1.0)).orderBy(F.desc("score")).collect()
        assert [r.chunk_id for r in got][0] == best and len(got) == 2
    with pytest.raises(ValueError):
        retrieval.rerank(rows, F.array(), F.lit(1.0), fixed=0.95)


def test_bm25_tiny(spark):
    docs = spark.createDataFrame([("1", "rice water rice", "t"), ("2", "water", "t"), ("3", "", "t")], "chunk_id string, text string, topic string")
    q = spark.createDataFrame([(1, "Rice rice absent", "t")], "query_id int, query string, topic string")
    got = {r.chunk_id: r for r in retrieval.bm25_top(docs, q, 10).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got["1"].bm25 == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3))), abs=1e-6)
    assert (got["2"].bm25, got["3"].bm25, got["2"].bm25_rank) == (0.0, 0.0, 2)


def test_ranking_metrics_short_and_ideal(spark):
    rel = spark.createDataFrame([("s", "a", 3.0, False), ("s", "b", 2.0, False), ("s", "c", 1.0, False), ("s", "z", 0.0, True)], "scenario_id string, chunk_id string, grade double, incompatible boolean")
    top = spark.createDataFrame([("s", "m", "a", 1), ("s", "m", "b", 2), ("s", "m", "c", 3), ("n", "m", "q", 1)], "scenario_id string, method string, chunk_id string, rank int")
    got = {r.scenario_id: r for r in evaluation.ranking_metrics(top, rel).collect()}
    assert got["s"].ndcg_at_k == pytest.approx(1) and got["s"].precision_at_k == pytest.approx(0.6) and got["s"].recall_at_k == 1
    assert (got["n"].ndcg_at_k, got["n"].recall_at_k, got["n"].sirr_at_k) == (0, 0, 0)


def test_ece_and_masd(spark):
    over = spark.createDataFrame([(0, 1, 0.95)] * 2, "truth int, predicted int, confidence double")
    assert evaluation.ece(over).first().ece == pytest.approx(0.95)
    zero = spark.createDataFrame([(0, 0, 0.0)], "truth int, predicted int, confidence double")
    assert evaluation.ece(zero).first().ece == 0.0
    m = spark.createDataFrame([(0, 1), (5, 0)], "truth int, predicted int")
    assert evaluation.classification(m).first().masd == 3.0
    curve = evaluation.abstention(over).where("threshold > 0.9")
    assert [r.accuracy for r in curve.collect()] == [0.0]
    assert evaluation.abstention(over.where("false")).first().coverage is None


def test_holm_and_mcnemar(spark):
    p = spark.createDataFrame([(1, 0.2), (2, 0.01), (3, 0.05)], "test int, p double")
    got = {r.test: r.p_holm for r in stats.holm(p).collect()}
    assert [got[k] for k in (1, 2, 3)] == pytest.approx([0.2, 0.03, 0.1])
    for b, c, want in ((2, 0, 0.5), (0, 0, 1.0), (5, 5, 1.0), (10, 1, 0.01171875)):
        assert one(spark, stats.mcnemar_p(F.lit(b), F.lit(c))) == pytest.approx(want)


def test_bootstrap_is_deterministic_and_empty(spark):
    d = spark.createDataFrame([(i, float(i % 3 - 1)) for i in range(30)], "i long, d double")
    assert stats.bootstrap(d, 50).collect() == stats.bootstrap(d.repartition(7), 50).collect()
    assert stats.bootstrap(d.where("false"), 5).first().p == 1.0
    assert stats.bootstrap_clustered(d.select(F.lit("c").alias("cluster"), "d"), 5).first().diff == pytest.approx(0)


def test_wilcoxon_by_group_against_brute_force(spark):
    rng = np.random.default_rng(4)
    data = [(g, float(x)) for g, n in (("a", 400), ("b", 7), ("c", 90), (None, 30)) for x in rng.integers(-20, 25, n) / 4] + [("z", 0.0)]
    got = {r.g: r for r in stats.wilcoxon(spark.createDataFrame(data, "g string, d double").repartition(5), by=["g"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        d = [x for k, x in data if k == g and x]
        rank = [sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d]
        assert (r.n, r.statistic) == (len(d), min(sum(k for k, x in zip(rank, d) if x > 0), sum(k for k, x in zip(rank, d) if x < 0)))
    assert stats.wilcoxon(spark.createDataFrame([], "d double")).first().n is None


def test_wilcoxon_ties(spark):
    d = spark.createDataFrame([(v,) for v in (1.0, -1.0, 2.0, 3.0, 0.0)], "d double")
    r = stats.wilcoxon(d).first()
    assert (r.n, r.statistic) == (4, 1.5)


def test_components_and_groups(spark):
    e = spark.createDataFrame([(3, 2), (2, 1), (7, 7), (9, 8), (8, 9)], "a long, b long")
    assert {(r.node, r.root) for r in components(e).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert components(e.where("false")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert components(path).select("root").distinct().collect()[0].root == 0
    m = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", None), ("b", "test"), ("c", "test")], "g string, split string")
    assert {r.g for r in neardup.leakage(m, "g").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        neardup.assert_no_leakage(m, ["g"])


def test_group_split_is_a_partition(spark):
    rows = spark.createDataFrame([(f"g{i}", f"i{i}{j}", "s") for i in range(20) for j in range(4)], "field_id string, image_id string, macro_stage string")
    s = neardup.group_split(rows, "field_id")
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"test": 4, "validation": 3, "train": 13} and s.count() == 20


def test_hamming_pairs_equal_brute_force(spark):
    import random

    random.seed(1)
    base = random.getrandbits(63)
    hs = [base] + [base ^ sum(1 << random.randrange(63) for _ in range(random.randrange(6))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(hs)), "vec_id long, h long")
    want = {(i, j) for i in range(len(hs)) for j in range(i + 1, len(hs)) if (hs[i] ^ hs[j]).bit_count() <= 4}
    got = [(r.a, r.b) for r in neardup.hamming_pairs(rows, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_canonical_chunks(spark):
    raw = spark.createDataFrame([("k", "t " * 30, "[1]", "0", "x"), (None, None, None, None, None)], "id string, content string, direct_applicable_stages string, authority_score string, year string")
    a, b = corpus.canonicalize(raw).collect()
    assert a.stage_compatibility == [0.55, 1.0, 0.55, 0.0, 0.0, 0.0] and a.authority_score == 0.5 and a.source_year is None and a.language == "vi"
    assert b.stage_compatibility == [0.35] * 6 and b.topic == "general_crop_care" and b.review_status == "unreviewed"
    good, bad = corpus.validated(corpus.canonicalize(raw))
    assert good.count() == 1 and bad.first().faults == ["chunk_id", "words"]
    with pytest.raises(Exception, match="chunk"):
        corpus.validated(corpus.canonicalize(raw), strict=True)[0].collect()


def test_labels_and_folders(spark):
    rows = spark.createDataFrame([("S03 / stem-booting",), ("  Heading & Flowering ",), ("s07",), ("nonsense",), (None,)], "l string")
    got = [(r.stage, r.is_training) for r in manifest.canonical_label(rows, "l").orderBy(F.monotonically_increasing_id()).collect()]
    assert ("stem_booting", True) in got and ("uncertain", False) in got and got.count((None, None)) >= 2
    f = spark.createDataFrame([("03_booting/x/a_subset_overlap_1.jpg",), ("02_ripening/b.jpg",), ("1/c.png",)], "path string")
    got = {r.image_id: (r.macro_stage, r.capture_session, r.parent_image_id) for r in manifest.from_files(f).collect()}
    assert got == {"a_subset_overlap_1": ("stem_booting", "x", "stem_booting:x:a"), "c": ("establishment", "unknown", "establishment:unknown:c")}
    with pytest.raises(Exception, match="no stage"):
        manifest.from_files(f, strict=True).collect()
    assert len({a for a, _, _ in aliases()}) == 31


def test_lists_and_words(spark):
    rows = spark.createDataFrame([('["a", " b ", ""]',), ("a| b||c",), ("a, b",), ("",), (None,)], "v string")
    assert [r.x for r in rows.select(X.listed(F.col("v")).alias("x")).collect()] == [["a", "b"], ["a", "b", "c"], ["a", "b"], [], []]
    assert one(spark, X.phrase_count(F.lit("Rat rats rat-trap brat"), "rat")) == 2
    assert one(spark, X.normalized(F.lit("a­b  fer-\n tilizer\tx "))) == "ab fertilizer x"


def test_html_and_units(spark):
    page = "<h1>Top</h1><nav><p>skip<img></p></nav><p>one<br>two<p>three <li>item <p>inner</p> tail</li><script>x</script><div class='menu'>m</div>end"
    assert segment.html_to_lines(page) == ["## Top", "one two", "three", "item", "inner", "tail"]
    assert segment.html_to_lines(None) == []
    words = " ".join(f"w{i}" for i in range(27))
    rows = spark.createDataFrame([(1, ["## A", words, "## B", words + " w", words + " end."]), (2, []), (3, None)], "id int, lines array<string>")
    got = segment.units(rows).collect()
    assert [(r.id, r.section) for r in got] == [(1, "B")] and got[0].unit_text.endswith("end.")


def test_classes_and_vectors(spark):
    lex = {"first": ("rice",), "second": ("water",)}
    c = lambda s, t: one(spark, segment.classify(F.lit(s), F.lit(t), lex, "none"))
    assert (c("", "rice water"), c("water", "rice water"), c("", "x")) == ("first", "second", "none")
    v = one(spark, segment.stage_vector(F.lit(""), F.lit("heading then ripening heading"), F.lit("x"), [(), (), (), ("heading",), (), ("ripening",)]))
    assert v == [0.0, 0.0, 0.55, 1.0, 0.55, 0.85]
    assert len(STAGE_NAMES) == 6


def test_aligned_runs_must_agree_on_labels(spark):
    from veridica.operators.reports import aligned

    a = spark.createDataFrame([("x", 1, 1), ("y", 2, 1)], "image_id string, truth int, predicted int")
    assert {tuple(r) for r in aligned(a, a.where("image_id = 'x'")).collect()} == {("x", 1, 1, 1)}
    with pytest.raises(Exception, match="labels differ: y"):
        aligned(a, a.withColumn("truth", F.lit(1))).collect()


def test_required_split_and_fallback(spark):
    rows = spark.createDataFrame([("train", 1)], "split string, v int")
    assert manifest.split_rows(rows, "train").count() == 1
    assert manifest.split_rows(rows, "test", required=False).count() == 0
    with pytest.raises(ValueError, match="test"):
        manifest.split_rows(rows, "test")
    files = spark.createDataFrame([("01_establishment/a/x.jpg",), ("other/y.jpg",)], "path string")
    sheet = spark.createDataFrame([("a.jpg", "winter"), ("b.jpg", "tillering")], "image_path string, macro_stage string")
    kept, gone, mode = manifest.with_fallback(sheet, files)
    assert (kept.count(), gone.count(), mode) == (1, 1, "sheet")
    for none in (None, sheet.where("macro_stage = 'winter'")):
        kept, gone, mode = manifest.with_fallback(none, files)
        assert ([r.macro_stage for r in kept.collect()], [r.path for r in gone.collect()], mode) == (["establishment"], ["other/y.jpg"], "folder")


def test_numbered_without_rows_and_with_many_tasks(spark):
    from veridica.operators.ranking import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.place == r.k + 1 for r in numbered(rows, [F.col("k")]).collect())
    assert numbered(rows.where("k < 0"), [F.col("k")]).count() == 0
    with pytest.raises(ValueError, match="k"):
        numbered(rows, [F.col("k")], "k")


def test_grouped_bootstrap_equals_each_group_alone(spark):
    rows = spark.range(60).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") * 37 % 11) / 10.0 - 0.4).alias("d"))
    both = {r.g: tuple(r)[1:] for r in stats.bootstrap(rows, 100, key="id", by=["g"]).collect()}
    for g in range(3):
        assert both[g] == pytest.approx(tuple(stats.bootstrap(rows.where(F.col("g") == g), 100, key="id").first()))
