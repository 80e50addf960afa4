"""Further queries: composite reports, sheets and files, orders and draws. They register beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vec
from ..operators import evaluation, manifest, neardup, reports, stats
from ..operators.ranking import numbered
from ..schema import N_STAGES, STAGE_NAMES, STAGES, TOPIC_LABELS_VI
from ..sources import files, views
from ..sources.scratch import new_path
from .catalog import _METRICS, ORACLE_SQL, _metrics, _models, _MODELS, query, r6

# ---------------------------------------------------------------- significance reports

#: two-sided tail of the normal distribution: a series of positive terms for the error function
_TAIL = """round(greatest(0, 1 - exp(-{x} * {x}) * list_sum([exp((2 * i + 1) * ln({x}) - lgamma(i + 1.5)) FOR i IN range(300)])), 6)""".format(x="greatest(least(abs(coalesce({z}, 0)) / sqrt(2), 8.0), 1e-12)")
_MCNEMAR = "round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)) FOR i IN range(least(b, c) + 1)])) END, 6)"


def _boot(by: str, replicates: int = 1000) -> str:
    """``boots`` by groups of ``diffs``: (by, id, s), as ``stats.bootstrap`` draws."""
    return f""",
drawn AS (SELECT {by}, r, s, ('0x' || substr(md5('42-' || r::VARCHAR || '-' || id::VARCHAR), 1, 8))::BIGINT AS u FROM diffs, range({replicates}) a(r)),
weighed AS (SELECT {by}, r, s, {" + ".join(f"(u >= {t})::INT" for t in stats.POISSON)} AS w FROM drawn),
boot AS (SELECT {by}, round(sum(w * s) / sum(w), 9) AS m FROM weighed GROUP BY {by}, r HAVING sum(w) > 0),
boots AS (SELECT * FROM (SELECT {by}, round(avg(s), 6) AS diff, round(avg(s), 9) AS gain FROM diffs GROUP BY {by}) JOIN (SELECT {by}, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high,
  round(least(1, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))), 6) AS p FROM boot GROUP BY {by}) USING ({by}))"""


def _ranked(by: str) -> str:
    """``tests``: z of the signed ranks of ``diffs`` by groups."""
    return f""",
counts AS (SELECT {by}, abs(s) AS a, count(*) AS n, sum((s > 0)::INT) AS up FROM diffs WHERE s <> 0 GROUP BY {by}, abs(s)),
places AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY a) - (n - 1) / 2 AS place FROM counts),
sums AS (SELECT {by}, sum(n) AS n, least(sum(place * up), sum(place * (n - up))) AS w, sum(n * n * n - n) AS ties FROM places GROUP BY {by}),
tests AS (SELECT {by}, (w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM sums)"""


_OTHER = "(truth + CASE WHEN vec_id % 3 = 0 THEN 1 + vec_id % 2 ELSE 0 END) % 6"


@query(f"""
, v AS (SELECT vec_id, predicted = truth AS a, {_OTHER} = truth AS b, abs(predicted - truth) AS da, abs({_OTHER} - truth) AS db FROM beliefs),
diffs AS (SELECT 'correct' AS metric, vec_id AS id, (a::INT - b::INT)::DOUBLE AS s FROM v UNION ALL SELECT 'distance', vec_id, (da - db)::DOUBLE FROM v)""" + _boot("metric") + _ranked("metric") + f""",
pair AS (SELECT sum((a AND NOT b)::INT)::BIGINT AS b, sum((b AND NOT a)::INT)::BIGINT AS c FROM v)
SELECT metric, diff, low, high, p AS boot_p, CASE WHEN metric = 'correct' THEN 'mcnemar' ELSE 'wilcoxon' END AS test,
  CASE WHEN metric = 'correct' THEN (SELECT {_MCNEMAR} FROM pair) ELSE {_TAIL.format(z='z')} END AS p_value FROM boots LEFT JOIN tests USING (metric)""", "beliefs")
def loss_variant_report(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over the same images."""
    b = views.beliefs(spark, d).select("vec_id", "truth", "predicted")
    off = F.when(F.col("vec_id") % 3 == 0, 1 + F.col("vec_id") % 2).otherwise(0)
    other = b.withColumn("predicted", ((F.col("truth") + off) % N_STAGES).cast("int"))
    out = reports.loss_variants(b, other, "vec_id")
    return out.select("metric", *(r6(c, c) for c in ("diff", "low", "high", "boot_p")), "test", r6("p_value", "p_value"))


_COLUMNS = {"precision_at_k": "p", "recall_at_k": "r", "ndcg_at_k": "g", "sirr_at_k": "s"}


@query(_METRICS + ", diffs AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, b.method AS baseline, a.scenario_id AS id, a.{x} - b.{x} AS s FROM met a JOIN met b ON a.scenario_id = b.scenario_id AND a.method = 'P' AND b.method IN ('B0', 'B2', 'B3')" for c, x in _COLUMNS.items()) + ")" + _boot("metric, baseline") + """
SELECT metric, baseline, diff, low, high, p, low > 0 OR high < 0 AS significant, CASE WHEN gain = 0 THEN 'neither' WHEN (gain > 0) = (metric <> 'sirr_at_k') THEN 'P' ELSE baseline END AS favors FROM boots""", "asked", "asked_x", "beliefs", "queries", "chunks")
def retrieval_significance(spark: SparkSession, d: str) -> DataFrame:
    """Belief-aware re-ranking against three baselines."""
    out = reports.retrieval_significance(_metrics(spark, d), "P", ["B0", "B2", "B3"], list(_COLUMNS))
    low, high = F.round("low", 6), F.round("high", 6)
    return out.select("metric", "baseline", r6("diff", "diff"), low.alias("low"), high.alias("high"), r6("p", "p"), ((low > 0) | (high < 0)).alias("significant"), "favors")


@query(_METRICS + ", u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, b.method AS baseline, a.scenario_id // 4 AS id, a.{x} - b.{x} AS d FROM met a JOIN met b ON a.scenario_id = b.scenario_id AND a.method = 'P' AND b.method IN ('B0', 'B1', 'B3')" for c, x in _COLUMNS.items()) + f"""),
cluster AS (SELECT metric, baseline, id, sum(d) AS s, count(*) AS k FROM u GROUP BY ALL),
drawn AS (SELECT *, ('0x' || substr(md5('42-' || r::VARCHAR || '-' || id::VARCHAR), 1, 8))::BIGINT AS u FROM cluster, range(1000) a(r)),
weighed AS (SELECT *, {" + ".join(f"(u >= {t})::INT" for t in stats.POISSON)} AS w FROM drawn),
boot AS (SELECT metric, baseline, round(sum(w * s) / sum(w * k), 9) AS m FROM weighed GROUP BY metric, baseline, r HAVING sum(w * k) > 0),
one AS (SELECT metric, baseline, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, least(1, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))) AS p FROM boot GROUP BY ALL),
whole AS (SELECT metric, baseline, count(*) AS images, sum(k)::BIGINT AS scenarios, round(sum(s) / sum(k), 6) AS diff FROM cluster GROUP BY ALL),
h AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, metric || ' ' || baseline) + 1) * p) AS up FROM one JOIN whole USING (metric, baseline))
SELECT metric, baseline, images, scenarios, diff, low, high, round(p, 6) AS p, round(max(up) OVER (ORDER BY p, metric || ' ' || baseline ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""", "asked", "asked_x", "beliefs", "queries", "chunks")
def retrieval_significance_clustered(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios are drawn by image (here four scenarios each), with the strongest baseline and Holm's adjustment."""
    image = F.floor(F.col("scenario_id") / 4)
    out = reports.clustered_significance(_metrics(spark, d), image, "P", ["B0", "B1", "B3"], list(_COLUMNS))
    return out.select("metric", "baseline", "images", "scenarios", *(r6(c, c) for c in ("diff", "low", "high", "p", "p_holm")))


@query(_MODELS + ", diffs AS (SELECT model, vec_id AS id, correct::DOUBLE AS s FROM m)" + _boot("model") + " SELECT model, diff AS accuracy, low, high FROM boots", "beliefs")
def model_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A share and its interval for each model."""
    return reports.model_accuracy(_models(spark, d), "vec_id").select("model", r6("diff", "accuracy"), r6("low", "low"), r6("high", "high"))


@query(_MODELS + """, diffs AS (SELECT a.model AS model_a, b.model AS model_b, a.vec_id AS id, a.correct AS ca, b.correct AS cb, (a.correct - b.correct)::DOUBLE AS s FROM m a JOIN m b ON a.vec_id = b.vec_id
  AND (a.model, b.model) IN (('cold', 'odd'), ('cold', 'major'), ('odd', 'major')))""" + _boot("model_a, model_b") + _ranked("model_a, model_b") + f""",
shares AS (SELECT model_a, model_b, round(avg(ca), 6) AS accuracy_a, round(avg(cb), 6) AS accuracy_b FROM diffs GROUP BY ALL),
one AS (SELECT *, {_TAIL.format(z='z')} AS p_value FROM boots JOIN shares USING (model_a, model_b) LEFT JOIN tests USING (model_a, model_b)),
h AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p_value, model_a || ' ' || model_b) + 1) * p_value) AS up FROM one)
SELECT model_a, model_b, accuracy_a, accuracy_b, diff, low, high, p_value, round(max(up) OVER (ORDER BY p_value, model_a || ' ' || model_b ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""", "beliefs")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of models, adjusted together."""
    out = reports.model_comparison(_models(spark, d), ["cold", "odd", "major"], "vec_id")
    return out.select("model_a", "model_b", *(r6(c, c) for c in ("accuracy_a", "accuracy_b", "diff", "low", "high", "p_value", "p_holm")))


# ---------------------------------------------------------------- pairs, draws and orders


@query("SELECT a, b, distance, x.split AS split_a, y.split AS split_b FROM pairs JOIN beliefs x ON x.vec_id = a JOIN beliefs y ON y.vec_id = b WHERE distance <= 18 AND x.split <> y.split", "pairs", "beliefs")
def leak_pair_listing(spark: SparkSession, d: str) -> DataFrame:
    """Every near pair over two splits."""
    near = neardup.hamming_pairs(views.hashes(spark, d), 18)
    return reports.leak_pairs(near, views.beliefs(spark, d).select("vec_id", "split")).withColumn("distance", F.col("distance").cast("int"))


@query("""
, c AS (SELECT vec_id, truth, (SELECT count(*) FROM beliefs) / ((SELECT count(DISTINCT truth) FROM beliefs) * count(*) OVER (PARTITION BY truth)) AS e, ('0x' || substr(md5('42-' || vec_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM beliefs)
SELECT vec_id, truth, floor(e + u)::BIGINT AS copies FROM c""", "beliefs")
def weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    """Draws with replacement in which stages count alike."""
    return reports.weighted_draw(views.beliefs(spark, d).select("vec_id", "truth"), "vec_id", "truth")


@query("SELECT vec_id, truth, row_number() OVER (ORDER BY truth, md5('42-' || vec_id::VARCHAR), vec_id) AS place FROM beliefs", "beliefs")
def stage_shuffled_order(spark: SparkSession, d: str) -> DataFrame:
    """By stage, at random within, without a window over all rows."""
    b = views.beliefs(spark, d).select("vec_id", "truth")
    return numbered(b, [F.col("truth"), neardup.group_rank(42, F.col("vec_id")), F.col("vec_id")])


@query("SELECT topic, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY topic ORDER BY chunk_id) <= 5", "chunks")
def sample_heads(spark: SparkSession, d: str) -> DataFrame:
    """The first five of each topic, as reports show them; a task hands on five of a topic."""
    w = W.partitionBy("topic").orderBy("chunk_id")
    return views.chunks(spark, d).select("topic", "chunk_id").withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


# ---------------------------------------------------------------- sheets, files and scenarios


@query("""
, f AS (SELECT doc_id, ['Heading-Flowering', 'heading / flowering', ' S02 ', 'stem boot', 'winter', 'RIPENING', 's07_uncertain', 'grain development'][doc_id % 8 + 1] AS said FROM documents)
SELECT doc_id, ['reproductive', NULL, 'tillering', 'stem_booting', NULL, 'ripening', NULL, 'grain_filling'][doc_id % 8 + 1] AS stage FROM f""".replace(", f AS", "WITH f AS", 1))
def scenario_stage_alias(spark: SparkSession, d: str) -> DataFrame:
    """Other spellings first, then the stages; repeated separators are not collapsed."""
    said = views.pick(("Heading-Flowering", "heading / flowering", " S02 ", "stem boot", "winter", "RIPENING", "s07_uncertain", "grain development"), F.col("doc_id") % 8)
    return views.table(spark, d, "documents").select("doc_id", X.stage_label(said).alias("stage"))


def _case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + " END"


@query(f"""
, q AS (SELECT query_id, topic, query_id % 2 = 0 AS vi, replace(topic, '_', ' ') AS plain, {_case('topic', TOPIC_LABELS_VI.items())} AS label,
  CASE WHEN query_id % 7 < 6 THEN [{", ".join(f"'{s}'" for s in STAGE_NAMES)}][query_id % 7 + 1] END AS stage FROM queries),
s AS (SELECT *, {_case('stage', ((n, x) for n, x, _ in STAGES))} AS shown, {_case('stage', ((n, b) for n, _, b in STAGES))} AS span FROM q)
SELECT query_id, CASE WHEN vi THEN 'Bằng chứng ' || label || ' phù hợp với lúa' || CASE WHEN stage IS NULL THEN '.' ELSE ' ở giai đoạn ' || shown || ', BBCH ' || span || '.' END
  ELSE 'Rice ' || plain || ' evidence' || CASE WHEN stage IS NULL THEN '.' ELSE ' applicable to ' || shown || ', BBCH ' || span || '.' END END AS query FROM s""", "queries")
def topic_query_templates(spark: SparkSession, d: str) -> DataFrame:
    """Both languages, with and without a stage."""
    i = F.col("query_id")
    stage = F.when(i % 7 < N_STAGES, views.pick(STAGE_NAMES, i % 7))
    return views.topic_queries(spark, d).select("query_id", X.topic_query(F.col("topic"), stage, F.when(i % 2 == 0, "vi").otherwise("en")).alias("query"))


_IMAGES = "SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS image, 'p' || (l_orderkey % 500)::VARCHAR AS parent, l_linenumber % 4 <> 0 AS has FROM lineitem"


@query(f"WITH p AS ({_IMAGES}) SELECT parent, count(*) AS n, min('a/rgb/' || image || '.v1.png') AS file FROM p WHERE has GROUP BY 1")
def pixel_files(spark: SparkSession, d: str) -> DataFrame:
    """Pixel counts met with the first colour image of their stem; masks and images in two places beside it."""
    p = views.pixels(spark, d).select(F.concat("image", F.lit(".v1")).alias("image"), "parent")
    return manifest.pixel_files(p, _rgb(p))[0].groupBy("parent").agg(F.count("*").alias("n"), F.min("file").alias("file"))


@query(f"WITH p AS ({_IMAGES}) SELECT sum(has::INT)::BIGINT AS matched, sum((NOT has)::INT)::BIGINT AS unmatched FROM p")
def pixel_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows have a file."""
    p = views.pixels(spark, d).select(F.concat("image", F.lit(".v1")).alias("image"), "parent")
    return manifest.pixel_files(p, _rgb(p))[1]


def _rgb(pixels: DataFrame) -> DataFrame:
    line = F.split(F.split("image", r"\.")[0], "-")[1].cast("int")
    where = F.when(line % 4 != 0, F.array(F.lit("b/rgb/"), F.lit("a/rgb/"), F.lit("a/masks/"))).otherwise(F.array(F.lit("a/masks/")))
    return pixels.select(F.explode(F.transform(where, lambda w: F.concat(w, F.col("image"), F.lit(".png")))).alias("path"))


@query(", r AS (SELECT vec_id AS scenario_id, 'C' || lpad((vec_id * 3)::VARCHAR, 6, '0') AS chunk_id FROM embeddings) SELECT scenario_id, chunk_id FROM r WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = r.chunk_id)", "chunks")
def relevant_outside_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Relevant ids that the corpus lacks."""
    r = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("scenario_id"), F.format_string("C%06d", F.col("vec_id") * 3).alias("chunk_id"))
    return r.join(views.chunks(spark, d).select("chunk_id"), "chunk_id", "left_anti").select("scenario_id", "chunk_id")


@query("SELECT k::INTEGER AS stage_id, sum((compat[k + 1] >= 0.8)::INT)::BIGINT AS evidence, count(DISTINCT CASE WHEN compat[k + 1] >= 0.8 THEN source_id END) AS sources FROM chunks, range(6) t(k) GROUP BY 1", "chunks")
def evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    """A34."""
    c = views.chunks(spark, d).select("source_id", F.posexplode("stage_compatibility").alias("stage_id", "v"))
    return c.groupBy("stage_id").agg(F.count_if(F.col("v") >= 0.8).alias("evidence"), F.count_distinct(F.when(F.col("v") >= 0.8, F.col("source_id"))).alias("sources"))


@query("SELECT conv_id, turn + coalesce(last, 0) AS epoch FROM conversations LEFT JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE turn % 2 = 0 GROUP BY 1) USING (conv_id) WHERE turn % 2 = 1")
def epoch_offset(spark: SparkSession, d: str) -> DataFrame:
    """Odd turns as a run that goes on after the even ones."""
    c = views.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("epoch"))
    return manifest.continued_epochs(c.where("epoch % 2 = 0"), c.where("epoch % 2 = 1"), "conv_id").select("conv_id", "epoch")


@query("SELECT vec_id, predicted FROM beliefs WHERE split = 'test' AND truth = 3", "beliefs")
def reproductive_subset(spark: SparkSession, d: str) -> DataFrame:
    """a split that must have rows, and of it those whose true stage is the reproductive one."""
    rows = manifest.split_rows(views.beliefs(spark, d), "test")
    return rows.where(F.col("truth") == STAGE_NAMES.index("reproductive")).select("vec_id", "predicted")


@query(r"SELECT chunk_id, topic, md5(trim(text)) AS text_md5, CASE WHEN authority_score = 0 THEN 0.5 ELSE authority_score END AS authority_score, review_status FROM chunks WHERE len(regexp_extract_all(text, '[^\s]+')) >= 20 AND review_status NOT IN ('excluded', 'sample_only_not_agronomic_ground_truth') AND topic IN ('pest_risk', 'disease_risk')", "chunks")
def corpus_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as JSON lines in the shared folder, read back, validated and filtered; an authority of 0 is none."""
    path = new_path(spark, "corpus")
    files.write_chunks(views.chunks(spark, d), path)
    back = files.read_chunks(spark, path, topics=["pest_risk", "disease_risk"], strict=False)
    return back.select("chunk_id", "topic", F.md5(F.encode(F.trim("text"), "UTF-8")).alias("text_md5"), "authority_score", "review_status")


@query("SELECT vec_id::VARCHAR AS scenario_id, truth, predicted, predicted AS said, round(confidence, 6) AS confidence FROM beliefs", "beliefs")
def scenario_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios written as CSV with header to the shared folder and read back with their beliefs."""
    path = new_path(spark, "scenarios")
    b = views.beliefs(spark, d)
    files.write_scenarios(b.select(F.col("vec_id").cast("string").alias("scenario_id"), views.pick(STAGE_NAMES, F.col("truth")).alias("ground_truth_stage"), views.pick(STAGE_NAMES, F.col("predicted")).alias("predicted_stage"), "confidence", F.col("belief").alias("stage_belief")), path)
    s = files.read_scenarios(spark, path)
    return s.select("scenario_id", "truth", F.col("predicted").cast("int").alias("predicted"), F.col("predicted_stage").alias("said"), r6("confidence", "confidence"))


ORACLE_SQL["wilcoxon_p"] = ORACLE_SQL["wilcoxon_stat"].replace(" AS z FROM s", " AS z FROM s) SELECT n, statistic, z, " + _TAIL.format(z="z") + " AS p_value FROM t").replace("SELECT n::BIGINT AS n", ", t AS (SELECT n::BIGINT AS n", 1)


# ---------------------------------------------------------------- logits and temperature

_FINE = ", ".join(f"g{k} AS (SELECT model, t, avg(ln(list_sum([exp((v - list_max(x)) / t) FOR v IN x])) + (list_max(x) - x[truth + 1]) / t) AS nll FROM fit JOIN ({grid}) USING (model) GROUP BY model, t), b{k} AS (SELECT model, arg_min(t, nll) AS t FROM g{k} GROUP BY model)"
    for k, grid in enumerate(["SELECT DISTINCT model, exp(ln(0.05) + i * ln(200) / 100) AS t FROM fit, range(101) r(i)", *(f"SELECT model, least(greatest(t * exp((i - 50) * ln(200) / 100 / {25 ** k}), 0.05), 10) AS t FROM b{k - 1}, range(101) r(i)" for k in (1, 2, 3))]))


@query(f"""
, two AS (SELECT vec_id, truth, split, unnest([{{'model': 'plain', 'x': logits}}, {{'model': 'sharp', 'x': [3 * v FOR v IN logits]}}], recursive := true) FROM logits),
fit AS MATERIALIZED (SELECT * FROM two WHERE split = 'validation'), {_FINE},
p AS (SELECT model, truth, b3.t, x, list_transform([1.0::DOUBLE, b3.t], lambda t: [exp((v - list_max(x)) / t) FOR v IN x]) AS e FROM two JOIN b3 USING (model) WHERE split = 'test'),
m AS (SELECT model, t, truth, list_transform(e, lambda w: [v / list_sum(w) FOR v IN w]) AS p FROM p)
SELECT model, round(any_value(t), 4) AS temperature, count(*) AS n, round(avg(-ln(p[1][truth + 1])), 6) AS nll_before, round(avg(-ln(p[2][truth + 1])), 5) AS nll_after, round(avg(list_max(p[1])), 6) AS confidence_before, round(avg(list_max(p[2])), 4) AS confidence_after
FROM m GROUP BY model""", "logits")
def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    """Logits written by model and split, the temperature fitted on the validation rows that are read back, and
    the test rows before and after it."""
    b = views.beliefs(spark, d)
    models = F.explode(F.array(F.struct(F.lit("plain").alias("model"), F.col("logits").alias("x")), F.struct(F.lit("sharp").alias("model"), F.transform("logits", lambda v: 3 * v).alias("x")))).alias("m")
    rows = b.select(F.col("vec_id").cast("string").alias("image_id"), F.col("truth").alias("label"), "split", models)
    path = new_path(spark, "logits")
    files.write_logits(rows.select("image_id", "label", "split", "m.model", F.col("m.x").alias("logits")), path)
    found = evaluation.fit_temperature(files.read_logits(spark, path).where("split = 'validation'"), "model", truth="label")
    test = files.read_logits(spark, path).where("split = 'test'").withColumn("t", F.create_map(*(F.lit(x) for pair in found.items() for x in pair))[F.col("model")])
    before, after = vec.softmax(F.col("logits")), vec.softmax(F.transform("logits", lambda v: v / F.col("t")))
    p = test.select("model", "t", F.col("label").alias("truth"), before.alias("before"), after.alias("after"))
    loss = lambda c: F.avg(evaluation.nll(F.col(c), F.col("truth")))
    return p.groupBy("model").agg(F.round(F.first("t"), 4).alias("temperature"), F.count("*").alias("n"), r6(loss("before"), "nll_before"), F.round(loss("after"), 5).alias("nll_after"), r6(F.avg(F.array_max("before")), "confidence_before"), F.round(F.avg(F.array_max("after")), 4).alias("confidence_after"))
