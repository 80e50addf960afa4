"""Files: corpora, tables, scenarios, images, pages, registries, reports; and the sinks.

Paths are anything that Spark's readers open. Readers take explicit schemas; nothing is inferred from data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import corpus
from ..schema import CHUNK

#: Every spelling that ``corpus.canonicalize`` knows, read as text whatever the JSON type.
RAW_FIELDS = (
    "chunk_id", "id", "text", "content", "chunk_text", "topic", "care_topic", "stage_compatibility", "compatibility_vector", "direct_applicable_stages", "stage_ids",
    "applicable_stages", "c_establishment", "c_tillering", "c_stem_booting", "c_reproductive", "c_grain_filling", "c_ripening", "authority_score", "facet", "source_id",
    "review_status", "production_eligible", "restricted_action", "evidence_type", "section", "page", "page_start", "page_end", "source_title", "source_organization", "source_year",
    "year", "source_url", "source_type", "region", "region_dependency", "varieties", "variety_dependency", "use_mode", "language",
)
RAW = T.StructType([T.StructField(n, T.StringType()) for n in RAW_FIELDS])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): physical line numbers from 1, blank lines counted. Places within a split come from Spark's row
    ids of one scan; a file's splits are put in order by their starts."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = read.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = sizes.select("file", "start", (before - F.col("low") + 1).alias("shift"))
    return read.join(F.broadcast(at), ["file", "start"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def read_chunks(spark: SparkSession, path: str, mode: str = "research", include_sample: bool = False, topics: list[str] | None = None, regions: list[str] | None = None, varieties: list[str] | None = None, min_words: int = 20, strict: bool = True) -> DataFrame:
    """JSON lines to validated canonical chunks that the policy lets through.

    A record without an id is named after its line, "chunk_00001". With ``strict`` a bad record or a repeated id fails the
    job, before any filter; without it bad records are left out.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    raw = lines.select("line", F.from_json("value", RAW).alias("r")).select("line", "r.*")
    named = raw.withColumn("chunk_id", F.coalesce(F.nullif(F.trim("chunk_id"), F.lit("")), F.nullif(F.trim("id"), F.lit("")), F.format_string("chunk_%05d", "line")))
    good, _ = corpus.validated(corpus.canonicalize(named), min_words, strict)
    if strict:
        again = good.groupBy("chunk_id").count().where("count > 1").limit(3).collect()
        if again:
            raise ValueError(f"repeated chunk ids: {[r[0] for r in again]}")
    return good.where(corpus.mode_filter(mode, include_sample) & corpus.array_filters(topics, regions, varieties))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, in the canonical order of columns; nulls are left out by Spark's writer."""
    have = [f.name for f in CHUNK if f.name in chunks.columns]
    chunks.select(*have).write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A CSV file with header, all columns text, or an Excel sheet where openpyxl is installed (small files, read by the driver)."""
    if path.lower().endswith((".xlsx", ".xlsm", ".xls")):
        frame = pd.read_excel(path, sheet_name=sheet or 0, dtype=str)  # raises ImportError without openpyxl
        return spark.createDataFrame(frame.where(frame.notna(), None), T.StructType([T.StructField(str(c), T.StringType()) for c in frame.columns]))
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def first_readable(spark: SparkSession, paths: list[str], read: Callable[[SparkSession, str], DataFrame] = read_table) -> tuple[str, DataFrame]:
    """The first path that exists."""
    for p in paths:
        try:
            return p, read(spark, p)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(", ".join(paths))


def required(df: DataFrame, *columns: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def ids_of(value: Column) -> Column:
    """A JSON list, or ids separated by "|" or ",": distinct, without blanks."""
    return F.array_distinct(X.listed(F.when(value.startswith("["), value).otherwise(F.replace(value, F.lit(","), F.lit("|")))))


def belief_of(value: Column, fallback: Column, n: int) -> Column:
    """A JSON array or comma list of ``n`` numbers scaled to sum 1; absent: one-hot at ``fallback``; a wrong size or sum fails."""
    from ..functions import vec

    x = F.transform(F.split(F.regexp_replace(value, r"[\[\]\s]", ""), ","), lambda v: v.try_cast("double"))
    fine = (F.size(x) == n) & F.forall(x, lambda v: v.isNotNull()) & (vec.total(x) > 0)
    scaled = F.when(fine, F.transform(x, lambda v: v / vec.total(x))).otherwise(F.raise_error(F.concat(F.lit("bad belief: "), value)).cast("array<double>"))
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", vec.one_hot(fallback, n)).otherwise(scaled)


def grades_of(grades: Column, ids: Column) -> Column:
    """A JSON map of grades, or 1.0 for each id."""
    m = F.from_json(grades, "map<string,double>")
    listed = ids_of(ids)
    return F.when(F.size(m) > 0, m).otherwise(F.map_from_arrays(listed, F.transform(listed, lambda _: F.lit(1.0))))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios from CSV or JSON lines: scenario_id (or "scenario_0001" by line), topic, stages, confidence, belief, grades, incompatible ids."""
    from ..functions import vec
    from ..schema import N_STAGES, STAGE_NAMES

    names = ("scenario_id", "image_path", "topic", "query", "ground_truth_stage", "predicted_stage", "confidence", "stage_belief", "calibrated_stage_belief", "relevant_chunk_ids", "relevance_grades", "incompatible_chunk_ids", "nonmatching_chunk_ids")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).json(path) if ".json" in path else read_table(spark, path)
    raw = raw.select(*(F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names))
    stage = lambda c: F.array_position(F.array(*map(F.lit, STAGE_NAMES)), X.stage_label(F.col(c))) - 1
    belief = belief_of(F.coalesce(F.nullif("calibrated_stage_belief", F.lit("")), "stage_belief"), F.coalesce(F.nullif(stage("predicted_stage"), F.lit(-1)), stage("ground_truth_stage")), N_STAGES)
    out = raw.select("scenario_id", "topic", "query", stage("ground_truth_stage").cast("int").alias("truth"), stage("predicted_stage").cast("int").alias("predicted_stage"), F.col("confidence").try_cast("double").alias("said"), belief.alias("belief"), grades_of(F.col("relevance_grades"), F.col("relevant_chunk_ids")).alias("grades"), ids_of(F.coalesce(F.nullif("incompatible_chunk_ids", F.lit("")), "nonmatching_chunk_ids")).alias("incompatible"))
    return out.select("scenario_id", "topic", "query", "truth", "predicted_stage", F.coalesce("said", F.array_max("belief")).alias("confidence"), "belief", vec.argmax(F.col("belief")).alias("predicted"), "grades", "incompatible")


def write_scenarios(rows: DataFrame, path: str) -> None:
    """CSV with header; arrays as JSON."""
    text = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in rows.schema]
    rows.select(*text).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def scan_images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path relative to the root, [sha256 of the content]) of image files under ``root``; without ``content`` no byte is read."""
    from ..operators.manifest import IMAGE_GLOB

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(root)
    base = "/" + root.rstrip("/").split("://")[-1].split(":")[-1].strip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    return files.select(path.alias("path"), *([F.sha2("content", 256).alias("sha256")] if content else []))


def image_groups(files: DataFrame) -> DataFrame:
    """(folder, parent, paths in order)."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder"), X.parent_stem(F.col("path")).alias("parent")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def score_images(files: DataFrame, model: Callable[[bytes], list[float]]) -> DataFrame:
    """(path, logits): ``model`` runs over the content column in Arrow batches; it is sent out once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "logits": [list(map(float, model(c))) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, logits array<double>")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html), one row a file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, sha256, page from 1, text) of binaryFile rows; ``extract`` turns a document into the texts of its pages (no PDF
    library is assumed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                texts = extract(c)
                yield pd.DataFrame({"path": [p] * len(texts), "page": list(range(1, len(texts) + 1)), "text": texts})

    digests = files.select("path", F.sha2("content", 256).alias("sha256"))
    return files.select("path", "content").mapInPandas(run, "path string, page int, text string").join(digests, "path").select("path", "sha256", "page", "text")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources: a JSON array of records."""
    schema = "source_id string, file_name string, url string, title string, phase string, organization string, year int, source_type string, source_url string, region array<string>, varieties array<string>, authority_score double, license_note string, use_mode string, page_ranges array<array<int>>, exclude_terms array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def source_status(registry: DataFrame, files: DataFrame, key: str = "source_id") -> DataFrame:
    """Every source with status available or missing. ``files``: (key)."""
    have = files.select(F.col(key)).distinct().withColumn("_have", F.lit(True))
    return registry.join(have, key, "left").withColumn("status", F.when(F.col("_have"), "available").otherwise("missing")).drop("_have")


def evidence_type(use_mode: Column) -> Column:
    return F.when(use_mode == "research_evidence_only", "research_result").when(use_mode == "variety_specific_research_only", "variety_specific_guidance").otherwise("guideline")


def latest_labels(log: DataFrame, group: str = "parent", stage: str = "stage", at: str = "at") -> DataFrame:
    """The last label of each group of an append-only log."""
    return log.groupBy(group).agg(F.max_by(stage, at).alias(stage))


def pending(groups: DataFrame, labels: DataFrame, group: str = "parent") -> DataFrame:
    return groups.join(labels.where("stage is not null").select(group), group, "left_anti")


def path_parts(path: Column) -> dict[str, Column]:
    """Country and province of ".../segmentation/<country>/<province>/...", null where absent."""
    parts = F.split(F.regexp_extract(path, "segmentation/(.*)$", 1), "/")
    return {"country": F.nullif(F.try_element_at(parts, F.lit(1)), F.lit("")), "province": F.try_element_at(parts, F.lit(2))}


def cluster_of(scenario_id: Column) -> Column:
    return F.substring_index(scenario_id, "__", 1)


def predictions(rows: DataFrame) -> DataFrame:
    """Records of a prediction: id, stage, confidence, belief as a map."""
    from ..schema import STAGES

    names = F.array(*(F.lit(s[0]) for s in STAGES))
    shown = F.array(*(F.lit(s[1]) for s in STAGES))
    at = F.col("predicted") + 1
    return rows.select("image_id", F.element_at(names, at).alias("stage"), F.element_at(shown, at).alias("display_name"), "confidence", F.map_from_arrays(names, "belief").alias("belief"))


def write_logits(rows: DataFrame, path: str) -> None:
    """(model, split, image_id, label, logits) as Parquet by model and split, so that readers prune."""
    rows.select("model", "split", "image_id", "label", "logits").write.mode("overwrite").partitionBy("model", "split").parquet(path)


LOGITS = "image_id string, label int, logits array<double>, model string, split string"


def read_logits(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_logits`` wrote; filters on model and split read only their folders."""
    return spark.read.schema(LOGITS).parquet(path)


def write_outputs(chunks: DataFrame, registry: DataFrame, path: str) -> None:
    """The sinks of a corpus build: all chunks and the unrestricted ones as JSON lines, the registry, a report of counts, the
    canonical table and the review queue as CSV with arrays as JSON. The build is written once and the others read that."""
    from ..operators.segment import review_queue

    spark = chunks.sparkSession
    write_chunks(chunks, f"{path}/complete")
    done = spark.read.schema(CHUNK).json(f"{path}/complete")
    write_chunks(done.where(~F.col("restricted_action")), f"{path}/nonrestricted")
    registry.write.mode("overwrite").json(f"{path}/registry")
    corpus.fixed_domain(done).write.mode("overwrite").json(f"{path}/report")
    table = done.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in CHUNK))
    csv = {"header": True, "escape": '"', "encoding": "UTF-8"}
    table.write.mode("overwrite").options(**csv).csv(f"{path}/canonical")
    review_queue(table).write.mode("overwrite").options(**csv).csv(f"{path}/review_queue")


def report_lines(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Markdown lines of those report files that exist: one for each field of each row. Reports are aggregates; all rows are told."""
    out = []
    for name, path in sorted(paths.items()):
        try:
            rows = spark.read.json(path).toLocalIterator()
            rows = list(rows)
        except AnalysisException:
            continue
        out.append(f"## {name}")
        out += [f"- {k}: {v}" for r in rows for k, v in r.asDict().items()]
    return out
