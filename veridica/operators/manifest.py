"""Image manifests: labels, exclusions, path resolution, duplicates, morphology, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import N_STAGES, STAGE_NAMES, alias_table

IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,webp}"
FOLDER = r"^[sS]?0*([0-9]+)[_ -]*(.*)$"


def canonical_label(rows: DataFrame, label: str, out: str = "stage") -> DataFrame:
    """Adds ``out``, the canonical label (null if unknown), and ``is_training``."""
    a = F.broadcast(alias_table(rows.sparkSession).withColumnRenamed("label", out))
    return rows.withColumn("_slug", X.slug(F.col(label))).join(a, F.col("_slug") == F.col("slug"), "left").drop("_slug", "slug")


def exclusions(rows: DataFrame, files: DataFrame | None = None, label: str = "macro_stage", path: str = "image_path", flag: str = "usable") -> tuple[DataFrame, DataFrame]:
    """(training rows with stage and image_path, excluded rows with original_label and exclude_reason).

    Reasons in order: missing_file_name, usable_false, the non-training label or unknown_label, and with ``files``
    (their relative paths) not_found or ambiguous. One pass decides, two filters split.
    """
    r = canonical_label(rows.withColumn("original_label", F.col(label)), label)
    if files is not None:
        r = resolve_paths(r, files, path)
    lost = F.lit(None).cast("string") if files is None else F.col("path_fault")
    name = F.trim(F.coalesce(F.col(path), F.lit("")))
    reason = (
        F.when(name == "", "missing_file_name")
        .when(~X.usable(F.col(flag)) if flag in rows.columns else F.lit(False), "usable_false")
        .when(F.col("stage").isNull(), "unknown_label")
        .when(~F.col("is_training"), F.col("stage"))
        .otherwise(lost)
    )
    r = r.withColumn("exclude_reason", reason).drop("path_fault")
    return r.where("exclude_reason is null").drop("exclude_reason", "is_training"), r.where("exclude_reason is not null").drop("is_training", "stage")


def resolve_paths(rows: DataFrame, files: DataFrame, path: str = "image_path") -> DataFrame:
    """Adds resolved_path and path_fault: an exact path, else the only file of that base name."""
    exact = files.select(F.col("path").alias("_exact")).distinct()
    base = files.select(F.element_at(F.split("path", "/"), -1).alias("_base"), "path").groupBy("_base").agg(F.count("*").alias("_n"), F.min("path").alias("_only"))
    r = rows.join(exact, F.col(path) == F.col("_exact"), "left").withColumn("_name", F.element_at(F.split(F.col(path), "/"), -1)).join(base, F.col("_name") == F.col("_base"), "left")
    found = F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(F.col("_n") == 1, F.col("_only"))
    return r.withColumn("resolved_path", found).withColumn("path_fault", F.when(found.isNull(), F.when(F.col("_n") > 1, "ambiguous").otherwise("not_found"))).drop("_exact", "_base", "_n", "_only", "_name")


def folder_stage(name: Column) -> Column:
    """Stage of a folder "NN_name"; null where number and name disagree. A bare number will do."""
    number = F.regexp_extract(name, FOLDER, 1).try_cast("int")
    said = F.btrim(F.regexp_replace(F.lower(F.trim(F.regexp_extract(name, FOLDER, 2))), "[^a-z0-9]+", "_"), F.lit("_"))
    stage = F.when(number.between(1, N_STAGES), F.element_at(F.array(*map(F.lit, STAGE_NAMES)), number))
    other = F.when(stage == "stem_booting", said.isin("stem", "booting", "stem_elongation_booting")).when(stage == "grain_filling", said == "grain_development").otherwise(False)
    return F.when((said == "") | (said == stage) | other, stage)


def from_files(files: DataFrame, strict: bool = False) -> DataFrame:
    """Manifest of files in stage folders: ``files`` has path relative to the root, "<stage folder>/[session/...]name".

    A folder that names no stage is skipped, or with ``strict`` fails the job.
    """
    parts = F.split("path", "/")
    stage = folder_stage(parts[0])
    if strict:
        stage = F.coalesce(stage, F.raise_error(F.concat(F.lit("no stage in folder "), parts[0])).cast("string"))
    session = F.coalesce(F.nullif(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "/"), F.lit("")), F.lit("unknown"))
    group = F.concat_ws(":", "macro_stage", "capture_session", X.parent_stem(F.col("path")))
    return files.select("path", stage.alias("macro_stage"), session.alias("capture_session")).where("macro_stage is not null").select(
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("image_id"), F.col("path").alias("image_path"), group.alias("parent_image_id"), group.alias("field_id"), "capture_session", "macro_stage", F.lit("unassigned").alias("split"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Every row of a group of equal ``key``; null keys are no group. The groups are found by aggregation, so a large one
    is not gathered."""
    many = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")
    return rows.join(many, key)


def missing_files(rows: DataFrame, files: DataFrame, path: str = "image_path") -> DataFrame:
    return rows.join(files.select(F.col("path").alias(path)), path, "left_anti")


def features(rows: DataFrame) -> DataFrame:
    """Canopy cover, panicle and senescent shares from six pixel counts; denominators are 1 at least."""
    c = [F.col(f"class_{k}") for k in range(6)]  # background, green, senescent, panicle, weeds, duckweed
    canopy = c[1] + c[2] + c[3]
    one = F.lit(1)
    return rows.withColumn("canopy_px", canopy).withColumn("cover", canopy / F.greatest(c[0] + canopy, one)).withColumn("panicle_frac", c[3] / F.greatest(canopy, one)).withColumn("senescent_frac", c[2] / F.greatest(c[1] + c[2], one))


def morphology(rows: DataFrame, panicle_min: float = 0.02, senescent: tuple[float, float] = (0.05, 0.20), cover: tuple[float, float] = (0.31, 0.51), margin: float = 0.05, min_cover: float | None = 0.02) -> DataFrame:
    """Adds stage and review by a tree of thresholds; rows of less than ``min_cover`` go."""
    pf, sf, cv = F.col("panicle_frac"), F.col("senescent_frac"), F.col("cover")
    near = lambda x, at: (F.abs(x - at[0]) < margin) | (F.abs(x - at[1]) < margin)
    stage = F.when(pf >= panicle_min, F.when(sf < senescent[0], "reproductive").when(sf < senescent[1], "grain_filling").otherwise("ripening")).otherwise(F.when(cv < cover[0], "establishment").when(cv < cover[1], "tillering").otherwise("stem_booting"))
    review = F.when(pf >= panicle_min, near(sf, senescent)).otherwise(near(cv, cover) | (pf > 0))
    rows = rows if min_cover is None else rows.where(cv >= min_cover)
    return rows.withColumn("stage", stage).withColumn("review", review)


def class_weights(rows: DataFrame, stage: str = "stage_id") -> DataFrame:
    """(stage_id, n, weight = N / (6 max(n, 1))) for every stage."""
    dim = rows.sparkSession.range(N_STAGES).select(F.col("id").cast("int").alias("stage_id"))
    n = dim.join(rows.groupBy(F.col(stage).alias("stage_id")).agg(F.count("*").alias("n")), "stage_id", "left").na.fill(0, ["n"])
    return n.withColumn("weight", F.sum("n").over(W.partitionBy()) / (N_STAGES * F.greatest("n", F.lit(1))))


def crosstab(rows: DataFrame, split: str = "split", stage: str = "macro_stage") -> DataFrame:
    return rows.groupBy(split).pivot(stage, list(STAGE_NAMES)).count().na.fill(0)


def majority(rows: DataFrame, stage: str) -> DataFrame:
    """The most frequent stage, ties to the least, and the accuracy of always saying it."""
    n = rows.groupBy(stage).agg(F.count("*").alias("n"))
    return n.agg(F.max_by(stage, F.struct("n", (-F.col(stage)).alias("t"))).alias("stage_id"), (F.max("n") / F.sum("n")).alias("accuracy"))


def sample_weights(rows: DataFrame, stage: str = "stage_id") -> DataFrame:
    """Adds weight, the inverse of the stage's count."""
    n = rows.groupBy(stage).agg((1.0 / F.count("*")).alias("weight"))
    return rows.join(F.broadcast(n), stage)


def best_epoch(rows: DataFrame, by: str, epoch: str, f1: str) -> DataFrame:
    """The earliest epoch of highest f1 (a strict running best)."""
    return rows.groupBy(by).agg(F.min_by(epoch, F.struct((-F.col(f1)).alias("f"), epoch)).alias("best_epoch"), F.max(f1).alias("best_f1"))


def stem_index(files: DataFrame, folder: str = "rgb", path: str = "path") -> DataFrame:
    """(stem, file): of the paths under a directory ``folder`` the first of each stem."""
    under = files.where(F.array_contains(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), folder))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return under.groupBy(stem.alias("stem")).agg(F.min(path).alias("file"))


def pixel_files(pixels: DataFrame, files: DataFrame, image: str = "image") -> tuple[DataFrame, DataFrame]:
    """(rows of ``pixels`` with their ``file``, one row of counts ``matched`` and ``unmatched``); rows without a file go."""
    met = pixels.join(stem_index(files).withColumnRenamed("stem", image), image, "left")
    return met.where("file is not null"), met.agg(F.count("file").alias("matched"), F.count_if(F.col("file").isNull()).alias("unmatched"))


def split_rows(rows: DataFrame, which: str, split: str = "split", required: bool = True) -> DataFrame:
    """Rows of one split; with ``required`` an empty one is an error."""
    found = rows.where(F.col(split) == which)
    if required and found.isEmpty():
        raise ValueError(f"the split {which} has no rows")
    return found


def continued_epochs(before: DataFrame, new: DataFrame, by: str, epoch: str = "epoch") -> DataFrame:
    """``new`` with epochs counted on from the last one of the run ``before``; without one they stay."""
    last = before.groupBy(by).agg(F.max(epoch).alias("_last"))
    return new.join(last, by, "left").withColumn(epoch, F.col(epoch) + F.coalesce("_last", F.lit(0))).drop("_last")


def with_fallback(sheet: DataFrame | None, files: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(training rows, excluded rows, mode): a sheet's rows; where the sheet is missing or teaches nothing, those that the
    folders of ``files`` name, mode "folder"."""
    if sheet is not None:
        kept, gone = exclusions(sheet)
        if not kept.isEmpty():
            return kept, gone, "sheet"
    return from_files(files), files.where(folder_stage(F.split("path", "/")[0]).isNull()), "folder"
