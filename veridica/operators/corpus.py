"""Corpus contract and governance: canonical chunks, validation, policy filters, coverage, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vec
from ..schema import APPROVED, DROPPED, FACETS, GENERAL_TOPIC, N_STAGES, NEIGHBOUR, STAGE_NAMES, TOPICS, UNSTAGED


def resolve_compatibility(vector: Column, scalars: list[Column] | None, stages: Column) -> Column:
    """The first of: an explicit vector of six, six scalar columns of which one is set, a list of stages (1, beside them
    NEIGHBOUR), all UNSTAGED. ``stages``: array<int> or null."""
    listed = F.transform(F.sequence(F.lit(0), F.lit(N_STAGES - 1)), lambda i: F.when(F.array_contains(stages, i), 1.0).when(F.array_contains(stages, i - 1) | F.array_contains(stages, i + 1), NEIGHBOUR).otherwise(0.0))
    options = [F.when(F.size(vector) == N_STAGES, vector)]
    if scalars:
        some = scalars[0].isNotNull()
        for s in scalars[1:]:
            some = some | s.isNotNull()
        options.append(F.when(some, F.array(*(F.coalesce(s.cast("double"), F.lit(0.0)) for s in scalars))))
    options.append(F.when(F.size(stages) > 0, listed))
    return F.coalesce(*options, F.array(*[F.lit(UNSTAGED)] * N_STAGES))


def canonicalize(raw: DataFrame) -> DataFrame:
    """Records with string columns in any of the known spellings to canonical chunks; absent columns count as null.

    An authority of 0, blank or null is 0.5. A first spelling that is null lets the next one through.
    """
    have = set(raw.columns)

    def col(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))

    vector = F.from_json(col("stage_compatibility", "compatibility_vector"), "array<double>")
    numbers = F.transform(X.listed(F.regexp_replace(col("direct_applicable_stages", "stage_ids", "applicable_stages"), r"[\[\]\s]", "")), lambda s: s.try_cast("int"))
    scalars = [col(f"c_{s}") for s in STAGE_NAMES] if have & {f"c_{s}" for s in STAGE_NAMES} else None
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    authority = col("authority_score").try_cast("double")
    page = number(col("page_start", "page"))
    texts = {n: F.coalesce(col(*s), F.lit("")) for n, s in {"source_id": ["source_id"], "evidence_type": ["evidence_type"], "section": ["section"], "source_title": ["source_title"], "source_organization": ["source_organization"], "source_url": ["source_url"], "source_type": ["source_type"], "use_mode": ["use_mode"]}.items()}
    return raw.select(
        col("chunk_id", "id").alias("chunk_id"),
        F.coalesce(col("text", "content", "chunk_text"), F.lit("")).alias("text"),
        F.coalesce(col("topic", "care_topic"), F.lit(GENERAL_TOPIC)).alias("topic"),
        resolve_compatibility(vector, scalars, numbers).alias("stage_compatibility"),
        F.when(authority != 0, authority).otherwise(0.5).alias("authority_score"),
        F.coalesce(col("facet"), F.lit("general")).alias("facet"),
        F.lower(F.coalesce(col("review_status"), F.lit("unreviewed"))).alias("review_status"),
        X.truth(col("production_eligible")).alias("production_eligible"),
        X.truth(col("restricted_action")).alias("restricted_action"),
        page.alias("page_start"),
        F.coalesce(number(col("page_end")), page).alias("page_end"),
        number(col("source_year", "year")).alias("source_year"),
        X.listed(col("region", "region_dependency")).alias("region"),
        X.listed(col("varieties", "variety_dependency")).alias("varieties"),
        F.coalesce(col("language"), F.lit("vi")).alias("language"),
        *(c.alias(n) for n, c in texts.items()),
    )


def faults(min_words: int = 20) -> Column:
    """array<string> of the constraints that a chunk breaks, in their order."""
    outside = lambda v: v.isNull() | (v < 0) | (v > 1)
    checks = [
        ("chunk_id", F.coalesce("chunk_id", F.lit("")) == ""),
        ("words", F.size(X.words(F.col("text"))) < min_words),
        ("compatibility_size", F.coalesce(F.size("stage_compatibility"), F.lit(-1)) != N_STAGES),
        ("compatibility_range", F.exists("stage_compatibility", outside)),
        ("authority", outside(F.col("authority_score"))),
    ]
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks)))


def validated(chunks: DataFrame, min_words: int = 20, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with ``faults``); strict: the first bad row fails the job."""
    rows = chunks.withColumn("faults", faults(min_words))
    if strict:
        stop = F.when(F.size("faults") > 0, F.raise_error(F.concat(F.lit("chunk "), F.coalesce("chunk_id", F.lit("?")), F.lit(": "), F.array_join("faults", ", "))))
        return rows.where(F.coalesce(stop.cast("boolean"), F.lit(True))).drop("faults"), rows.where("false")
    return rows.where(F.size("faults") == 0).drop("faults"), rows.where(F.size("faults") > 0)


def mode_filter(mode: str, include_sample: bool = False) -> Column:
    """Which chunks a mode ("all", "research", "production") lets through."""
    if mode not in ("all", "research", "production"):
        raise ValueError(f"unknown mode {mode}")
    fine = F.lit(True) if include_sample else ~F.col("review_status").isin(*DROPPED)
    if mode == "production":
        fine = fine & F.col("review_status").isin(*APPROVED) & F.col("production_eligible") & ~F.col("restricted_action")
    return fine


def converter_filter(mode: str, include_sample: bool = False) -> Column:
    """As ``mode_filter``, but mode "all" drops the sample status only."""
    if mode == "all" and not include_sample:
        return F.col("review_status") != DROPPED[1]
    return mode_filter(mode, include_sample)


def array_filters(topics: list[str] | None = None, regions: list[str] | None = None, varieties: list[str] | None = None) -> Column:
    """A chunk bound to no region (variety) passes; one of variety "general" always does."""
    asked = lambda xs: F.array(*map(F.lit, xs))
    fine = F.lit(True)
    if topics:
        fine = fine & F.col("topic").isin(*topics)
    if regions:
        fine = fine & ((F.size("region") == 0) | F.arrays_overlap("region", asked(regions)))
    if varieties:
        fine = fine & ((F.size("varieties") == 0) | F.array_contains("varieties", "general") | F.arrays_overlap("varieties", asked(varieties)))
    return fine


def coverage(chunks: DataFrame) -> DataFrame:
    """(dimension, value, n, restricted, eligible) by topic, facet, source, status, and in total: one pass of grouping sets."""
    dims = ["topic", "facet", "source_id", "review_status"]
    g = chunks.groupingSets([[c] for c in dims] + [[]], *dims).agg(F.count("*").alias("n"), F.sum(F.col("restricted_action").cast("long")).alias("restricted"), F.sum(F.col("production_eligible").cast("long")).alias("eligible"), F.grouping_id().alias("g"))
    name, value = F.lit("total"), F.lit(None).cast("string")
    for i, c in enumerate(dims):
        here = F.col("g") == (15 ^ (1 << (3 - i)))
        name, value = F.when(here, c).otherwise(name), F.when(here, F.col(c)).otherwise(value)
    return g.select(name.alias("dimension"), value.alias("value"), "n", "restricted", "eligible")


def stage_coverage(chunks: DataFrame, least: float = 0.8) -> DataFrame:
    """(stage_id, n) of chunks of high compatibility, for every stage."""
    one = chunks.agg(*(F.count_if(F.col("stage_compatibility")[k] >= least).alias(f"s{k}") for k in range(N_STAGES)))
    return one.select(F.posexplode(F.array(*(f"s{k}" for k in range(N_STAGES)))).alias("stage_id", "n"))


def fixed_domain(chunks: DataFrame) -> DataFrame:
    """Counts over all declared topics and facets, zeros included, and whether chunk ids are unique."""
    spark = chunks.sparkSession
    dims = spark.createDataFrame([("topic", t) for t in TOPICS] + [("facet", f) for f in (*FACETS, "general")], "dimension string, value string")
    counts = coverage(chunks).where("dimension in ('topic', 'facet')").select("dimension", "value", "n")
    unique = chunks.agg((F.count_distinct("chunk_id") == F.count("*")).alias("ids_unique"))
    return dims.join(counts, ["dimension", "value"], "left").na.fill(0, ["n"]).join(F.broadcast(unique))


def warnings(chunks: DataFrame, least_topic: int, least_stage: int) -> DataFrame:
    """(kind, value, n) of topics and stages with too few chunks."""
    topics = fixed_domain(chunks).where((F.col("dimension") == "topic") & (F.col("n") < least_topic)).select(F.lit("topic").alias("kind"), "value", "n")
    stages = stage_coverage(chunks).where(F.col("n") < least_stage).select(F.lit("stage"), F.element_at(F.array(*map(F.lit, STAGE_NAMES)), F.col("stage_id") + 1), "n")
    return topics.union(stages)


def union_first(corpora: list[DataFrame]) -> DataFrame:
    """All corpora; of a repeated chunk_id the row of the earliest corpus stays."""
    both = None
    for i, c in enumerate(corpora):
        c = c.withColumn("_i", F.lit(i))
        both = c if both is None else both.unionByName(c)
    w = W.partitionBy("chunk_id").orderBy("_i")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_i", "_n")


def dominant_stage(least: float) -> Column:
    """The first stage of highest compatibility, if that reaches ``least``."""
    x = F.col("stage_compatibility")
    return F.when(F.array_max(x) >= least, vec.argmax(x))


#: Buckets of a profile; evidence of any other facet is general.
BUCKETS = ("fertilizer", "conditions", "pest_disease_prevention")


def profiles(chunks: DataFrame, least: float = 0.8, bucket: int = 20) -> DataFrame:
    """(stage_id, bucket, place, chunk_id, authority_score): per stage and bucket the best by authority."""
    rows = chunks.withColumn("stage_id", dominant_stage(least)).where("stage_id is not null").withColumn("bucket", F.when(F.col("facet").isin(*BUCKETS), F.col("facet")).otherwise("general"))
    w = W.partitionBy("stage_id", "bucket").orderBy(F.col("authority_score").desc(), "chunk_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= bucket).select("stage_id", "bucket", "place", "chunk_id", "authority_score")


def evidence_item(note: Column | None = None) -> Column:
    """What a report shows of a chunk, as a struct; ``note`` is null where it is empty."""
    shown = ("chunk_id", "text", "topic", "facet", "source_title", "source_organization", "source_url", "authority_score", "language")
    return F.struct(*shown, F.nullif(note if note is not None else F.lit(""), F.lit("")).alias("note"))


def profile_report(chunks: DataFrame, least: float = 0.8, bucket: int = 20, previews: int = 8) -> DataFrame:
    """(stage_id, bucket, items): each stage's evidence of each bucket, and its next-stage actions with previews, in order; at most
    ``bucket`` items each, so an array is bounded."""
    staged = profiles(chunks, least, bucket).select("stage_id", "bucket", "place", "chunk_id", F.lit("").alias("note"))
    coming = lookahead(chunks, least, bucket, previews).select("stage_id", F.lit("next_stage_actions").alias("bucket"), "place", "chunk_id", "note")
    met = staged.where("bucket != 'next_stage_actions'").union(coming).join(chunks, "chunk_id")
    items = F.array_sort(F.collect_list(F.struct("place", evidence_item(F.col("note")).alias("item"))))
    return met.groupBy("stage_id", "bucket").agg(F.transform(items, lambda x: x["item"]).alias("items"))


def lookahead(chunks: DataFrame, least: float = 0.8, bucket: int = 20, previews: int = 8) -> DataFrame:
    """(stage_id, place, chunk_id, note): next-stage actions of each stage: its own, then previews of the next stage's
    evidence while there is room."""
    staged = chunks.withColumn("stage_id", dominant_stage(least)).where("stage_id is not null")
    w = W.partitionBy("stage_id").orderBy(F.col("authority_score").desc(), "chunk_id")
    own = staged.where("facet = 'next_stage_action'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= bucket).select("stage_id", "place", "chunk_id", F.lit("").alias("note"))
    held = own.groupBy("stage_id").agg(F.count("*").alias("held"))
    coming = staged.where(F.col("facet").isin(*BUCKETS) & (F.col("stage_id") > 0)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= previews)
    note = F.concat(F.lit("preview of "), F.element_at(F.array(*map(F.lit, STAGE_NAMES)), F.col("stage_id") + 1))
    coming = coming.select((F.col("stage_id") - 1).alias("stage_id"), "n", "chunk_id", note.alias("note")).join(held, "stage_id", "left").na.fill(0, ["held"])
    coming = coming.where(F.col("n") + F.col("held") <= bucket)
    return own.union(coming.select("stage_id", (F.col("n") + F.col("held")).cast("int"), "chunk_id", "note"))


def coverage_warnings(profile: DataFrame, actions: DataFrame) -> DataFrame:
    """(stage_id, bucket) of profile buckets without evidence."""
    spark = profile.sparkSession
    wanted = spark.range(N_STAGES).select(F.col("id").cast("int").alias("stage_id"), F.explode(F.array(*map(F.lit, (*BUCKETS, "next_stage_actions")))).alias("bucket"))
    have = profile.select("stage_id", "bucket").union(actions.select("stage_id", F.lit("next_stage_actions"))).distinct()
    return wanted.join(have, ["stage_id", "bucket"], "left_anti")
