"""Dimensions and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values of the data model: stages in order with display name and BBCH range.
STAGES = (
    ("establishment", "Establishment", "00-19"),
    ("tillering", "Tillering", "20-29"),
    ("stem_booting", "Stem/booting", "30-49"),
    ("reproductive", "Reproductive", "50-69"),
    ("grain_filling", "Grain filling", "70-79"),
    ("ripening", "Ripening", "80-89"),
)
STAGE_NAMES = tuple(s[0] for s in STAGES)
N_STAGES = len(STAGES)

# Other spellings of a stage label, beside "sNN", "sNN_<name>" and the name itself.
MORE_ALIASES = {
    "germination_leaf_development": "establishment",
    "stem_boot": "stem_booting",
    "stem_elongation_booting": "stem_booting",
    "stem_elongation_and_booting": "stem_booting",
    "heading_flowering": "reproductive",
    "heading_and_flowering": "reproductive",
    "grain_development": "grain_filling",
}
NON_TRAINING = ("uncertain", "unusable")  # s07 and s08

# Topics and facets in declared order, the first of which wins ties.
TOPICS = (
    "water_management", "nutrient_management", "pest_risk", "disease_risk", "weed_management",
    "harvest_readiness", "residue_management", "climate_adaptation", "general_crop_care",
)
# The topics' names in Vietnamese queries.
TOPIC_LABELS_VI = {
    "water_management": "quản lý nước",
    "nutrient_management": "quản lý dinh dưỡng và bón phân",
    "pest_risk": "nguy cơ và quản lý sâu hại",
    "disease_risk": "nguy cơ và quản lý bệnh hại",
    "weed_management": "quản lý cỏ dại và lúa cỏ",
    "harvest_readiness": "đánh giá chín và thời điểm thu hoạch",
    "residue_management": "quản lý rơm rạ sau thu hoạch",
    "climate_adaptation": "canh tác thích ứng biến đổi khí hậu",
    "general_crop_care": "kỹ thuật chăm sóc lúa",
}
GENERAL_TOPIC = "general_crop_care"
FACETS = ("fertilizer", "conditions", "pest_disease_prevention", "next_stage_action")
APPROVED = ("reviewed", "domain_reviewed", "approved")
DROPPED = ("excluded", "sample_only_not_agronomic_ground_truth")

# Compatibility of a neighbouring stage, of a chunk without a stage, of a mentioned stage.
NEIGHBOUR, UNSTAGED, MENTIONED = 0.55, 0.35, 0.85

_text = T.StringType()
CHUNK = T.StructType(
    [
        *(T.StructField(n, _text) for n in ("chunk_id", "text", "topic")),
        T.StructField("stage_compatibility", T.ArrayType(T.DoubleType())),
        T.StructField("authority_score", T.DoubleType()),
        *(T.StructField(n, _text) for n in ("facet", "source_id", "review_status")),
        *(T.StructField(n, T.BooleanType()) for n in ("production_eligible", "restricted_action")),
        *(T.StructField(n, _text) for n in ("evidence_type", "section")),
        *(T.StructField(n, T.IntegerType()) for n in ("page_start", "page_end")),
        *(T.StructField(n, _text) for n in ("source_title", "source_organization")),
        T.StructField("source_year", T.IntegerType()),
        *(T.StructField(n, _text) for n in ("source_url", "source_type")),
        *(T.StructField(n, T.ArrayType(_text)) for n in ("region", "varieties")),
        *(T.StructField(n, _text) for n in ("use_mode", "language")),
    ]
)


def aliases() -> list[tuple[str, str, bool]]:
    """(slug, canonical label, is_training)."""
    rows = []
    for i, name in enumerate((*STAGE_NAMES, *NON_TRAINING), 1):
        rows += [(slug, name, i <= N_STAGES) for slug in (f"s{i:02d}", f"s{i:02d}_{name}", name)]
    return rows + [(k, v, True) for k, v in MORE_ALIASES.items()]


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(aliases(), "slug string, label string, is_training boolean")


def stage_table(spark: SparkSession) -> DataFrame:
    rows = [(i, n, d, int(b[:2]), int(b[3:])) for i, (n, d, b) in enumerate(STAGES)]
    return spark.createDataFrame(rows, "stage_id int, stage string, display_name string, bbch_low int, bbch_high int")
