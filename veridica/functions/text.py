"""Text functions: tokens, slugs, phrase counts, cleaning."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import STAGES, TOPIC_LABELS_VI, aliases

TOKEN = "[0-9A-Za-zÀ-ỹĐđ]+"
WORDISH = "[\\p{L}\\p{N}_À-ỹ]"


def tokens(text: Column) -> Column:
    """Maximal runs of digits and letters of the lower-cased text; null: empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def words(text: Column) -> Column:
    """Runs of other than white space."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def slug(label: Column) -> Column:
    """Lower case, "/", "-" and other characters to "_", repeats and ends trimmed."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), F.lit("_"))


def phrase_count(text: Column, phrase: str) -> Column:
    """Occurrences of ``phrase`` in the lower-cased text that no word character touches."""
    return bounded_count(F.lower(text), phrase)


def bounded_count(low: Column, phrase: str) -> Column:
    """``phrase_count`` of a text in lower case. The phrase comes first and what is before it after that: most places of a text fail
    at the first letter, before any class of characters is asked."""
    p = re.escape(phrase)
    return F.regexp_count(low, F.lit(f"{p}(?<!{WORDISH}{p})(?!{WORDISH})"))


def substring_count(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of ``phrase``."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase)))) / len(phrase)).cast("int")


def listed(value: Column) -> Column:
    """A JSON array, or a list separated by "|" or else by ",", to trimmed entries without blanks; null: empty."""
    sep = F.split(F.regexp_replace(value, r"^\[|\]$", ""), F.when(value.contains("|"), F.lit(r"\|")).otherwise(F.lit(",")))
    parts = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(sep)
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def truth(value: Column, default: bool = False) -> Column:
    """Textual yes; blank or null: ``default``."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isNull() | (v == ""), F.lit(default)).otherwise(v.isin("1", "true", "yes", "y", "approved"))


def usable(value: Column, default: bool = True) -> Column:
    """Two lists of words, and the default for all else."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("1", "true", "yes", "y", "usable", "use", "ok"), True).when(v.isin("0", "false", "no", "n", "unusable", "exclude", "bad"), False).otherwise(default)


def first_present(*columns: Column, default: str = "") -> Column:
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns), F.lit(default))


def parent_stem(name: Column) -> Column:
    """The file name without directory, extension and what follows the overlap marker."""
    return F.substring_index(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""), "_subset_overlap", 1)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, for which there is no SQL function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalized(text: Column, repairs: dict[str, str] | None = None, compose: bool = False) -> Column:
    """Soft hyphens out, glyph ``repairs``, words joined over a hyphen at a line's end, white space collapsed."""
    x = F.replace(nfc(text) if compose else text, F.lit("­"), F.lit(""))
    for old, new in (repairs or {}).items():
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.regexp_replace(x, "([A-Za-zÀ-ỹ])-\\s*\\n\\s*([A-Za-zÀ-ỹ])", "$1$2")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def dedup_key(topic: Column, text: Column, length: int | None = None) -> Column:
    """Of the topic and the letters and digits of the text: all of them, or the first ``length``, for corpora of short units."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")
    return F.sha1(F.concat(topic, letters if length is None else F.substring(letters, 1, length)))


def stage_label(label: Column) -> Column:
    """A scenario's stage: "/", "-" and blanks to "_" one by one (repeats stay), other spellings by the alias table; null if
    that is no stage."""
    key = F.translate(F.lower(F.trim(label)), "/- ", "___")
    names = {a: name for a, name, training in aliases() if training}
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key]


def topic_query(topic: Column, stage: Column, language: Column) -> Column:
    """The text of a topic's query in Vietnamese ("vi") or English (any other language), with the stage's name and range where
    ``stage`` is not null or empty; a stage that is not known stands as it is, without a range."""
    plain = F.replace(topic, F.lit("_"), F.lit(" "))
    vi = F.coalesce(F.create_map(*(F.lit(x) for pair in TOPIC_LABELS_VI.items() for x in pair))[topic], plain)
    key = F.lower(F.trim(stage))
    shown = F.coalesce(F.create_map(*(F.lit(x) for n, d, _ in STAGES for x in (n, d)))[key], stage)
    span = F.coalesce(F.create_map(*(F.lit(x) for n, _, b in STAGES for x in (n, b)))[key], F.lit(""))
    bare = F.coalesce(stage, F.lit("")) == ""
    in_vi = F.when(bare, F.format_string("Bằng chứng %s phù hợp với lúa.", vi)).otherwise(F.format_string("Bằng chứng %s phù hợp với lúa ở giai đoạn %s, BBCH %s.", vi, shown, span))
    in_en = F.when(bare, F.format_string("Rice %s evidence.", plain)).otherwise(F.format_string("Rice %s evidence applicable to %s, BBCH %s.", plain, shown, span))
    return F.when(language == "vi", in_vi).otherwise(in_en)
