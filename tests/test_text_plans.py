"""Texts are searched, parsed and folded once: what Spark would evaluate again for a condition, a neighbour or an explode."""

import re

import __spark_entry__
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from veridica.functions import text as X
from veridica.operators import index, retrieval, segment
from veridica.plans import catalog

LOW = "The of the; the,the and_the thethe é1the the\U0001d400 un-the\nof the of"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("phrase", ["the", "of the", "the of the", "un", "a.b"])
def test_phrase_counts_are_those_of_the_plain_pattern(spark, phrase):
    """F22 stage_vector."""
    df = spark.createDataFrame([(x,) for x in (LOW, "", "the", "xthe the", "un un-un", "a.b axb A.B")], "t string")
    plain = F.regexp_count(F.lower("t"), F.lit(f"(?<!{X.WORDISH}){re.escape(phrase)}(?!{X.WORDISH})"))
    assert df.where(X.phrase_count(F.col("t"), phrase) != plain).count() == 0
    got = plan(df.select(X.phrase_count(F.col("t"), phrase)))
    assert f", {re.escape(phrase)}(?<!" in got  # the phrase is looked for first, not the class before it


def test_scores_are_counted_once(spark):
    """F21 facet_classify: not again for the condition that a score is above 0."""
    df = spark.createDataFrame([("und und the",), ("the und",), ("",), (None,)], "t string")
    lex = {"a": ("the",), "b": ("und",)}
    out = df.select(segment.classify(F.lit(""), F.col("t"), lex, "none", bounded=True).alias("c"))
    assert [r.c for r in out.collect()] == ["b", "a", "none", "none"]
    assert plan(out).count(", und(?<!") == 1
    assert [r.c for r in df.select(segment.classify(F.lit(""), F.col("t"), lex).alias("c")).collect()] == ["b", "a", None, None]


def test_a_sentence_is_searched_once(spark):
    """F18 focused_snippets: not again for each sentence of its text."""
    said = " ".join(f"W{i} " + " ".join(f"x{i}y{k}" for k in range(9)) + ("." if i != 5 else " zebra.") for i in range(12))
    df = spark.createDataFrame([(1, "t", said)], "id int, topic string, text string")
    out = segment.focused(df, {"z": ("zebra",)})
    (row,) = out.collect()
    assert [w for w in row.text.split() if w.startswith("W")] == ["W4", "W5", "W6"] and row.topic == "z" and row.derived_focus
    assert plan(out).count("zebra") == 2  # in the text and in the sentences


def test_pages_are_parsed_and_folded_once(spark, sf):
    """F19 segment_units; html_lines shares the parser."""
    q = __spark_entry__.queries()
    for name in ("segment_units", "html_lines"):
        found = plan(q[name](spark, sf))
        assert found.count("ArrowEvalPython") == 1 and found.count("MapInArrow") == (name == "segment_units")


def test_units_keep_their_columns_and_null_pages(spark):
    line = " ".join(f"w{k}" for k in range(30)) + "."
    rows = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (3, ["## T", line, line, "short"], None), (4, [line], "d")], "id int, lines array<string>, k string")
    got = [tuple(r) for r in segment.units(rows).orderBy("id", "position").collect()]
    assert got == [(3, None, 0, "T", f"{line} {line}"), (4, "d", 0, "", line)]


def test_units_are_written_before_they_are_read_twice(spark, sf, monkeypatch):
    """F15 corpus_build: a unit and what is derived from it came from a parse each."""
    seen, number = [], segment.dedup_number
    monkeypatch.setattr(segment, "dedup_number", lambda rows, **how: seen.append(plan(rows)) or number(rows, **how))
    assert catalog.corpus_build(spark, sf).count() > 0
    assert len(seen) == 1 and "Python" not in seen[0] and "MapInArrow" not in seen[0]


def test_texts_are_cut_to_tokens_once(spark):
    """F17 index_levels: not a second time to ask whether there are any."""
    df = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", None)], "chunk_id string, text string")
    posts = retrieval.postings(df)
    assert sorted(tuple(r) for r in posts.collect()) == [("a", "x", 2, 3), ("a", "y", 1, 3)]
    assert plan(posts).count("regexp_extract_all") == 1


def test_blocks_are_runs_of_bounded_size():
    """F17 index_levels: made where the sorted postings are, without another exchange."""
    rows = [(0, "t", "p", 3, i / 10, f"k{i}", i, 9) for i in range(5)] + [(0, "t", None, 3, 0.5, "n", 1, 9), (0, "t", "p", 3, 0.25, "m", 1, 9), (1, "u", "p", 3, 0.75, "m", 2, 9)]
    names = ["bucket", "term", "topic", "level", "impact", "key", "tf", "dl"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    (out,) = index._blocks(2)(iter([batch.slice(0, 0), batch]))
    got = [(r["term"], r["topic"], r["n"], r["top"], [p["key"] for p in r["posts"]]) for r in out.to_pylist()]
    assert got == [("t", "p", 2, 0.1, ["k0", "k1"]), ("t", "p", 2, 0.3, ["k2", "k3"]), ("t", "p", 1, 0.4, ["k4"]), ("t", None, 1, 0.5, ["n"]), ("t", "p", 1, 0.25, ["m"]), ("u", "p", 1, 0.75, ["m"])]
