"""Readers and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from veridica.operators import manifest
from veridica.sources import files


def words(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.fixture
def corpus_file(tmp_path):
    rows = [
        {"id": "a", "content": words(25), "care_topic": "pest_risk", "direct_applicable_stages": [1], "review_status": "Reviewed", "production_eligible": "yes", "region": ["r1"]},
        {"text": words(25), "stage_compatibility": [1, 0, 0, 0, 0, 0], "authority_score": 0.75, "review_status": "excluded"},
        {"chunk_id": "c", "text": words(25), "c_tillering": 0.4, "year": "2021", "page": 3, "varieties": "x|general"},
    ]
    path = tmp_path / "chunks.jsonl"
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_chunks_round_trip(spark, corpus_file, tmp_path):
    got = {r.chunk_id: r for r in files.read_chunks(spark, corpus_file).collect()}
    assert set(got) == {"a", "c"} and got["a"].stage_compatibility == [0.55, 1.0, 0.55, 0.0, 0.0, 0.0]
    assert got["c"].stage_compatibility[1] == 0.4 and got["c"].source_year == 2021 and got["c"].page_end == 3
    everything = files.read_chunks(spark, corpus_file, mode="all", include_sample=True)
    assert {r.chunk_id for r in everything.collect()} == {"a", "chunk_00003", "c"}  # blank lines count
    assert {r.chunk_id for r in files.read_chunks(spark, corpus_file, mode="production").collect()} == {"a"}
    files.write_chunks(everything, str(tmp_path / "out"))
    again = files.read_chunks(spark, str(tmp_path / "out"), mode="all", include_sample=True)
    assert {r.chunk_id: r.text for r in again.collect()} == {r.chunk_id: r.text for r in everything.collect()}


def test_bad_chunks_fail(spark, tmp_path):
    short, twice = tmp_path / "short.jsonl", tmp_path / "twice.jsonl"
    short.write_text(json.dumps({"id": "a", "text": "few words"}))
    twice.write_text("\n".join(json.dumps({"id": "a", "text": words(30)}) for _ in range(2)))
    with pytest.raises(Exception, match="words"):
        files.read_chunks(spark, str(short)).collect()
    assert files.read_chunks(spark, str(short), strict=False).count() == 0
    with pytest.raises(ValueError, match="repeated"):
        files.read_chunks(spark, str(twice))


def test_scenarios(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('scenario_id,topic,ground_truth_stage,predicted_stage,confidence,stage_belief,relevant_chunk_ids,incompatible_chunk_ids\ni__t,pest_risk,tillering,ripening,,"[1,1,2,0,0,0]",a|b|a,c\nj__t,pest_risk,tillering,,0.4,,"[""x""]",\n')
    a, b = files.read_scenarios(spark, str(path)).orderBy("scenario_id").collect()
    assert (a.truth, a.predicted_stage, a.predicted, a.confidence) == (1, 5, 2, 0.5) and a.belief == [0.25, 0.25, 0.5, 0, 0, 0]
    assert a.grades == {"a": 1.0, "b": 1.0} and a.incompatible == ["c"]
    assert b.belief == [0, 1, 0, 0, 0, 0] and b.confidence == 0.4 and b.grades == {"x": 1.0} and b.incompatible == []
    bad = spark.createDataFrame([("[1,2]",), ("[0,0,0,0,0,0]",)], "b string")
    for r in (0, 1):
        with pytest.raises(Exception, match="bad belief"):
            bad.select(files.belief_of(F.col("b"), F.lit(0), 6)).offset(r).limit(1).collect()


def test_images(spark, tmp_path):
    for name in ("01_establishment/s/a_subset_overlap_0.jpg", "01_establishment/s/a_subset_overlap_1.JPG", "06_ripening/b.png", "x/c.txt"):
        p = tmp_path / "img" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    found = files.scan_images(spark, str(tmp_path / "img"), content=True)
    got = {r.path for r in found.collect()}
    assert "06_ripening/b.png" in got and "01_establishment/s/a_subset_overlap_0.jpg" in got and "x/c.txt" not in got
    m = manifest.from_files(found)
    assert {r.macro_stage for r in m.collect()} == {"establishment", "ripening"}
    assert files.image_groups(found).where("parent = 'a'").first().folder == "01_establishment/s"
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "img"))
    assert {tuple(r.logits) for r in files.score_images(binary, lambda c: [len(c), 1]).collect()} >= {(17.0, 1.0)}
    pages = files.pdf_pages(binary, lambda c: c.decode().split("/"))
    assert pages.where("page = 2 and text = 'b.png'").count() == 1


def test_registry_labels_and_outputs(spark, corpus_file, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"source_id": "s1", "page_ranges": [[1, 2]], "use_mode": "research_evidence_only"}, {"source_id": "s2"}]))
    reg = files.read_registry(spark, str(tmp_path / "r.json"))
    have = spark.createDataFrame([("s1",)], "source_id string")
    assert {r.source_id: r.status for r in files.source_status(reg, have).collect()} == {"s1": "available", "s2": "missing"}
    assert reg.select(files.evidence_type(F.col("use_mode")).alias("e")).first().e == "research_result"
    log = spark.createDataFrame([("p", "tillering", 1), ("p", "ripening", 2), ("q", None, 1)], "parent string, stage string, at int")
    labels = files.latest_labels(log)
    assert {r.parent: r.stage for r in labels.collect()} == {"p": "ripening", "q": None}
    groups = spark.createDataFrame([("p",), ("q",), ("z",)], "parent string")
    assert {r.parent for r in files.pending(groups, labels).collect()} == {"q", "z"}
    out = str(tmp_path / "out")
    files.write_outputs(files.read_chunks(spark, corpus_file, mode="all", include_sample=True), reg, out)
    table = files.read_table(spark, f"{out}/canonical")
    assert table.count() == 3 and table.where("chunk_id = 'a'").first().region == '["r1"]'
    lines = files.report_lines(spark, {"coverage": f"{out}/report", "absent": f"{out}/nothing"})
    assert lines[0] == "## coverage" and "## absent" not in lines
    assert files.first_readable(spark, [f"{out}/no.csv", f"{out}/canonical"])[0].endswith("canonical")
    with pytest.raises(ValueError, match="missing columns"):
        files.required(table, "chunk_id", "nope")


def test_small_functions(spark):
    row = spark.range(1).select(files.path_parts(F.lit("d/segmentation/vn/hue/rgb/a.jpg"))["country"].alias("c"), files.path_parts(F.lit("d/segmentation/vn/hue/rgb/a.jpg"))["province"].alias("p"), files.path_parts(F.lit("a.jpg"))["country"].alias("n"), files.cluster_of(F.lit("img__topic")).alias("k")).first()
    assert tuple(row) == ("vn", "hue", None, "img")
