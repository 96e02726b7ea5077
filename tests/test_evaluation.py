"""Benchmarks, percentiles, metadata and reports by hand."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from millwright.functions import facts
from millwright.operators import compliance, evaluation, graph, metadata
from millwright.sources import files, snapshots


@pytest.mark.parametrize("most_ranked", [10_000, 5])
def test_nearest_rank(spark, most_ranked):
    """Ties, one hot value, negative and huge numbers, groups of one; ranges searched again until few are left."""
    r = random.Random(1)
    groups = {"even": [r.uniform(-5, 5) for _ in range(700)], "hot": [1.0] * 400 + [r.random() for _ in range(50)], "wide": [10.0 ** r.randint(-9, 15) * r.choice([1, -1]) for _ in range(300)], "one": [3.5], None: [1.0, 2.0], "same": [7.0] * 60}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    data = spark.createDataFrame(r.sample(rows, len(rows)), "g string, v double")
    got = {x.g: (x.n, x.percentile) for x in evaluation.nearest_rank(data, "g", "v", most_ranked=most_ranked).collect()}
    assert got == {g: (len(v), round(sorted(v)[round(0.95 * (len(v) - 1))], 4)) for g, v in groups.items()}
    assert evaluation.nearest_rank(data.limit(0), "g", "v").count() == 0


def test_answer_outcomes(spark):
    questions = spark.createDataFrame([(1, "a.txt", "P-1"), (2, "B.txt", None), (3, "gone.txt", "P-3"), (4, "d.txt", "P-4"), (5, "a.txt", " ")], "item_id int, file_name string, asset string")
    answers = spark.createDataFrame([(1, ["x.txt", "a.txt"], 0.5), (2, ["b.txt"], 0.7), (3, ["a.txt"], 0.1), (4, ["x.txt", "y.txt", "a.txt", "d.txt"], 0.9)], "item_id int, citations array<string>, confidence double")
    corpus = spark.createDataFrame([(f"{x}.txt",) for x in ["a", "B", "d", "a", "x"]], "file_name string")
    evidence = spark.createDataFrame([(1, ["p-1 "], None), (3, None, "of P-33"), (4, [], "the p-4, too"), (2, ["P-2"], "P-2")], "item_id int, tags array<string>, text string")
    o = evaluation.answer_outcomes(questions, answers, corpus, evidence)
    got = {r.item_id: r for r in o.collect()}
    assert {i: (r.place, r.category, r.asset_hit, r.source_hit) for i, r in got.items()} == {
        1: (2, "pass", True, True), 2: (0, "correct_document_not_retrieved", False, True), 3: (0, "expected_source_absent_from_corpus", False, False),
        4: (4, "correct_document_outside_top3", True, True), 5: (0, "correct_document_not_retrieved", False, False),
    }
    rates = evaluation.answer_rates(o).first()
    assert (rates.questions, rates.answerable, rates.top1_rate, rates.top3_rate, rates.asset_questions, rates.asset_hit_rate) == (5, 4, 0.0, 0.2, 3, 0.6667)
    assert (rates.answerable_asset_hit_rate, rates.failed, rates.source_hit_rate, rates.citation_rate, rates.mean_confidence) == (1.0, 4, 0.6, 0.8, 0.44)
    assert evaluation.answer_rates(o.limit(0)).first().top1_rate == 0.0


CHUNK = "chunk_id string, document_id string, chunk_index int, metadata string, original_filename string, storage_path string"


def test_chunk_metadata(spark):
    """Three layouts, and metadata that says nothing or something of another kind."""
    flat = {"parent_chunk_id": "p", "file_name": "f.pdf", "page_start": 2, "page_end": "3", "row_index": 7, "asset_tags": ["P-1"], "parent_summary_asset_tags": ["C-2", "P-1"], "answerable_questions": ["why?"], "section_title": ""}
    nested = {"parent": {"id": "p", "pages": {"first": 2, "last": 3}, "rows": {"first": 7, "last": 7}, "tags": ["P-1"]}, "source": {"file": "f.pdf"}, "unit": {"tags": ["C-2"], "questions": ["why?"]}}
    lists = {"parent": "p", "source_file": "f.pdf", "pages": [2, 3], "rows": [7, 7], "tags": ["C-2", "P-1"], "questions": ["why?"]}
    odd = {"parent_chunk_id": ["x"], "file_name": {"a": 1}, "page_start": "two", "asset_tags": "P-1", "pages": []}
    rows = [(str(i), "d", i, m if m is None or m == "{" else json.dumps(m), "o.pdf", "/s/o.pdf") for i, m in enumerate([flat, nested, lists, odd, None, "{"])]
    got = {r.chunk_id: r for r in metadata.chunk_fields(spark.createDataFrame(rows, CHUNK)).collect()}
    for i in "012":
        r = got[i]
        assert (r.parent_chunk_id, r.retrieval_unit_id, r.file_name, r.source_path, r.page_start, r.page_end, r.row_start, r.row_end, r.section_title) == ("p", f"{i}:summary:0", "f.pdf", "/s/o.pdf", 2, 3, 7, 7, None)
        assert r.asset_tags == ["C-2", "P-1"] and r.questions == ["why?"]
    for i in "345":
        assert (got[i].parent_chunk_id, got[i].file_name, got[i].page_start, got[i].asset_tags, got[i].questions) == (i, "o.pdf", None, [], [])


def test_reports(spark, tmp_path):
    results = spark.createDataFrame([(1, True), (2, False)], "item_id int, top1 boolean")
    summary = results.agg(F.count("*").alias("questions"))
    path = f"{tmp_path}/report"
    with pytest.raises(FileNotFoundError):
        files.read_report(spark, path, "questions long", "item_id int, top1 boolean")
    files.write_report(results, summary, path)
    one, rows = files.read_report(spark, path, "questions long", "item_id int, top1 boolean")
    assert one.first().questions == 2 and sorted(map(tuple, rows.collect())) == [(1, True), (2, False)]
    with pytest.raises(ValueError, match="one summary"):
        files.write_report(results, results, path)
    (tmp_path / "report" / "summary" / "part-x.json").write_text("{}\n")
    with pytest.raises(ValueError, match="malformed"):
        files.read_report(spark, path, "questions long", "item_id int, top1 boolean")


def test_json_lines_and_write_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nnot json\n\n{"k": 2, "x": 3}\n')
    assert sorted(r.k for r in files.read_json(spark, f"{tmp_path}/a.jsonl", "k int").collect()) == [1, 2]
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a")], "k int, v string")
    for _ in range(2):
        files.write_once(rows, f"{tmp_path}/t", ["k"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and snapshots.exists(spark, f"{tmp_path}/t")


def test_document_details(spark):
    documents = spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, filename string")
    mentions = spark.createDataFrame([(1, "P-2", 5), (1, "P-1", 5), (1, "P-1", 9), (None, "P-7", 5), (3, "P-7", 5)], "document_id int, tag string, entity_id int")
    got = graph.document_details(documents, mentions, spark.createDataFrame([(5, "seal")], "entity_id int, name string")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", ["P-1", "P-2"], ["seal"]), (2, "b", [], [])]


def test_reasons_with_dates(spark):
    rows = [("P-101", 1, 0, None, "P-101 certificate: EXPIRED (01-Feb-2025)."), ("P-102", 1, 0, None, "P-102 Calibration: OVERDUE by 45 days."), ("P-103", 1, 0, None, "P-103 certificate lapsed, expired.")]
    evidence = spark.createDataFrame(rows, "tag string, document_id int, chunk_index int, created_at timestamp, text string")
    got = {r.tag: r.reason for r in compliance.gap_records(evidence, F.lit("2025-03-01").cast("date")).collect()}
    assert got["P-101"] == "Evidence records an expired test/inspection certificate for P-101. The certificate date on file (2025-02-01) is in the past relative to 2025-03-01. Operating without a valid certificate is a regulatory non-conformance."
    assert got["P-102"] == "Instrument calibration for P-102 is overdue per the evidence on file. It is overdue by 45 days."
    assert got["P-103"].startswith("Evidence records an expired test/inspection certificate for P-103. Operating")


def test_intents_beyond_ascii(spark):
    """A letter of any script beside a word makes it another word."""
    said = ["café: WHY IS it hot", "éwhy is it", "procédure", "Prüfung: inspection", "commissionné", "leaking。"]
    got = {r.t: r.i for r in spark.createDataFrame([(t,) for t in said], "t string").select("t", facts.intent(F.col("t")).alias("i")).collect()}
    assert got == {said[0]: "failure_rca", said[1]: "general", said[2]: "general", said[3]: "inspection", said[4]: "procedure", said[5]: "failure_rca"}


def test_a_file_for_each_package(spark, tmp_path):
    pages = spark.createDataFrame([("P-1.md", "# one\nä"), ("P-2.md", None)], "file_name string, markdown string").repartition(2)
    for _ in range(2):
        assert files.write_markdown(pages, f"{tmp_path}/exports") == 2
    assert {p.name: p.read_text() for p in (tmp_path / "exports").iterdir() if not p.name.endswith(".crc")} == {"P-1.md": "# one\nä", "P-2.md": ""}
    for bad in ("../x.md", "", "..", None, "P-1.md"):
        with pytest.raises(ValueError, match="not a name"):
            files.write_markdown(pages.union(spark.createDataFrame([(bad, "x")], pages.schema)), f"{tmp_path}/exports")
    assert files.write_markdown(pages.limit(0), f"{tmp_path}/none") == 0
