"""Parent chunks by hand, against a plain walk, and of a document with very many elements."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from millwright.operators import parents

SCHEMA = "document_id string, position int, element_id string, element_type string, text string, source_type string, file_name string, page_number int, row_index int, section_title string, asset_tags array<string>, modality string, element_summary string"


def element(document, position, text, **more):
    row = {"document_id": document, "position": position, "element_id": f"{document}:e{position}", "element_type": "paragraph", "text": text, "source_type": "txt", "file_name": f"{document}.txt", "page_number": None, "row_index": None, "section_title": None, "asset_tags": [], "modality": "text", "element_summary": None}
    return tuple((row | more).values())


def test_pdf_page(spark):
    """One page of a pdf: its heading, text, a table with a summary and an image without one."""
    pdf = {"source_type": "pdf", "file_name": "r.pdf", "page_number": 3, "section_title": "Findings"}
    rows = [
        element("r", 0, "Findings", **pdf | {"element_type": "heading"}), element("r", 1, " P-101 leaks \n", **pdf | {"asset_tags": ["P-101"]}),
        element("r", 2, "a | b", **pdf | {"element_type": "table_block", "modality": "table", "element_summary": "Readings of HX-2"}), element("r", 3, "photo   of\nseal", **pdf | {"element_type": "image_caption", "modality": "image"}),
        element("r", 4, "next page", **pdf | {"page_number": 4, "section_title": None}),
    ]
    e = spark.createDataFrame(rows, SCHEMA)
    one, two = sorted(parents.with_summaries(parents.parents(e)).collect(), key=lambda r: r.parent)
    assert one.raw_text == "Findings\nP-101 leaks\ntable_block original evidence for r:e2: a | b\nimage_caption original evidence for r:e3: photo   of\nseal"
    assert one.text_evidence == "Findings\nP-101 leaks" and one.modality == "text" and (one.page_start, one.page_end, one.row_start) == (3, 3, None)
    assert one.element_ids == ["r:e0", "r:e1", "r:e2", "r:e3"] and one.element_types == ["heading", "image_caption", "paragraph", "table_block"] and one.asset_tags == ["P-101"]
    assert one.summary == "r.pdf section Findings, pages 3-3. Asset tags: P-101. Parent evidence summary input: Text evidence:\nFindings\nP-101 leaks\n\nAtomic visual summaries:\n- table_block r:e2: Readings of HX-2"
    assert one.questions[0] == "What information does Findings provide about P-101?" and one.questions[3] == "What status, date, or maintenance detail is mentioned for P-101?" and len(one.questions) == 5
    assert two.parent_chunk_id == "r:parent:1" and two.summary == "r.pdf pages 4-4. Asset tags: none. Parent evidence summary input: next page"
    assert two.questions[2] == "What source evidence is available for the referenced asset in r.pdf?"
    atomic = {r.element_id: r.element_summary for r in parents.atomic_summaries(e).collect()}
    assert atomic["r:e3"] == "image_caption element from r.pdf. Asset tags: none. Content representation: photo of seal" and atomic["r:e2"] == "Readings of HX-2" and atomic["r:e1"] is None


def test_rows_and_sections(spark):
    """Each csv row is a parent; txt elements part by section; a modality's tie goes to the first seen."""
    csv = {"source_type": "csv", "file_name": "w.csv"}
    rows = [element("w", 0, "'Tag': P-7.", **csv | {"row_index": 1}), element("w", 1, "note", **csv), element("w", 2, "'Tag': P-8.", **csv | {"row_index": 2}), element("w", 3, None, **csv | {"row_index": 3})]
    rows += [element("t", 0, "a", section_title="A", modality="ocr", element_type="ocr_text"), element("t", 1, "b", section_title="A"), element("t", 2, "c", section_title="B"), element("t", 3, "d", section_title="A")]
    got = {(r.document_id, r.parent): r for r in parents.with_summaries(parents.parents(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [got["w", i].raw_text for i in range(3)] == ["Row 1: 'Tag': P-7.", "note\nRow 2: 'Tag': P-8.", "Row 3:"]
    assert got["w", 0].summary == "w.csv rows 1-1. Asset tags: P-7. Parent evidence summary input: Row 1: 'Tag': P-7."
    assert [got["t", i].raw_text for i in range(3)] == ["ocr_text original evidence for t:e0: a\nb", "c", "d"] and got["t", 0].modality == "ocr" and len(got) == 6


def walk(rows, target):
    """(document, element ids) of each parent."""
    out, held, key, document = [], 0, None, None
    for r in rows:
        pieces = [r[4]] if len(r[4]) <= 11000 else [x for i in range(0, len(r[4]), 11000) if (x := r[4][i : i + 11000].strip(" \t\n\r\x0b\x0c"))]
        for i, x in enumerate(pieces):
            if document != r[0] or key != r[9] or held + len(x) > target:
                out.append((r[0], []))
                held, key, document = 0, r[9], r[0]
            held += len(x) + 2
            out[-1][1].append(r[2] if len(r[4]) <= 11000 else f"{r[2]}:part:{i}")
    return out


@pytest.mark.parametrize("target", [30, 9000])
def test_against_a_walk(spark, target):
    r = random.Random(target)
    rows = [element(f"d{d}", i, "x" * r.choice([0, 1, 9, 14, 28, 29, 30, 31, 4000, 11001, 23000]), section_title=r.choice(["a", "a", "a", "b"])) for d in range(6) for i in range(40)]
    got = sorted(parents.parents(spark.createDataFrame(rows, SCHEMA).repartition(7), target).collect(), key=lambda x: (x.document_id, x.parent))
    assert [(x.document_id, x.element_ids) for x in got] == walk(rows, target)


def test_many_elements(spark):
    """100,000 elements of one document."""
    one = spark.range(100_000).selectExpr("'d' as document_id", "int(id) as position", "concat('e', id) as element_id", "'paragraph' as element_type", "repeat('x', int(id % 90)) as text", "'txt' as source_type", "'d.txt' as file_name", "int(null) as page_number", "int(null) as row_index", "string(null) as section_title", "array() as asset_tags", "'text' as modality", "string(null) as element_summary")
    one = one.withColumn("asset_tags", F.col("asset_tags").cast("array<string>"))
    began = time.time()
    n = parents.parents(one).count()
    assert 400 < n < 600 and time.time() - began < 60
    assert parents.parents(one.limit(0)).count() == 0


def test_manual_summaries(spark):
    p = parents.parents(spark.createDataFrame([element("d", 0, "a"), element("e", 0, "b")], SCHEMA))
    manual = spark.createDataFrame([("d:parent:0", "by hand", ["why?"]), ("e:parent:0", "too", None), ("x", "unused", None)], "parent_chunk_id string, summary_text string, questions array<string>")
    got = {r.document_id: r for r in parents.with_summaries(p, manual).collect()}
    assert got["d"].summary == "by hand" and got["d"].questions == ["why?"] and len(got["e"].questions) == 5 and got["e"].strategy == "manual_parent_llm"
    with pytest.raises(Exception, match="no summary of parent"):
        parents.with_summaries(p, manual.limit(1)).collect()
