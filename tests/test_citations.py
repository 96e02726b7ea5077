"""Citations and contexts by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import citations

FOUND = "item_id int, place int, chunk_id string, document_id string, chunk_index int, score double, file_name string, section_title string, page_start int, row_start int, row_end int, parent_chunk_id string, retrieval_unit_id string, retrieval_summary string, text string"


def test_citations_and_contexts(spark):
    rows = [
        (1, 1, "c1", "d1", 4, 0.5, "a.csv", None, 2, 7, 9, "p1", "u1", "label", "one  two\n" + "x" * 300), (1, 2, "c2", "d2", 0, 0.4, "b.pdf", "Scope", 3, 0, None, None, "u2", None, None),
        (1, 3, "c1", "d1", 4, 0.3, "a.csv", None, 2, 7, 9, "p1", "u1", "label", "again"), (2, 1, "c3", "d3", 1, 0.2, "c.txt", "", 0, None, None, "", "u3", None, "t"),
    ]
    found = spark.createDataFrame(rows, FOUND)
    c = {(r.item_id, r.place): r for r in citations.citations(found).collect()}
    assert set(c) == {(1, 1), (1, 2), (2, 1)}
    assert (c[1, 1].location, c[1, 1].page, c[1, 1].row) == ("row 7", 2, 7) and c[1, 1].snippet == "one two " + "x" * 212 + "..."
    assert (c[1, 2].location, c[1, 2].row, c[1, 2].snippet) == ("page 3", None, "") and (c[2, 1].location, c[2, 1].page) == ("", None)
    text = {r.item_id: r.context for r in citations.contexts(found.where("place < 3")).collect()}
    assert text[1].startswith("[1] file=a.csv rows 7-9 section=n/a parent_chunk_id=p1\nRetrieval summary label (not evidence): label\nRaw parent chunk evidence:\none  two\n")
    assert text[1].endswith("\n\n[2] file=b.pdf page 3 section=Scope parent_chunk_id=c2\nRetrieval summary label (not evidence): \nRaw parent chunk evidence:\n")
    assert text[2].startswith("[1] file=c.txt  section=n/a parent_chunk_id=c3\n")
    s = {(r.item_id, r.chunk_id): (r.document_id, r.chunk_index, r.score) for r in citations.with_sources(citations.citations(found), found.where("chunk_id = 'c2'")).collect()}
    assert s == {(1, "c1"): ("p1", 0, 0.0), (1, "c2"): ("d2", 0, 0.4), (2, "c3"): ("c3", 0, 0.0)}
    assert citations.contexts(found.limit(0)).count() == citations.citations(found.limit(0)).count() == 0


def test_conversation_context(spark):
    rows = [([(" User", " hi "), ("system", "x"), ("assistant", " "), ("assistant", "yes"), (None, "n"), ("user", None)],), ([],), (None,)]
    e = spark.createDataFrame(rows, "e array<struct<role:string,text:string>>")
    assert [r[0] for r in e.select(citations.conversation_context(F.col("e"))).collect()] == ["user: hi\nassistant: yes", citations.NO_CONVERSATION, citations.NO_CONVERSATION]
