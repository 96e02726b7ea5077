"""Search without dealing its chunks: places made where a row is read, rows that share an id, texts of what is found."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millwright.operators import causes, hybrid, search
from millwright.plans import catalog
from millwright.sources import star

SF = "/root/testdata/sf0.001"
CHUNKS = "document_id string, chunk_id string, chunk_index int, filename string, text string, model string"
ASKED = "question_id int, question string, tag string, model string"


def test_places_are_those_of_the_counts(spark):
    texts = ["", "  ", "seal SEAL leak", "Straße straße İstanbul ΣΑΣ", "a_b 12 १२ ́x a‍b", "日本語 テキスト 😀", "pump\npump\tpump", "٣ ² ½ ⓐ Ⅷ"]
    rows = [(i, t) for i, t in enumerate([*texts, *(" ".join(f"w{j * i % 977}" for j in range(300)) for i in range(2500))])]
    docs = spark.createDataFrame(rows, "id long, text string")
    said = search._with_words(docs).toArrow().to_batches()
    run, got = hybrid.filled(), {}
    for part in map(run, said):
        got |= {i: (v["at"], v["value"]) for i, v in zip(part.column("id").to_pylist(), part.column("vector").to_pylist(), strict=True)}
    assert got == {r.id: (r.places.at, r.places.value) for r in hybrid.hashed(docs).collect()}
    assert len(got) == 2506 and got[2][1] != got[6][1]


def test_words_that_cancel_leave_no_row(spark):
    """Two words with one place and other signs."""
    found, known = {}, {}
    for i in range(5000):
        p = hybrid.signed_places(pa.array([[f"w{i}"]], pa.list_(pa.string())), hybrid.DIMENSION, known)[0][0].as_py()
        found.setdefault(p["at"][0], {}).setdefault(p["value"][0], f"w{i}")
    both = next(x for x in found.values() if len(x) == 2)
    docs = spark.createDataFrame([(1, " ".join(both.values())), (2, "seal")], "id long, text string")
    part = hybrid.filled()(search._with_words(docs).toArrow().combine_chunks().to_batches()[0])
    assert part.column("id").to_pylist() == [r.id for r in hybrid.hashed(docs).collect()] == [2]


@pytest.mark.parametrize("most", [0, 1, 100_000])
def test_rows_that_share_an_id(spark, monkeypatch, most):
    """They are one chunk with the words of all, also if a key is null; whether the shared ids are sent or not."""
    monkeypatch.setattr(search, "MOST_SENT", most)
    rows = [("d1", "c1", 0, "a.txt", "pump seal", "m"), ("d1", "c1", 0, "a.txt", "leak", "m"), ("d2", "c2", None, "b.txt", "pump", "m"), ("d2", "c2", None, "b.txt", "seal leak", "m"), ("d3", "c3", 1, "c.txt", "pump", "m"), ("d1", "c1", 0, "a.txt", "oil", "other"), ("d4", "c4", 0, "d.txt", None, "m")]
    asked = spark.createDataFrame([(1, "pump seal leak", None, "m")], ASKED)
    got = {r.chunk_id: r.score for r in search.search(spark.createDataFrame(rows, CHUNKS), asked).collect()}
    assert got == {"c1": 1.0, "c2": 1.0, "c3": pytest.approx(0.57735)}
    said = search.evidence(spark.createDataFrame(rows, CHUNKS), asked).collect()
    assert sorted(r.chunk_id for r in said) == ["c1", "c3"]  # a chunk without an index has no text to join


def test_same_evidence_sent_or_dealt(spark, monkeypatch):
    take = lambda: sorted(causes.retrieved_causes(star.symptoms(spark, SF), star.records(spark, SF)).collect(), key=str)
    sent = take()
    monkeypatch.setattr(search, "MOST_SENT", 5)
    assert sent == take() and len(sent) > 40


def test_chunks_are_not_dealt(spark):
    """Neither their words (16 million for 0.1 GB before) nor their texts go through an exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = star.records(spark, SF).select(F.struct("document_id", "chunk_id").alias("id"), "text")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(search._with_words(keyed))
        assert "hashpartitioning(chunk_id" not in plan(catalog.QUERIES["retrieved_causes"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
