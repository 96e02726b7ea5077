"""Blocked search against plain loops, and asset search by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import blocked, causes, search

R = random.Random(3)


def by_loops(rows, queries, k, rules):
    out = []
    for q, query, tag in queries:
        found = []
        for i, vector, label, text in rows:
            if rules.skip_same and i == q or rules.only and tag and tag.lower() not in (text or "").lower().split():
                continue
            same = vector is not None and query is not None and len(vector) == len(query)
            n = np.linalg.norm(vector) * np.linalg.norm(query) if same else 0
            units = round(abs(np.dot(vector, query) / n) * 10**rules.digits) * (1 if np.dot(vector, query) >= 0 else -1) if n else 0
            if tag and tag.lower() in (text or "").lower().split():
                units = min(10**rules.digits, units + round(rules.boost * 10**rules.digits))
            found.append((-units, i, label))
        labels, kept = {}, []
        for units, i, label in sorted(found, key=lambda x: x[:2]):
            labels[label] = labels.get(label, 0) + 1
            if rules.cap is None or labels[label] <= rules.cap:
                kept.append((q, len(kept) + 1, -units / 10**rules.digits, i))
        out += kept[:k]
    return sorted(out)


@pytest.mark.parametrize("rules", [blocked.Rules(), blocked.Rules(cap=2, skip_same=True), blocked.Rules(digits=2, cap=1, boost=0.15), blocked.Rules(digits=3, only=True)])
@pytest.mark.parametrize("product_bytes", [16 << 20, 600])
def test_nearest(spark, monkeypatch, rules, product_bytes):
    """Many equal vectors and labels, zero, null and short ones; slices of few rows; blocks of few queries."""
    monkeypatch.setattr(blocked, "PRODUCT_BYTES", product_bytes)
    kinds = [[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 0.0], None, [1.0, 1.0], [0.0, -1.0, 3.0]]
    rows = [(i, kinds[i % 6] if i % 3 else [R.gauss(0, 1) for _ in range(3)], R.choice("aab"), R.choice(["x p-1 y", "P-11", None, "P-1"])) for i in range(90)]
    queries = [(i, kinds[i % 6] if i % 4 else [R.gauss(0, 1) for _ in range(3)], R.choice(["P-1", None, "p-11"])) for i in range(25)]
    r = spark.createDataFrame(rows, "id long, vector array<double>, label string, text string").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, query array<double>, tag string")
    want = by_loops(rows, queries, 4, rules)
    for most in (10_000, 6):
        got = blocked.nearest(r, q, 4, ["id"], rules, most_queries=most)
        assert sorted((x.query_id, x.place, round(x.score, 6), x.id) for x in got.collect()) == [(q, p, round(s, 6), i) for q, p, s, i in want]
    assert blocked.nearest(r.limit(0), q, 4, ["id"], rules).count() == blocked.nearest(r, q.limit(0), 4, ["id"], rules).count() == 0


def test_ties_over_many_columns(spark):
    rows = spark.createDataFrame([(x, d, c, [1.0]) for x, d, c in [("a", "d2", 0), ("b", "d1", 5), ("c", "d1", 2), ("d", None, 1)]], "id string, doc string, at int, vector array<double>")
    q = spark.createDataFrame([("q", [2.0])], "query_id string, query array<double>")
    got = blocked.nearest(rows, q, 3, ["doc", "at"]).collect()
    assert [x.id for x in sorted(got, key=lambda x: x.place)] == ["c", "b", "a"]


def test_sparse(spark):
    schema = "id long, vector struct<at: array<int>, value: array<double>>"
    rows = spark.createDataFrame([(1, ([0, 5], [1.0, 1.0])), (2, ([5], [2.0])), (3, ([], [])), (4, None)], schema)
    q = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query")).where("id <= 2")
    got = {(x.query_id, x.id): x.score for x in blocked.nearest(rows, q, 9, ["id"], dimension=8).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.7071, (1, 3): 0.0, (1, 4): 0.0, (2, 1): 0.7071, (2, 2): 1.0, (2, 3): 0.0, (2, 4): 0.0}


def test_whole_words():
    got = blocked.whole_words(["see P-1.", "P-10 and xp-1", "éP-1", "p-1_", "P-1-2", None], ["P-1", "P-1-2"])
    assert got.tolist() == [[True, False], [False, False], [False, False], [False, False], [True, True], [False, False]]


CHUNKS = "document_id string, chunk_id string, chunk_index int, filename string, text string, model string"
ASKED = "question_id int, question string, tag string, model string"


def test_search(spark):
    """Five equal chunks of one document: three stay. The tag's chunk comes first; another model's never."""
    rows = [("d1", f"c{i}", i, "a.txt", "pump seal leak", "m") for i in range(5)]
    rows += [("d2", "x", 0, "b.txt", "pump seal of P-7 leak", "m"), ("d3", "y", 0, "c.txt", "pump seal leak", "old"), ("d4", "z", 0, "d.txt", None, "m"), ("d5", "x", 1, "e.txt", "pump seal", "m"), ("d6", "w", 0, "f.txt", "nothing alike", "m")]
    asked = spark.createDataFrame([(1, "pump seal leak", "p-7", "m"), (2, "pump seal leak", None, "m"), (3, "", None, "m"), (4, "pump seal leak", None, "new")], ASKED)
    found = {}
    for r in sorted(search.search(spark.createDataFrame(rows, CHUNKS), asked, 5).collect(), key=lambda r: (r.question_id, r.place)):
        found.setdefault(r.question_id, []).append(r.chunk_id)
    assert found.keys() == {1, 2}
    assert found[2] == ["c0", "c1", "c2", "x", "w"] and set(found[1]) == {"c0", "c1", "c2", "x", "w"}


def test_pool_is_cut_before_documents_are_capped(spark):
    """25 equal chunks of one document fill the pool of 3 * 5 + 10, so that only three are left."""
    rows = [("d1", f"c{i}", i, "a.txt", "seal leak", "m") for i in range(25)] + [("d2", "x", 0, "b.txt", "seal leak too", "m")]
    got = search.search(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([(1, "seal leak", None, "m")], ASKED)).collect()
    assert sorted(r.chunk_id for r in got) == ["c0", "c1", "c2"]


def test_answers_and_evidence(spark):
    rows = spark.createDataFrame([("d1", "c1", 0, "notes.txt", "why the pump failed", "m"), ("d2", "c2", 0, "inspection_1.txt", "why the pump failed C-12", "m")], CHUNKS)
    asked = spark.createDataFrame([(1, "why the pump failed", "P-1", "m"), (2, "", "P-1", "m")], ASKED)
    a = {r.question_id: r for r in search.answers(rows, asked).collect()}
    assert a[1].intent == "failure_rca" and a[1].confidence == "high" and a[1].retrieved == 2 and a[1].related == ["C-12"]
    assert a[1].answer.startswith('Based on 2 retrieved chunk(s) [failure_rca], the most relevant evidence for "why the pump failed" is: "why the pump')
    assert a[2].answer == search.NO_CONTEXT and a[2].confidence == "low" and a[2].retrieved == 0 and a[2].related == []
    scores = {r.chunk_id: r.score for r in search.evidence(rows, asked).collect()}
    assert scores == {"c1": 1.0, "c2": pytest.approx(0.816497 + 0.08)}


def test_causes_name_their_asset(spark):
    rows = spark.createDataFrame([("d1", "c1", 0, "rca.txt", "P-1 vibration after seal replacement", "m"), ("d2", "c2", 0, "rca.txt", "P-12 vibration bearing", "m")], CHUNKS)
    symptoms = spark.createDataFrame([("P-1", "high vibration", "m"), ("P-9", "high vibration", "m"), ("P-1", "odd smell", "m"), ("P-1", "leak", "none")], "tag string, symptom string, model string")
    got = {(r.tag, r.symptom, r.number): r for r in causes.retrieved_causes(symptoms, rows).collect()}
    assert set(got) == {("P-1", "high vibration", 1), ("P-9", "high vibration", None), ("P-1", "odd smell", 0), ("P-1", "leak", None)}
    assert got["P-1", "high vibration", 1].evidence == ["c1"] and got["P-1", "high vibration", 1].confidence == 0.42
    assert "did not reference this asset" in got["P-9", "high vibration", None].summary and got["P-1", "leak", None].summary.startswith("No documents were retrieved for P-1")
    assert got["P-1", "odd smell", 0].summary == "Analysis of 1 evidence item(s) retrieved for P-1 indicates 1 likely cause(s) for 'odd smell' (top confidence 0.25)."
