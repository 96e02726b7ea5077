"""Keyword search against plain loops."""

from __future__ import annotations

import random

import pytest

from millwright.operators import blocked, hybrid

R = random.Random(12)
WORDS = ["pump", "seal", "leak", "p-1", "p-12", "bearing", "wear", "motor", "oil"]
CHUNK = "chunk_id int, file_name string, row_start int, summary string, text string, questions string, tags array<string>"


def text():
    return R.choice([None, "", " ".join(R.choice(WORDS) for _ in range(R.randint(1, 6)))])


@pytest.mark.parametrize("product_bytes", [16 << 20, 500])
@pytest.mark.parametrize("most", [10_000, 3])
def test_keyword_topk(spark, monkeypatch, product_bytes, most):
    monkeypatch.setattr(blocked, "PRODUCT_BYTES", product_bytes)
    monkeypatch.setattr(blocked, "QUERY_BYTES", 1 << 20 if most == 10_000 else 900)
    chunks = [(i, R.choice(["a.txt", "b.txt"]), R.choice([None, 0, 1, 2]), text(), text(), text(), R.choice([None, [], ["p-1"], ["P-12", "P-1", "p-1"]])) for i in range(70)]
    asked = [(i, f"what about the {R.choice(WORDS)} and {R.choice(WORDS)} of P-1{R.choice(['', '2'])}") for i in range(12)] + [(99, ""), (100, "nothing alike")]
    c, q = spark.createDataFrame(chunks, CHUNK).repartition(4), spark.createDataFrame(asked, "item_id int, question string")
    want = []
    for r in hybrid.with_terms(q).collect():
        scored = []
        for i, name, row, *texts, tags in chunks:
            low = [(x or "").lower() for x in texts]
            worth = sum(w for t in r.tokens for x, w in zip(low, hybrid.TOKEN, strict=True) if t in x) + sum(w for t in r.assets for x, w in zip(low, hybrid.ASSET, strict=True) if t.lower() in x)
            worth += hybrid.TAGGED * len({t.upper() for t in tags or []} & set(r.assets))
            if worth:
                scored.append((-worth, tuple(-ord(x) for x in name), row or 0, i))
        want += [(r.item_id, n, i, -w) for n, (w, _, _, i) in enumerate(sorted(scored)[:5], 1)]
    got = [(r.item_id, r.rank, r.chunk_id, r.score) for r in hybrid.keyword_topk(c, q, 5).collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
    assert hybrid.keyword_topk(c, q.limit(0), 5).count() == hybrid.keyword_topk(c.limit(0), q, 5).count() == 0
