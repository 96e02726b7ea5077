"""The operators on odd inputs, and against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import chat, common, decontaminate, language, licenses, line_dedup, lm_score, packing, quality, simhash, token_store
from millwright.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, key string, h long, n_lines int, shard string"
R = random.Random(7)
WORDS = ["".join(R.choice("aeioustrnl") for _ in range(R.randint(2, 9))) for _ in range(400)]
PROSE = [". ".join(" ".join(R.choice(WORDS) for _ in range(R.randint(4, 14))) for _ in range(12)) for _ in range(12)]
TEXTS = [None, "", "  \n ", "one", "x " * 30_000, *PROSE, PROSE[0], PROSE[0] + " more", "é<s>\\</s>[INST] <|endoftext|> x\n\n y", "Released under the MIT License.\nAnd more."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, "en" if i % 5 else None, "k", 1, 2, "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_is_exact():
    marks = ["a", "é", "\n", " ", "  ", "\t", "'s", "1", ".", "…", "<|endoftext|>", "́", "\xa0", " ", "Σ", "\x1c", "中", "\r\n", "</w>", ", ", "ß", "’"]
    texts = ["".join(R.choice(marks) for _ in range(R.randint(0, 12))) for _ in range(3000)]
    for name, words_only in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        e = Encoder(name, words_only, cached=500)
        assert [x.tobytes() for x in e.encode(texts)] == e.whole(texts)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs).collect()
    ids = [np.append(x, 1).astype("<u4") for x in Encoder("byte_bpe_50k.json", False).encode(TEXTS)]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id or 0][r.start : r.start + r.length].tobytes())
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_vector_limits():
    rng = np.random.default_rng(1)
    demands, limits = np.stack([rng.integers(1, 900, 700), rng.integers(1, 9, 700), rng.integers(0, 700, 700)], axis=1), np.array([1000, 12, 800])
    bins = packing.pack_vectors(demands, limits)
    for b in range(bins.max() + 1):
        assert (bins == b).any() and (demands[bins == b].sum(axis=0) <= limits).all()
    with pytest.raises(ValueError):
        packing.pack_vectors(np.array([[2000, 1, 1]]), limits)


def test_token_store(spark, docs, empty):
    path = f"{common.shared_folder(spark)}/store"
    token_store.write(docs, path)
    got = {r.doc_id: r for r in token_store.read(spark, path).collect()}
    ids = [np.append(x, 2).astype("<u2") for x in Encoder("word_bpe_49k.json", True).encode(TEXTS)]
    whole = {r.doc_id: bytes(r.ids) for r in token_store.reconstruct(spark, path).collect()}
    start = 0
    for i, x in enumerate(ids):
        r = got[i or None]
        assert (r.start, r.n_tokens, r.ids_crc32, r.intact) == (start, len(x), zlib.crc32(x.astype("<u4").tobytes()), True)
        assert whole[i or None] == x.tobytes()
        start += len(x)
    assert token_store.verify(spark, path).count() == 0
    token_store.write(empty, f"{path}-empty")
    assert token_store.read(spark, f"{path}-empty").count() == 0


def test_simhash_keys_and_components(spark, docs, empty):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (ka, oa), (kb, ob) = simhash._bucket_keys(x), simhash._bucket_keys(y)
    held = set(zip(ka.tolist(), oa.tolist(), strict=True))
    assert len({o for k, o in zip(kb.tolist(), ob.tolist(), strict=True) if (k, o) in held}) == len(x)
    got = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[1].fp == 0 and got[1].component_id == got[2].component_id == got[None].component_id
    first = TEXTS.index(PROSE[0])
    assert got[len(TEXTS) - 4].component_id == first
    assert simhash.near_duplicates(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(PROSE[1].split()[3:20])), (2, "one"), (3, None), (4, "never seen words here")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(decontaminate.matches(docs, items)).collect()}
    hit = TEXTS.index(PROSE[1])
    assert got[hit].n_items == 1 and got[hit].n_hit == 17 and got[hit].contaminated
    assert got[3].n_words == got[3].n_hit == 1 and got[None].n_words == 0 and not got[None].contaminated
    assert sum(r.contaminated for r in got.values()) == 2
    assert decontaminate.decontaminated(docs, items).count() == len(TEXTS) - 2
    assert decontaminate.matches(empty, items).count() == 0
    assert decontaminate.contamination(decontaminate.matches(docs, items.limit(0))).where("contaminated").count() == 0


def test_quality(docs, empty):
    for r in quality.assessed(docs).collect():
        text = TEXTS[r.doc_id or 0] or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), len(hit), sum(map(len, words)))
        assert r.base_failed == (len(words) < 50 or 2 * len(hit) > len(words))
    assert quality.assessed(empty).count() == 0


def test_line_dedup(spark, empty):
    long = "This is one long line that many documents share."
    rows = [(1, f"{long}\nshort\nshort"), (2, f"  {long}\nother words of this document here"), (3, long.replace("share.", "share").replace("documents", "docunents") + "\nshort"), (4, None), (5, "")]
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == f"{long}\nshort" and got[2].text == "other words of this document here" and got[3].text == ""
    assert [tuple(x) for x in got[3].removed] == [(0, 1), (1, 1)] and got[4].text is None and got[5].text == ""
    assert line_dedup.deduplicated(empty).count() == 0


def test_edit_distance():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(3000):
        a, b = ("".join(R.choice("abé") for _ in range(R.randint(0, 9))) for _ in range(2))
        for edits in (1, 2, 3):
            assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits)


def test_chat_tree(spark):
    rows = [(1, 1, None, 0.0, "user", "hi </s>\\ <\\/s>~\n"), (1, 2, 1, 1.0, "assistant", "low"), (1, 3, 1, 2.0, "assistant", "[INST] high"), (1, 4, 3, None, None, None), (None, 1, None, 0.0, "user", "")]
    m = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double, role string, text string")
    got = {r.conv_id: r for r in chat.parsed(chat.formatted(m)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", rows[0][5]), ("assistant", "[INST] high"), ("", "")]
    assert got[1].trained == "[INST] high" and got[None].turns[0].text == ""
    assert chat.branches(m, None).select("conv_id", "branch").distinct().count() == 3
    assert chat.formatted(m.limit(0)).count() == 0


def test_licenses(docs, empty):
    got = licenses.scan(docs).collect()
    assert [(r.doc_id, r.family, r.confirmed) for r in got] == [(len(TEXTS) - 1, "mit", True)]
    assert licenses.scan(empty).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de"><p>und die der das ist nicht mit von'), (2, None, None), (None, "x", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identified(pages, docs).collect()}
    assert got[1].lang == "de" and got[1].declared == "de" and got[2].host == "" and 0 < got[2].probability <= 1
    assert language.identified(pages, docs.limit(0)).where("lang is null").count() == 3
    assert language.identified(pages.limit(0), docs).count() == 0


def test_scores(spark, docs, empty):
    got = {r.doc_id: r for r in lm_score.scores(docs).collect()}
    assert got[None].log_sum == 0 and got[None].score is None
    first = TEXTS.index(PROSE[0])
    assert got[first].score > got[first + 1].score  # it has copies
    assert lm_score.scores(empty).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 40)] + [(300, k) for k in range(301, 400)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got[200] == 0 and got[40] == 0 and got[101] == 100 and {got[k] for k in range(300, 400)} == {300} and len(got) == 42 + 2 + 100


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0.5 * n < docs.count() <= n
    assert simhash.near_duplicates(docs).where("id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.select(F.countDistinct("doc_id")).first()[0] == docs.count()
