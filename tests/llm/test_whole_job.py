"""The operators do the whole job: no size, id or wording makes them leave some of it."""

from __future__ import annotations

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millwright.llm import common, decontaminate, line_dedup, quality
from millwright.llm.tokens import Encoder


CLEAN = [f"{w} stands here with words of its own, {w * 2} after {w * 3} and then {w} again, so that {w}{i} is like no other" for i, w in enumerate(("alder", "brook", "cedar", "dune", "ember", "fjord"))]


def test_near_dedup_by_row(spark):
    rows = [(None, CLEAN[0]), (None, CLEAN[1]), (1, CLEAN[2]), (1, CLEAN[3]), (2, CLEAN[3]), (2, CLEAN[4]), (None, CLEAN[2]), (3, CLEAN[5]), (3, CLEAN[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(0, CLEAN[0]), (0, CLEAN[1]), (1, CLEAN[2]), (1, CLEAN[3]), (2, CLEAN[4]), (3, CLEAN[5])])


def test_decontamination_by_row(spark):
    docs = common.stored(spark.createDataFrame([(None, CLEAN[0]), (None, CLEAN[1]), (1, CLEAN[2]), (1, CLEAN[0]), (2, CLEAN[3])], "doc_id long, text string"), "docs")
    items = spark.createDataFrame([(7, CLEAN[0])], "item_id long, text string")
    got = decontaminate.decontaminated(docs, items)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, CLEAN[1]), (1, CLEAN[2]), (2, CLEAN[3])]


def test_line_dedup_by_row(spark):
    line = "This is one long line that many documents share."
    own = [f"{x}\n{y}" for x, y in zip(CLEAN[:3], CLEAN[3:], strict=True)]
    rows = [(None, f"{own[0]}\n{line}"), (None, f"{line}\n{own[1]}"), (1, f"{line}\n{own[2]}"), (1, CLEAN[0][::-1]), (1, f"{CLEAN[1][::-1]}\n{line}")]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "docs")
    got = line_dedup.deduplicated(docs).collect()
    texts = sorted(r.text for r in got)
    assert texts == sorted([f"{own[0]}\n{line}", own[1], own[2], CLEAN[0][::-1], CLEAN[1][::-1]])
    assert sorted(x.line_no for r in got for x in r.removed) == [0, 0, 1] and {x.first_doc for r in got for x in r.removed} == {None}


def test_ids_of_special_tokens():
    r = random.Random(3)
    marks = ["a", "é", "\n", " ", "  ", "\t", "1", ".", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\xa0", "中", "\r\n", "'s"]
    texts = ["a <|endoftext|> b", *("".join(r.choice(marks) for _ in range(r.randint(0, 12))) for _ in range(3000))]
    for name, words_only in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        fresh = Tokenizer.from_file(public_tokenizers.path(name))
        assert [x.tolist() for x in Encoder(name, words_only, cached=500).encode(texts)] == [fresh.encode(x, add_special_tokens=False).ids for x in texts]


def test_quality_without_common_words(spark):
    """Texts of the same letters: only their common words tell them from their language."""
    r = random.Random(5)
    rare = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    common_words = {lang: ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 5))) for _ in range(24)] for lang in ("en", "de")}

    def text(n, lang):
        return " ".join(r.choice(common_words[lang]) if lang and r.random() < 0.25 else r.choice(rare) for _ in range(n))

    rows = [(i, text(r.randint(60, 900), lang), lang) for i, lang in enumerate(["en", "de"] * 60)]
    odd = [(1000, text(2000, None), "en"), (1001, text(80, None), "de"), (1002, text(1500, "de"), "en"), (1003, text(1500, "en"), "de")]
    got = {x.doc_id: x.kept for x in quality.assessed(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert [i for i, kept in got.items() if not kept] == [1000, 1001, 1002, 1003]
