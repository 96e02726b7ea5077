"""Importance resampling, the filter audit and best-fit packing against plain Python, on odd inputs too."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millwright.llm import best_fit, filter_audit, importance

R = random.Random(11)
WORDS = ["".join(R.choice("aeioustrnlABÉß") for _ in range(R.randint(1, 7))) for _ in range(150)]
PROSE = [" ".join(R.choice(WORDS) for _ in range(R.randint(15, 420))) for _ in range(25)]
TEXTS = [None, "", " \n\t ", "one", "É#É # & a", "x " * 40_000, "w" * 1_500_000 + " " + "w" * 1_500_000, "中文 中文\x00 中文\x00", *PROSE, PROSE[0], PROSE[0], PROSE[1] + "|"]
SCHEMA = "doc_id long, text string, lang string, part string, bin long, score long, n_words int, digest string"
LANGS = ["en", None, "", "fr"]


def rows():
    ids = [i if i % 7 else None for i in range(len(TEXTS))]
    ids[9] = ids[8]
    out = [(d, t, LANGS[i % 4], "p", 1, 2, 3, "d") for i, (d, t) in enumerate(zip(ids, TEXTS, strict=True))]
    return [*out, out[10], out[10]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("longest", [1, 3])
def test_importance(spark, docs, longest):
    target = spark.createDataFrame([(1, PROSE[2]), (2, None), (3, "One two. one TWO")], "item_id long, text string")

    def grams(text):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text)) if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 97 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    raw, wanted = (Counter(b for t in ts for b in grams(t)[1]) for ts in ([r[1] for r in rows()], [PROSE[2], "One two. one TWO"]))
    s, t = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 97) / ((raw[b] + 1) * (t + 97)))) for b in range(97)]
    want, able = [], []
    for i, text, *_ in rows():
        n, f = grams(text)
        h = int(hashlib.sha256(f"5:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        want.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        able.append(n >= 20)
    got = importance.resampled(docs, target, longest, 97, percent=40, seed=5).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(want)
    drawn = sorted((x for x, ok in zip(want, able, strict=True) if ok), key=lambda x: (-x[3], x[0] is None, x[0] or 0))[: 40 * sum(able) // 100]
    assert [tuple(r)[:4] for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))


def test_importance_ties_and_nothing(spark, docs, empty):
    same = spark.createDataFrame([(3, PROSE[0])] * 6 + [(None, PROSE[0])] * 4, "doc_id long, text string")
    got = importance.resampled(same, empty, percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4, 5] and len(got) == 10
    assert importance.resampled(empty, docs).count() == 0


def test_words_are_verified(monkeypatch):
    """Different words count as such even where all hashes agree."""
    monkeypatch.setattr(filter_audit, "_hashes", lambda raw, begin, end: np.zeros(len(begin), np.uint64))
    texts = ["ab ba ab cd", "", "ab", "ba ba", " x"]
    assert filter_audit.counts([t.encode() for t in texts])[1].tolist() == [3, 0, 1, 1, 1]


def test_transducer():
    texts = [t or "" for t in TEXTS]
    words, distinct, capitals, points, symbols = filter_audit.counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        assert (words[i], distinct[i], points[i]) == (len(w), len(set(w)), len(t)), i
        assert (capitals[i], symbols[i]) == (len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)))


def test_filter_audit(spark, docs, empty):
    labels = [(1, 1, 0), (1, 0, 1), (8, 1, None), (12, None, 1), (999, 1, 1), (None, 1, 1)]
    lowest = {}
    for d, t, *_ in rows():
        if d is not None:
            lowest[t or ""] = min(lowest.get(t or "", d), d)
    want = defaultdict(Counter)
    for d, t, lang, *_ in rows():
        text = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        e = text in lowest and (d is None or d > lowest[text])
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": e}
        good, toxic = (any(x[0] == d and x[k] == 1 for x in labels) and d is not None for k in (1, 2))
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                n, removed = want[lang or "", "".join(order), step], fails[f] and not gone
                n["redundant"] += fails[f] and gone
                gone = gone or fails[f]
                n["kept"] += not gone
                n["removed"] += removed
                n["unique_fails"] += fails[f] and sum(fails.values()) == 1
                n["good_lost"] += removed and good
                n["toxic_lost"] += removed and toxic
    shapley = Counter()
    for (part, order, step), n in want.items():
        shapley[part, order[step - 1]] += n["removed"]
    got = filter_audit.audit(spark, filter_audit.classes(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(got) == len(want) == 600 * 3
    for r in got:
        n = want[r.part, r.filter_order, r.step]
        assert {k: r[k] for k in n} == dict(n) and r.shapley == shapley[r.part, r.filter_order[r.step - 1]]
    assert filter_audit.audit(spark, filter_audit.classes(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_best_fit_places():
    assert best_fit.best_fit(np.array([5, 4, 3, 3, 5]), 8).tolist() == [0, 2, 1, 0, 1]
    assert len(best_fit.best_fit(np.zeros(0, np.int64), 8)) == 0
    with pytest.raises(ValueError):
        best_fit.best_fit(np.array([9]), 8)


def check_packing(got, given, most):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t, *_ in given:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), most):
            want[d, k // most, k, len(ids[k : k + most]), zlib.crc32(ids[k : k + most].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    filled = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= most
    return filled


@pytest.mark.parametrize("fan_in,group", [(8, 100_000), (2, 5)])
def test_packing(docs, empty, monkeypatch, fan_in, group):
    """Groups of five items make many rounds, each of which leaves bins that fit no better."""
    monkeypatch.setattr(best_fit, "FAN_IN", fan_in)
    monkeypatch.setattr(best_fit, "GROUP", group)
    filled = check_packing(best_fit.pack_best_fit(docs).collect(), rows(), 2048)
    if group > 5:
        assert sum(v <= 1024 for v in filled.values()) <= 1  # else two bins were one
    assert best_fit.pack_best_fit(empty).count() == 0


def test_unmergeable(spark):
    """Pieces of over half a sequence each: rounds end, nothing is lost."""
    given = [(i, "tree " * 1100) for i in range(40)]
    got = best_fit.pack_best_fit(spark.createDataFrame(given, "doc_id long, text string").repartition(7)).collect()
    assert len(check_packing(got, given, 2048)) == 40
