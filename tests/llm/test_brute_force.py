"""Operators against plain Python that does the same the long way, on whole small tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millwright.llm import chat, common, decontaminate, language, licenses, line_dedup, lm_score, packing, quality, simhash, token_store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_scores(docs, texts):
    words = {i: [w for w in re.split("[\x20\x09-\x0d]+", lowered(t)) if w] for i, t in texts.items()}
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    total = {k: Counter(g for w in words.values() for g in grams(w, k)) for k in (1, 2, 3)}
    n_words = sum(map(len, words.values()))
    got = {r.doc_id: r for r in lm_score.scores(docs).collect()}
    for i, w in words.items():
        own = {k: Counter(grams(w, k)) for k in (1, 2, 3)}
        others = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        want = 0.0
        for at in range(len(w)):
            s = None
            for k in (3, 2):
                if at < k - 1:
                    continue
                g = tuple(w[at - k + 1 : at + 1])
                if others(g) > 0:
                    s = (s or 0.0) + math.log(others(g) / others(g[:-1]))
                    break
                s = (s or 0.0) + math.log(0.4)
            else:
                s = (s or 0.0) + math.log(max(others((w[at],)), 0.5) / max(1, n_words - len(w)))
            want += s
        assert got[i].log_sum == pytest.approx(want, rel=1e-6, abs=1e-4) and got[i].n_words == len(w)


def test_large_counts():
    """A count beyond 2^32 comes back as it is."""
    for n in ([], [5, 0], [(1 << 32) + 5, 7]):
        assert lm_score._counted(lm_score._counts(np.array(n, np.int64))).tolist() == n


HELD_OUT = [
    "MIT License", "GNU GPL v3 only", "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: BSD-2-Clause", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, express or implied, including the warranties of merchantability",
    "Redistributions of source code must retain the copyright notice and this list", "This file is part of a program distributed under the terms of the GNU General Public License version 2", "Code is available under the MIT licence, see COPYING", "Copyright (c) 2021 The Authors. All rights reserved.",
    "Content is available under CC BY-SA 4.0 unless noted", "Published under a Creative Commons Attribution licence", "Subject to the Mozilla Public License 2.0", "You may redistribute it under the GNU Lesser General Public License", "Permission is hereby granted, free of charge, to anyone obtaining\na copy of this software to deal in it without restriction",
    "The database is dedicated to the public domain under CC0 1.0",
]
CLEAN = ["The committee shall grant permission to any person to attend the meeting free of charge", "She got her driving licence in May.", "The warranty on the pump ended last year.", "He reserved a table for four.", "Public transport is free of charge for students.", "All copies of the book were sold out."]


def test_licence_recall(spark):
    """On a table with enough paragraphs for the limit's share of false alarms; of sf0.001 the 200 documents aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(HELD_OUT + CLEAN)], "doc_id long, text string")
    got = {r.doc_id for r in licenses.scan(docs.select("doc_id", "text").union(planted)).where("doc_id < 0").collect()}
    assert sum(-1 - i in got for i in range(len(HELD_OUT))) >= 0.9 * len(HELD_OUT)
    assert not any(-1 - i in got for i in range(len(HELD_OUT), len(HELD_OUT + CLEAN)))


def test_contamination(spark, docs, texts):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    items = {str(r.item_id): split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    windows = defaultdict(set)
    for i, w in items.items():
        for at in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[at : at + 13])].add(i)
    sizes = {len(x) for x in windows}
    got = {r.doc_id: r for r in decontaminate.contamination(decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))).collect()}
    hit_docs = 0
    for i, t in texts.items():
        w, hit, found = split(t), set(), set()
        for k in sizes:
            for at in range(len(w) - k + 1):
                if (g := tuple(w[at : at + k])) in windows:
                    hit |= set(range(at, at + k))
                    found |= windows[g]
        r = got[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
        hit_docs += bool(hit)
    assert hit_docs > 0


def test_cycles(spark):
    rows = [(1, 1, None), (1, 2, 1), (2, 1, 3), (2, 2, 1), (2, 3, 2), (2, 4, 1), (3, 1, 1), (3, 2, 1), (3, 3, None), (3, 4, 3)]
    m = spark.createDataFrame([(*r, 1.0, "user", str(r)) for r in rows], "conv_id long, node long, parent long, score double, role string, text string")
    got = chat.branches(m, None)
    assert sorted((r.conv_id, r.branch, r.place, r.node) for r in got.collect()) == [(1, 2, 0, 1), (1, 2, 1, 2), (3, 4, 0, 3), (3, 4, 1, 4)]


def test_branches(spark):
    """Trees of random replies: every path to a leaf, ranked by its sum, ties by the leaf."""
    r, rows = random.Random(3), []
    for conv in range(12):
        rows += [(conv, n, r.randint(1, n - 1) if n > 1 else None, float(r.randint(-2, 2))) for n in range(1, r.randint(2, 30))]
    m = spark.createDataFrame([(*x, "user", "t") for x in rows], "conv_id long, node long, parent long, score double, role string, text string")
    want = set()
    for conv in range(12):
        up, score = {n: p for c, n, p, _ in rows if c == conv}, {n: s for c, n, _, s in rows if c == conv}
        paths = []
        for leaf in up.keys() - set(up.values()):
            path = [leaf]
            while up[path[-1]]:
                path.append(up[path[-1]])
            paths.append((-sum(score[n] for n in path), leaf, path[::-1]))
        want |= {(conv, leaf, rank, place, n) for rank, (_, leaf, path) in enumerate(sorted(paths)[:2], 1) for place, n in enumerate(path)}
    assert {(x.conv_id, x.branch, x["rank"], x.place, x.node) for x in chat.branches(m, 2).collect()} == want


def test_visible_text():
    assert language.visible("<html LANG=de-AT><p>a<script>x</script>b<!-- c --><nav>d</nav >e<br>f")[0].split() == ["a", "b", "e", "f"]
    assert language.visible("<html LANG=de-AT>")[1] == "de" and language.visible("a < b")[0].split() == ["a", "<", "b"]
    began = time.time()
    for bad in ("<script>", "<!--", "<", "<nav", "<html "):
        language.visible(bad * 40_000)
    assert time.time() - began < 5


def test_language_accuracy(spark, docs):
    """Documents that the model isn't fitted on, as pages without a declared language or a telling host."""
    held = docs.where("lang is not null and length(text) > 200 and doc_id % 5 = 0")
    pages = held.select(F.col("doc_id").alias("page_id"), F.lit("http://x.example/").alias("url"), F.concat(F.lit("<html><body><p>"), "text", F.lit("</p>")).alias("html"))
    got = {r.page_id: r.lang for r in language.identified(pages, docs.where("doc_id % 5 <> 0")).collect()}
    right = [got[r.doc_id] == r.lang for r in held.collect()]
    assert len(right) > 10 and sum(right) >= 0.95 * len(right)


def test_common_host(spark, docs):
    pages = spark.createDataFrame([(i, f"http://{'big.example.co.uk' if i % 3 else f'h{i}.example.de'}/x", "<p>the and of that which with from") for i in range(900)], "page_id long, url string, html string")
    got = language.identified(pages, docs).collect()
    assert len(got) == 900 and {r.lang for r in got} == {"en"} and language.domain_of("big.example.co.uk") == "example.co.uk"


CLASHING = "doc_id long, text string, lang string, words string, last string, lines string, _row string, gone string, copy_id string, n_lines string, `end` string"


def test_clashing_columns(spark):
    prose = " ".join(f"the word{i} of and {i}" for i in range(30))
    rows = [(i, f"{prose} {i}\nown line number {i} here", "en", *[f"{c}{i}" for c in "abcdefgh"]) for i in range(4)]
    given = common.stored(spark.createDataFrame(rows, CLASHING), "clashing")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert out.columns == given.columns, name
        for r in out.collect():
            assert tuple(r)[2:] == rows[r.doc_id][2:], name
        assert stage(spark, given.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, given, SF).count() == 4
    kept = {r.doc_id: r for r in quality.assessed(given).collect()}
    assert kept[1].words == "a1" and kept[1].n_words == 156


def test_quality_counts(docs, texts):
    for r in quality.assessed(docs).collect():
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == len(re.findall("[#*$%&|<>]", texts[r.doc_id] or ""))
        assert not (r.base_failed and r.kept) and 0 <= r.char_distance <= 1 and 0 <= r.word_distance <= 1


def test_store_corruption(spark, docs):
    """A chunk, a recipe and a root that were changed are each told."""
    path = f"{common.shared_folder(spark)}/store-{time.time_ns()}"
    token_store.write(docs.where("doc_id < 40"), path)
    n = token_store.read(spark, path).count()
    assert token_store.read(spark, path).where("intact").count() == n
    chunk = spark.read.parquet(f"{path}/content").where("kind = 'chunk'").orderBy("key").first()
    users = spark.read.parquet(f"{path}/recipes").where(F.array_contains("chunks", F.lit(bytearray(chunk.key)))).count()

    def changed(table, column, of, value):
        at = f"{path}/{table}"
        whole = common.stored(spark.read.parquet(at), "whole")
        bad = whole.withColumn(column, F.when(of, value).otherwise(F.col(column)))
        bad.write.mode("overwrite").parquet(at, partitionBy="kind" if table == "content" else None)
        broken = n - token_store.read(spark, path).where("intact").count()
        whole.write.mode("overwrite").parquet(at, partitionBy="kind" if table == "content" else None)
        return broken

    assert changed("content", "ids", F.expr("kind = 'chunk'") & (F.col("key") == F.lit(bytearray(chunk.key))), F.lit(b"\x01\x00")) == users
    assert changed("recipes", "doc_id", F.col("doc_id") == 7, F.lit(1007)) >= 1
    assert changed("manifest", "root", F.lit(True), F.lit(b"x")) == n
    assert token_store.read(spark, path).where("not intact").count() == 0


def test_fingerprints_and_links(docs, texts):
    def plain(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", lowered(t)) if x]
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    fp = {i: plain(t) for i, t in texts.items()}
    component = {i: i for i in fp}
    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4 and component[a] != component[b]:
            low, high = sorted((component[a], component[b]))
            component = {i: low if c == high else c for i, c in component.items()}
    got = simhash.near_duplicates(docs).collect()
    assert {r.id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (fp[i], component[i]) for i in fp}


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def one_statement(a, b):
    """Words (base lines have neither digits nor signs) differ by one edit or trade of neighbours inside long ones."""
    x, y = a.lower().split(), b.lower().split()
    if len(x) != len(y):
        return False
    for v, w in zip(x, y, strict=True):
        traded = any(v[:i] + v[i + 1] + v[i] + v[i + 2 :] == w for i in range(len(v) - 1))
        if v != w and not (min(len(v), len(w)) >= 6 and v[0] == w[0] and v[-1] == w[-1] and (traded or distance(v, w) <= 1)):
            return False
    return True


APART = [
    ("The patient was given 90 mg of the drug daily", "The patient was given 10 mg of the drug daily"), ("Total paid on 2024-01-06 was 900 dollars", "Total paid on 2024-01-05 was 300 dollars"), ("The vote was now carried by the house", "The vote was not carried by the house"),
    ("It is legal to park there after ten", "It is illegal to park there after ten"), ("Values of a < b are reported below", "Values of a > b are reported below"), ("The limit is 1.5 bar at the inlet valve", "The limit is 15 bar at the inlet valve"), ("Sales will increase in the next quarter", "Sales will decrease in the next quarter"),
]
ALIKE = [("The committee approved the report at once", "The comittee approved the report at once"), ("All documents are kept in the main archive", "All docuemnts are kept in the main archive"), ("Please contact the department, then wait", "Please Contact the department then wait")]


def test_statements_stay(spark):
    """Edits of numbers, short words, signs and beginnings make other statements; slips inside long words don't."""
    rows = [(2 * i + k, x) for i, pair in enumerate(APART + ALIKE) for k, x in enumerate(pair)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(i for i, t in got.items() if t == "") == [2 * i + 1 for i in range(len(APART), len(APART + ALIKE))]


def test_slips_are_found(spark):
    """Of lines with one random edit within a word of six letters or more, all are found; of edits anywhere, the README
    says how many."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 11))) for _ in range(3000)]
    rows = []
    for i in range(300):
        words = [r.choice(vocabulary) for _ in range(9)] + ["machinery"]
        rows.append((2 * i, " ".join(words)))
        at = r.choice([j for j, w in enumerate(words) if len(w) > 6])
        w, k = words[at], r.randrange(1, len(words[at]) - 2)
        words[at] = r.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "q" + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])
        rows.append((2 * i + 1, " ".join(words)))
    got = {x.doc_id: x.text for x in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] for i in range(300)) and sum(got[2 * i + 1] == "" for i in range(300)) == 300


def test_common_forms_in_linear_time(spark):
    """Lines of one form that name different things: their groups are small."""
    r = random.Random(6)
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    lines = sorted({f"Copyright holder {name()} {name()} all rights reserved" for _ in range(32_000)})
    rows = [(i, "\n".join(lines[i::40])) for i in range(40)]
    began = time.time()
    assert line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert time.time() - began < 60


def test_line_classes(spark):
    """Planted edits, chains and repeats, short lines among them, against all pairs."""
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh ") for _ in range(n)).strip() + "x" for n in (3, 6, 11, 12, 14, 18, 23, 24, 25, 30, 44, 60)]
    lines = set(base)
    for x in base:
        for _ in range(5):
            y = list(x)
            for _ in range(r.randint(1, 3)):
                at = r.randrange(len(y))
                y[at : at + 1] = r.choice([[], [r.choice("abcdefgh")], [y[at], "z"]])
            lines.add("".join(y).strip())
    lines = sorted(x for x in lines if re.search("[a-z]", x))
    root = {x: x for x in lines}
    for a, b in itertools.combinations(lines, 2):
        if distance(a, b) <= min(2, min(len(a), len(b)) // 12) and one_statement(a, b) and root[a] != root[b]:
            low, high = root[a], root[b]
            root = {x: low if c == high else c for x, c in root.items()}
    shuffled = r.sample(lines, len(lines))
    rows = [(i, "\n".join(shuffled[i::5] + ([base[3], base[0]] if i == 4 else []))) for i in range(5)]
    first, want = {}, {}
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            if first.setdefault(root[x], (i, len(kept))) and x is not None and (root[x], "seen") not in want:
                want[(root[x], "seen")] = i
                kept.append(x)
        want[i] = "\n".join(kept)
    got = {d.doc_id: d.text for d in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want[i] for i, _ in rows}


def near_by_all_pairs(lines):
    """Class of each line that has another one within the edits: what links lead to, by comparing all pairs."""
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(lines, 2):
        most = min(2, min(len(a), len(b)) // 12)
        if abs(len(a) - len(b)) <= most and sum(((n := Counter(a)) - (m := Counter(b))).values()) + sum((m - n).values()) <= 2 * most and distance(a, b) <= most:
            root[max(find(a), find(b))] = min(find(a), find(b))
    sets = defaultdict(set)
    for x in lines:
        sets[find(x)].add(x)
    return {frozenset(x) for x in sets.values() if len(x) > 1}


def near_sets(spark, lines):
    """Those of deduplicated, a line a document."""
    sets = defaultdict(set)
    found = line_dedup.deduplicated(spark.createDataFrame([(i, f"a\n {x}") for i, x in enumerate(lines)], "doc_id long, text string"), near=True)
    for r in found.collect():
        assert {x.line_no for x in r.near} <= {1}
        for x in r.near:
            sets[x["class"]].add(lines[r.doc_id])
    return {frozenset(x) for x in sets.values()}


def test_near_lines_whatever_the_edits(spark):
    """Edits of numbers, short words, word ends, signs and joined words are links too, though such lines stay."""
    joined = [("The decision-making was put off", "The decisionmaking was put off"), ("He ran now here to be found", "He ran nowhere to be found"), ("A letter came in the morning post", "A leter came in the morning post")]
    marks = [("-" * 30, "-" * 31), ("\u2022" * 30, "\u2022" * 31)]
    pairs = [(a, b) for a, b in APART + joined if distance(a, b) <= 2]
    assert len(pairs) >= 8
    assert near_sets(spark, [x for pair in pairs + marks for x in pair]) == {frozenset(pair) for pair in pairs}
    rows = [(i, "\n".join(pair)) for i, pair in enumerate(pairs)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), near=True).collect()
    assert all(r.text == "\n".join(pairs[r.doc_id]) and r.removed == [] and [x.line_no for x in r.near] == [0, 1] for r in got)


def test_near_lines_by_all_pairs(spark, texts):
    """Planted edits at any place of real lines, and lines of a few forms, of which many meet under each key."""
    r = random.Random(12)
    real = sorted({y for t in texts.values() for x in (t or "").split("\n") if 12 <= len(y := x.strip()) <= 90 and re.search("[a-zA-Z]", y)})
    lines = set(r.sample(real, 150))
    for x in sorted(lines):
        for _ in range(2):
            y = list(x)
            for _ in range(r.randint(1, 3)):
                at = r.randrange(1, len(y) - 1)
                y[at : at + 1] = r.choice([[], [r.choice("ab7 ,-")], [y[at], r.choice("ab7 ,-")]])
            lines.add("".join(y).strip())
    for _ in range(160):
        lines |= {f"Order no. {r.randrange(10**6):06d} was shipped to {r.choice(('Rome', 'Oslo'))}", f"Page {r.randrange(10**5)} of it", f"{r.randrange(10**4)} items left in the store"}
    lines = sorted(lines)
    want = near_by_all_pairs(lines)
    assert len(want) > 50
    assert near_sets(spark, lines) == want
    by_h = {xxhash.xxh64_intdigest(x.encode(), 42): x for x in lines}
    links = line_dedup.line_links(spark.createDataFrame([("\n".join(lines[i::3]),) for i in range(3)], "text string"), many=4)
    sets = defaultdict(set)
    for x in common.components(links.select("src", "dst")).collect():
        sets[x.component].add(by_h[x.node % (1 << 64)])
    assert {frozenset(x) for x in sets.values()} == want


def test_near_lines_of_one_form(spark):
    """20,000 lines that share all but a name meet in a few steps, and the planted link is found."""
    r = random.Random(8)
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    lines = sorted({f"All rights of this text are reserved by {name()} and heirs" for _ in range(20_000)})
    pair = ("All rights of this text are reserved by abc17defg and heirs", "All rights of this text are reserved by abc25defg and heirs")
    began = time.time()
    found = near_sets(spark, [*lines, *pair])
    assert frozenset(pair) in found and all(len(x) == 2 and distance(*x) <= 2 for x in found)
    assert time.time() - began < 120


def test_fill(docs):
    """Sequences get as full whatever the input's partitions."""
    for n in (1, 60):
        got = packing.pack_documents(docs.repartition(n)).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
        assert got[0] / 2048 / got[1] > 0.95


def test_run(spark, docs, texts):
    """The pipeline's last rows are those of the documents that each stage, judged by itself, keeps."""
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    kept = {r.doc_id for r in quality.assessed(docs).select("doc_id", "kept").collect() if r.kept}  # a filter on kept would be pushed below it
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(docs.where(F.col("doc_id").isin(kept))).collect() if (r.text or "").strip(" \t\n\x0b\x0c\r")}
    rows = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    near = {r.id for r in simhash.near_duplicates(rows).collect() if r.id == r.component_id}
    bad = {r.doc_id for r in decontaminate.contamination(decontaminate.matches(rows, spark.read.parquet(f"{SF}/benchmark.parquet"))).collect() if r.contaminated}
    assert set(got) == near - bad and len(got) > 50
