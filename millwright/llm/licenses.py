"""Licence scan, with DataFrame and ML functions only.

A logistic regression over hashed words and word pairs names the licence family of each paragraph (line), or unknown.
It is fitted on the clauses of the templates below, whole and in parts, and on sentences with a licence's name, against
a bounded sample of the corpus's other paragraphs; lines that a sentence was wrapped over are one paragraph.
Calibration, on sentences and paragraphs held out: a scale for the model's log-odds, fitted by logistic regression, makes
probabilities of them; the limit that a family's must pass is one that a thousandth of the corpus's held-out paragraphs pass, 0.5 at least. A prediction is confirmed if at least half of the paragraph's word triples are its template's.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# Texts of licences by paragraph, and the sentences by which they are usually named.
TEMPLATES = {
    "apache-2.0": [
        "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions",
    ],
    "mit": [
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "bsd": [
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "isc": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "gpl": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "lgpl": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit and provide a link to the license.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes.",
    ],
    "cc0": [
        "CC0 1.0 Universal Public Domain Dedication",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
# Names of the licences, as identifiers and in words, and sentences that name one.
NAMES = {
    "apache-2.0": ["Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "mit": ["MIT", "MIT License", "MIT licence"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause", "3-Clause BSD License", "2-Clause BSD License", "BSD License", "BSD 2-Clause license"],
    "isc": ["ISC", "ISC License"],
    "gpl": ["GPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0", "GNU General Public License, version 3", "GNU GPL v3", "GNU GPL v2", "GPLv3"],
    "lgpl": ["LGPL-2.1-or-later", "LGPL-3.0-only", "GNU Lesser General Public License", "GNU LGPL v3"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later", "GNU Affero General Public License", "GNU AGPL v3"],
    "mpl-2.0": ["MPL-2.0", "Mozilla Public License 2.0"],
    "cc-by": ["CC-BY-4.0", "CC BY 4.0", "CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution 4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "cc0": ["CC0-1.0", "CC0 1.0", "the public domain (CC0)"],
}
NAMING = ["SPDX-License-Identifier: {}", "License: {}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This project is licensed under the terms of the {}.", "{} only", "{}", "This work is licensed under the {}.", "Distributed under the {}; see LICENSE."]
#: Words beside those of the templates that keep a corpus paragraph out of the clean negatives.
CUES = r"licen[cs]e|copyright|all rights reserved|redistribut|warrant(y|ies)|spdx|\\bgpl|creative commons|public domain|permission is hereby"
FAMILIES = ("unknown", *TEMPLATES)
#: Paragraphs of the corpus that the model is fitted on, and as many on which it is calibrated.
SAMPLE = 4000
BUCKETS = 1 << 13
#: Of held-out corpus paragraphs, how many may exceed the limit.
FALSE_ALARMS = 0.001
CONFIRM = 0.5


def words(x: str) -> Column:
    return F.expr(f"filter(split(lower({x}), '[^\\\\p{{L}}\\\\p{{N}}.+-]+'), w -> w rlike '[\\\\p{{L}}\\\\p{{N}}]')")


def _lines(docs: DataFrame) -> DataFrame:
    """A line that doesn't end a sentence and the one after it, if it goes on in small letters, are one."""
    whole = F.regexp_replace("text", r"(?<![.!?:;\n])\n(?=[a-z(])", " ")
    each = docs.select("doc_id", F.posexplode(F.split(whole, "\n")).alias("paragraph", "text"))
    return each.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number from 0), text of each paragraph with a word."""
    return _lines(docs).withColumn("words", words("text")).where(F.size("words") > 0)


def _sample(docs: DataFrame, n: int) -> DataFrame:
    """The n paragraphs of the smallest hashes.

    Hashes are even, so a limit that a fifth more than n should pass leaves about as many for the final ordering, however
    large docs is; without it each task would send n rows to that ordering's one task.
    """
    share = min(1.0, 1.2 * n / max(1, _lines(docs).count()))
    limit = min((1 << 63) - 1, int(share * 2**64) - (1 << 63))
    near = _lines(docs).withColumn("hash", F.xxhash64("text", "doc_id", "paragraph")).where(F.col("hash") <= limit)
    return near.orderBy("hash", "doc_id", "paragraph").limit(n).withColumn("words", words("text"))


def _examples(spark: SparkSession) -> DataFrame:
    """fold, family, text: each clause of a template, whole and its halves (fold 0), and sentences with a name, of which
    every fifth is held out (fold 1)."""
    rows = []
    for family, clauses in TEMPLATES.items():
        for clause in clauses:
            w = clause.split()
            rows += [(0, family, clause)] * 3 + [(0, family, " ".join(part)) for part in (w[: len(w) // 2 + 3], w[len(w) // 2 - 3 :]) if len(w) > 10]
        named = [x.format(name) for name in NAMES.get(family, []) for x in NAMING]
        rows += [(int(i % 5 == 4), family, x) for i, x in enumerate(named)]
    return spark.createDataFrame(rows, "fold long, family string, text string").withColumn("words", words("text"))


def fitted(docs: DataFrame) -> tuple[object, float, tuple[float, float]]:
    """The model, the least probability by which it names a family, and the scale and shift that make probabilities of
    its log-odds of a family against unknown."""
    spark = docs.sparkSession
    # a paragraph that shares a clause's word triple, or speaks of licences, isn't a clean negative
    known = F.array(*map(F.lit, sorted({t for x in _triples(spark).values() for t in x})))
    sample = _sample(docs, 2 * SAMPLE).withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(2))).withColumn("triples", _word_triples("words"))
    sample = sample.where(~F.arrays_overlap("triples", known) & F.expr(f"not lower(text) rlike '{CUES}'"))
    sample = stored(sample.select("fold", F.lit("unknown").alias("family"), "words"), "licence-sample")
    examples = _examples(spark).select("fold", "family", "words")
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    counts = sample.where("fold = 0").count()
    every = sample.union(examples).withColumn("label", label)
    train = every.where("fold = 0").withColumn("weight", F.when(F.col("family") == "unknown", 1.0).otherwise(max(1.0, counts / 500)))
    stages = [NGram(n=2, inputCol="words", outputCol="pairs"), HashingTF(numFeatures=BUCKETS, binary=True, inputCol="words", outputCol="one"), HashingTF(numFeatures=BUCKETS, binary=True, inputCol="pairs", outputCol="two"), VectorAssembler(inputCols=["one", "two"], outputCol="features"), LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, weightCol="weight", featuresCol="features", labelCol="label")]
    model = Pipeline(stages=stages).fit(train.coalesce(1))  # bounded by SAMPLE; every step sends the gradient once for each partition
    held = _odds(model.transform(every.where("fold = 1"))).select("odds", (F.col("label") > 0).cast("double").alias("licence"), F.when(F.col("label") > 0, 1.0).otherwise(0.1).alias("weight"))
    held = VectorAssembler(inputCols=["odds"], outputCol="features").transform(stored(held, "licence-held"))
    scale = LogisticRegression(regParam=1e-3, featuresCol="features", labelCol="licence", weightCol="weight").fit(held)
    by = (float(scale.coefficients[0]), float(scale.intercept)) if held.select("licence").distinct().count() == 2 else (1.0, 0.0)
    clean = held.where("licence = 0")
    above = clean.orderBy(F.desc("odds")).select(_probability(*by)).take(1 + int(FALSE_ALARMS * clean.count()))
    return model, max(0.5, above[-1][0] if above else 0.0), by


def _odds(scored: DataFrame) -> DataFrame:
    """scored with p, best (the highest probability of a family) and odds (its logarithm over that of unknown)."""
    out = scored.withColumn("p", vector_to_array("probability")).withColumn("best", F.expr("array_max(slice(p, 2, size(p) - 1))"))
    return out.withColumn("odds", F.log(F.greatest("best", F.lit(1e-12)) / F.greatest(F.col("p")[0], F.lit(1e-12))))


def _probability(scale: float, shift: float) -> Column:
    return 1 / (1 + F.exp(-(scale * F.col("odds") + shift)))


def _word_triples(column: str) -> Column:
    return F.expr(f"array_distinct(if(size({column}) < 3, array(array_join({column}, ' ')), transform(sequence(0, size({column}) - 3), i -> concat_ws(' ', {column}[i], {column}[i + 1], {column}[i + 2]))))")


def _triples(spark: SparkSession) -> dict[str, list[str]]:
    rows = _examples(spark).where("fold = 0").select("family", _word_triples("words").alias("t")).groupBy("family").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("t"))
    return {r["family"]: r["t"] for r in rows.toLocalIterator()}  # the templates' own


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity (share of the paragraph's word triples that are the
    template's), confirmed: a row for each paragraph that the model takes for a licence.

    Null and empty texts have no paragraphs. Repeated rows are scanned each; a null doc_id stays null. Other columns
    aren't read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    model, least, by = fitted(docs)
    scored = _odds(model.transform(paragraphs(docs))).withColumn("probability", _probability(*by)).where(F.col("probability") > least)
    named = scored.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("p", F.col("best")).cast("int")))
    templates = F.create_map(*(x for k, v in sorted(_triples(spark).items()) for x in (F.lit(k), F.array(*map(F.lit, v)))))
    shared = named.withColumn("triples", _word_triples("words")).withColumn("similarity", F.size(F.array_intersect("triples", F.element_at(templates, F.col("family")))) / F.size("triples"))
    return shared.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= CONFIRM).alias("confirmed"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
