"""Hybrid retrieval for a table of questions: keyword and vector candidates, their fusion, and a diverse selection.

chunks: chunk_id, file_name, text, summary, questions, tags (array), row_start, and any others. queries: item_id, question.
The questions' terms and vectors are sent to every task in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import facts
from ..functions import text as tx
from . import blocked
from .retrieval import signed_counts

# Weights of fusion and diversification.
VECTOR_WEIGHT, KEYWORD_WEIGHT, RRF_K = 0.7, 0.3, 60
MMR_LAMBDA, MOST_OF_FILE, BOOST_CAP = 0.72, 2, 0.55
# What a token and an asset of the question are worth in a chunk's summary, text and questions, and an asset among its tags.
TOKEN, ASSET, TAGGED = (2.0, 1.0, 3.0), (4.0, 2.0, 4.0), 8.0
SAME_FILE, NEAR_ROW = 0.08, 0.12
LEAST_SCORE, PREVIEW = 0.15, 600
DIMENSION = 384
#: Rows whose places are counted at once, and words whose hashes a task keeps.
ROWS_AT_ONCE, MOST_KNOWN = 1000, 100_000
INSUFFICIENT = "I could not find enough evidence in the indexed documents to answer this question."


def candidate_limit(k: int) -> int:
    return max(50, min(150, 10 * k))


def with_terms(queries: DataFrame) -> DataFrame:
    """queries with tokens and assets (distinct, in order)."""
    return queries.withColumn("tokens", tx.query_tokens(F.col("question"))).withColumn("assets", facts.question_tags(F.col("question")))


def _count(items: str, text: str) -> Column:
    return F.expr(f"size(filter({items}, x -> contains({text}, x)))")


def _lowered(chunks: DataFrame) -> DataFrame:
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return chunks.select("chunk_id", "file_name", "row_start", F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.upper).alias("tags"), text("summary").alias("low_summary"), text("text").alias("low_text"), text("questions").alias("low_questions"))


@dataclass
class Terms:
    """The terms of a block of questions, as tasks get them: whose tokens, assets and tags they are."""

    ids: pa.Array
    terms: list[str]
    token_of: list[np.ndarray]
    asset_of: list[np.ndarray]
    tag_of: dict[str, np.ndarray]

    @classmethod
    def of(cls, t: pa.Table) -> Terms:
        held: dict[str, tuple[list, list]] = {}
        tags: dict[str, list] = {}
        for i, (tokens, assets) in enumerate(zip(t.column("tokens").to_pylist(), t.column("assets").to_pylist(), strict=True)):
            for x in tokens or ():
                held.setdefault(x, ([], []))[0].append(i)
            for x in assets or ():
                held.setdefault(x.lower(), ([], []))[1].append(i)
                tags.setdefault(x, []).append(i)
        array = lambda x: np.array(x, np.int64)
        ids = t.column("query_id").combine_chunks()
        return cls(ids, [*held], [array(a) for a, _ in held.values()], [array(b) for _, b in held.values()], {x: array(v) for x, v in tags.items()})

    def automaton(self) -> Any:
        """One for each task's process; it isn't sent."""
        if not hasattr(self, "_automaton"):
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, t in enumerate(self.terms):
                self._automaton.add_word(t, i)
            self._automaton.make_automaton()
        return self._automaton


def term_scores(part: pa.RecordBatch, q: Terms) -> tuple[np.ndarray, np.ndarray]:
    """What each row is worth to each question: each term in each of its texts once, and its tags. One pass of an
    automaton over a text finds all terms at once."""
    out = np.zeros((part.num_rows, len(q.ids)))
    texts = [part.column(c).to_pylist() for c in ("summary", "text", "questions")]
    for row, (*said, tags) in enumerate(zip(*texts, part.column("tags").to_pylist(), strict=True)):
        for text, token, asset in zip(said, TOKEN, ASSET, strict=True):
            for i in {i for _, i in q.automaton().iter((text or "").lower())} if q.terms else ():
                out[row, q.token_of[i]] += token
                out[row, q.asset_of[i]] += asset
        for x in {x.upper() for x in tags or () if x is not None} & q.tag_of.keys():
            out[row, q.tag_of[x]] += TAGGED
    return out.astype(np.int64), out > 0


def keyword_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item_id, rank, chunk_id, score (above 0): the k best chunks of each question; ties by file name from the last,
    by row from the first. Questions go to tasks in blocks of bounded size, and each task keeps its best k of each."""
    q = with_terms(queries).select(F.col("item_id").alias("query_id"), "tokens", "assets")
    rows = chunks.select("chunk_id", "file_name", F.coalesce("row_start", F.lit(0)).alias("row"), "summary", "text", "questions", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    n_bytes = 30 * (F.size("tokens") + 2 * F.size("assets")) + F.length(F.array_join("tokens", ""))
    ties = [("file_name", "descending"), ("row", "ascending"), ("chunk_id", "ascending")]
    found = blocked.best(rows, ["chunk_id", "file_name", "row"], q, n_bytes, Terms.of, term_scores, k, ties)
    return found.select(F.col("query_id").alias("item_id"), "chunk_id", "score", F.col("place").alias("rank"))


def hashed(docs: DataFrame) -> DataFrame:
    """id, places (at, value: the places of the hashing embedding that aren't 0, before they are divided by its length)."""
    entry = F.sort_array(F.collect_list(F.struct(F.col("bucket").cast("int").alias("at"), F.col("v").cast("double").alias("value"))))  # DIMENSION at most
    return signed_counts(docs, DIMENSION).groupBy("id").agg(entry.alias("e")).select("id", F.struct(F.col("e.at").alias("at"), F.col("e.value").alias("value")).alias("places"))


def signed_places(column: pa.ListArray, dimension: int, known: dict[str, int]) -> tuple[pa.StructArray, np.ndarray]:
    """The places of each list of words, as hashed has them, and how many each has. known: words' places so far, with
    their signs."""
    coded = pc.list_flatten(column).dictionary_encode()
    for w in coded.dictionary.to_pylist():
        if w not in known:
            h = md5(w.encode()).digest()
            bucket = int.from_bytes(h[:4], "big") % dimension
            known[w] = bucket if h[4] % 2 else -1 - bucket
    place = np.array([known[w] for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    cell = pc.list_parent_indices(column).to_numpy() * dimension + np.where(place < 0, -1 - place, place)
    counts = np.bincount(cell, np.where(place < 0, -1.0, 1.0), len(column) * dimension)
    filled = np.flatnonzero(counts)
    n = np.bincount(filled // dimension, minlength=len(column))
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array((filled % dimension).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(counts[filled]))]
    return pa.StructArray.from_arrays(lists, ["at", "value"]), n


def filled() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """What gives, in one task, rows (vector, words) the places of their words where they have no vector. Rows that have
    neither are left out."""
    known: dict[str, int] = {}

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if len(known) > MOST_KNOWN:
            known.clear()
        vector, said = part.column("vector"), part.column("words")
        made, n = zip(*(signed_places(said.slice(i, ROWS_AT_ONCE), DIMENSION, known) for i in range(0, len(said), ROWS_AT_ONCE)), strict=True)
        has, places = vector.is_valid(), pa.concat_arrays(made).cast(vector.type)
        vector = pc.if_else(has, vector, places) if vector.null_count < len(vector) else places
        return part.set_column(part.schema.get_field_index("vector"), "vector", vector).filter(pc.or_(has, pa.array(np.concatenate(n) > 0)))

    return run


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item_id, rank, chunk_id, score: the k chunks of the largest cosine of hashing embeddings, ties by chunk_id; of the
    chunks and questions that have a word. Counts are whole numbers, so products are exact in any order."""
    rows = hashed(chunks.select(F.col("chunk_id").alias("id"), "text")).withColumnRenamed("places", "vector")
    asked = hashed(queries.select(F.col("item_id").alias("id"), F.col("question").alias("text"))).select(F.col("id").alias("query_id"), F.col("places").alias("query"))
    found = blocked.nearest(rows, asked, k, ["id"], blocked.Rules(digits=6), dimension=DIMENSION)
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("chunk_id"), "score", F.col("place").alias("rank"))


def fused(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """item_id, chunk_id, vector_score, keyword_score (each over its list's best), vector_rank, keyword_rank, rrf: of all
    candidates in either list."""
    n = candidate_limit(k)

    def ranked(found: DataFrame, kind: str) -> DataFrame:
        best = F.max("score").over(Window.partitionBy("item_id"))
        return found.select("item_id", "chunk_id", F.greatest(F.lit(0.0), F.col("score") / F.when(best == 0, 1.0).otherwise(best)).alias(f"{kind}_score"), F.col("rank").alias(f"{kind}_rank"))

    both = ranked(vector_topk(chunks, queries, n), "vector").join(ranked(keyword_topk(chunks, queries, n), "keyword"), ["item_id", "chunk_id"], "full_outer")
    share = lambda weight, rank: F.coalesce(F.lit(weight) / (RRF_K + F.col(rank)), F.lit(0.0))
    return both.select("item_id", "chunk_id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), "vector_rank", "keyword_rank", (share(VECTOR_WEIGHT, "vector_rank") + share(KEYWORD_WEIGHT, "keyword_rank")).alias("rrf"))


def metadata_boost() -> Column:
    overlap = _count("tokens", "low_questions")
    named = F.arrays_overlap("assets", "tags")
    in_tags = F.expr("exists(tokens, t -> contains(lower(array_join(tags, ' ')), t))") & (F.size("tags") > 0)
    boost = F.when(named, 0.25).otherwise(0.0) + F.when(overlap >= 2, F.least(F.lit(0.25), overlap * 0.05)).otherwise(0.0) + F.when(in_tags, 0.05).otherwise(0.0)
    return F.least(F.lit(BOOST_CAP), boost)


def ranked(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """item_id, place, chunk_id, raw (the hybrid score), score (over the question's best, 0 to 1), file_name, row_start."""
    each = fused(chunks, queries, k).join(_lowered(chunks), "chunk_id").join(F.broadcast(with_terms(queries)), "item_id")
    raw = VECTOR_WEIGHT * F.col("vector_score") + KEYWORD_WEIGHT * F.col("keyword_score") + F.col("rrf") + metadata_boost() + facts.file_boost(F.col("question"), F.col("file_name"))
    each = each.withColumn("raw", F.round(raw, 9))
    order = Window.partitionBy("item_id").orderBy(F.desc("raw"), F.desc("vector_score"), F.desc("keyword_score"), F.coalesce("row_start", F.lit(0)), "chunk_id")
    best = F.max("raw").over(Window.partitionBy("item_id"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw") / F.when(best == 0, 1.0).otherwise(best)))
    return each.select("item_id", F.row_number().over(order).alias("place"), "chunk_id", "raw", score.alias("score"), "file_name", "row_start")


def similarity(a: set[str], b: set[str], same_file: bool, row_a: int | None, row_b: int | None) -> float:
    """Jaccard of the tokens, more for one file and for rows beside each other."""
    if not a or not b:
        return 0.0
    near = row_a is not None and row_b is not None and abs(row_a - row_b) <= 2
    return min(1.0, len(a & b) / len(a | b) + SAME_FILE * same_file + NEAR_ROW * near)


def select_diverse(raw: list[float], files: list[str], rows: list[int | None], tokens: list[set[str]], k: int) -> list[int]:
    """Which of the ranked candidates to take, in order: the best first, then whichever scores most after what it has in
    common with those taken; of one file MOST_OF_FILE. If only capped ones are left, they follow by rank."""
    chosen: list[int] = []
    closest = np.zeros(len(raw))
    left = list(range(len(raw)))
    while left and len(chosen) < k:
        if not chosen:
            best = left[0]
        else:
            free = [i for i in left if sum(files[j] == files[i] for j in chosen) < MOST_OF_FILE]
            if not free:
                break
            best = max(free, key=lambda i: (MMR_LAMBDA * raw[i] - (1 - MMR_LAMBDA) * closest[i], -i))
        chosen.append(best)
        left.remove(best)
        for i in left:
            closest[i] = max(closest[i], similarity(tokens[i], tokens[best], files[i] == files[best], rows[i], rows[best]))
    return chosen + left[: k - len(chosen)]


def diverse(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """item_id, place, chunk_id, score: k chunks of each question; its candidates, two lists at most, are one group."""
    label = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("questions", F.lit("")), F.array_join("tags", " "), "file_name")
    each = ranked(chunks, queries, k).join(chunks.select("chunk_id", tx.query_tokens(label).alias("label")), "chunk_id")

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place").reset_index(drop=True)
        rows = [None if pd.isna(r) or r == 0 else int(r) for r in g["row_start"]]
        taken = select_diverse(g["raw"].tolist(), g["file_name"].tolist(), rows, [set(x) for x in g["label"]], k)
        out = g.loc[taken, ["item_id", "chunk_id", "score"]]
        return out.assign(place=np.arange(1, len(out) + 1, dtype=np.int32))[["item_id", "place", "chunk_id", "score"]]

    types = {f.name: f.dataType.simpleString() for f in each.schema}
    return each.select("item_id", "place", "chunk_id", "raw", "score", "file_name", "row_start", "label").groupBy("item_id").applyInPandas(pick, f"item_id {types['item_id']}, place int, chunk_id {types['chunk_id']}, score double")


def confidence(top: Column, n: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), top)) + 0.03 * F.least(n, F.lit(5))), 2)


def confidence_label(score: Column, high: float = 0.6, medium: float = 0.3) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def answers(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """item_id, intent, sufficient, confidence, label, answer (the three best chunks' texts with their places),
    citations (distinct files, in order), related (other tags in the chunks) of each question."""
    tags_of = F.transform(facts.tags(F.coalesce("text", F.lit(""))), lambda t: t["tag"])
    found = diverse(chunks, queries, k).join(chunks.select("chunk_id", "file_name", "row_start", "text", tags_of.alias("named")), "chunk_id")
    entry = F.struct("place", "score", "file_name", "row_start", tx.preview(F.coalesce("text", F.lit("")), PREVIEW).alias("said"), "named")
    by = found.groupBy("item_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    by = queries.select("item_id", "question").join(by, "item_id", "left").withColumn("e", F.coalesce("e", F.array().cast(by.schema["e"].dataType)))
    top = F.coalesce(F.expr("get(e, 0).score"), F.lit(0.0))
    blocks = F.expr("transform(filter(slice(e, 1, 3), x -> x.said <> ''), x -> concat('[', x.place, '] ', x.file_name, if(coalesce(x.row_start, 0) <> 0, concat(' (row ', x.row_start, ')'), ''), '\\n', x.said))")
    enough = (top >= LEAST_SCORE) & (F.size(blocks) > 0)
    asked = facts.question_tags(F.col("question"))
    score = confidence(top, F.size("e"))
    return by.select("item_id", facts.intent(F.col("question")).alias("intent"), enough.alias("sufficient"), F.when(enough, score).otherwise(0.0).alias("confidence"), confidence_label(F.when(enough, score).otherwise(0.0)).alias("label"), F.when(enough, F.array_join(blocks, "\n\n")).otherwise(INSUFFICIENT).alias("answer"), F.array_distinct(F.expr("e.file_name")).alias("citations"), F.array_except(F.flatten(F.expr("e.named")), asked).alias("related"))
