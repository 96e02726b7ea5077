"""Search for a table of questions, each with an asset or none; evidence and extractive answers from what it finds.

chunks: document_id, chunk_id, chunk_index, filename, text, model (of its embedding). questions: question_id, question,
tag, model. Embeddings are those of hashed words, so text and question are all that is needed.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import facts
from . import blocked, hybrid
from .retrieval import words

# Chunks of one document in a result, what naming the asset is worth, characters of a preview, limits of a
# label, and the answer's wording.
MOST_OF_DOCUMENT, ASSET_BOOST = 3, 0.15
PREVIEW, HIGH, MEDIUM = 280, 0.6, 0.3
#: Rows that are sent to every task.
MOST_SENT = 100_000
NO_CONTEXT = "Not enough indexed context to answer this question. Ingest related documents via POST /documents and try again."
ANSWER = "Based on {n} retrieved chunk(s){intent}, the most relevant evidence for \"{question}\" is: \"{evidence}\" (Extractive answer — no LLM; see citations for full provenance.)"


def pool_size(k: int) -> int:
    return k * MOST_OF_DOCUMENT + 10


def _preview(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= PREVIEW, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, PREVIEW)), F.lit("...")))


def _with_words(keyed: DataFrame) -> DataFrame:
    """id, text, words, vector of each id (of several rows the least text): an id's own row has its words, which become a
    vector in the task that reads it, and one of several rows the vector of all their words.

    Only ids are dealt, to see which several rows share, and the rows that do.
    """
    shared = keyed.groupBy("id").count().where("count > 1").select("id")
    n = shared.limit(MOST_SENT + 1).count()
    own = lambda df: df.select("id", "text", words(F.col("text")).alias("words"), F.lit(None).cast("struct<at:array<int>,value:array<double>>").alias("vector"))
    if not n:
        return own(keyed)
    shared = F.broadcast(shared) if n <= MOST_SENT else shared
    several = keyed.join(shared, "id", "left_semi")
    joined = several.groupBy("id").agg(F.min("text").alias("text")).join(hybrid.hashed(several), "id")
    return own(keyed.join(shared, "id", "left_anti")).unionByName(joined.select("id", "text", F.lit(None).cast("array<string>").alias("words"), F.col("places").alias("vector")))


def search(chunks: DataFrame, questions: DataFrame, k: int = 5, boost: float = ASSET_BOOST) -> DataFrame:
    """question_id, place, score, document_id, chunk_index, chunk_id: of the pool of the best pool_size(k) chunks of the
    question's model the first k, no chunk_id twice, at most MOST_OF_DOCUMENT of a document.

    A chunk that names the question's tag as a whole word gains `boost`, up to 1. Ties: document_id, chunk_index,
    chunk_id. Rows that share all four keys are one chunk, with the words of all. A question or chunk without words finds
    or is nothing; a null tag gains nothing; null models are one model.
    """
    key = F.struct("document_id", "chunk_index", "chunk_id", "model").alias("id")
    rows = _with_words(chunks.select(key, F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.select("text", "words", "vector", "id.model", "id.document_id", "id.chunk_index", F.col("id.chunk_id").alias("id"))
    asked = hybrid.hashed(questions.select(F.col("question_id").alias("id"), F.col("question").alias("text"))).join(questions.select(F.col("question_id").alias("id"), "tag", "model"), "id")
    rules = blocked.Rules(digits=6, boost=boost, same_model=True)
    pool = blocked.nearest(rows, asked.select(F.col("id").alias("query_id"), F.col("places").alias("query"), "tag", "model"), pool_size(k), ["document_id", "chunk_index", "id"], rules, dimension=hybrid.DIMENSION, prepare=hybrid.filled)
    by = lambda *keys: F.row_number().over(Window.partitionBy("query_id", *keys).orderBy("place"))  # noqa: E731  pool_size rows a question
    once = pool.withColumn("again", by("id")).where("again = 1")
    few = once.withColumn("of_document", by("document_id")).where(F.col("of_document") <= MOST_OF_DOCUMENT)
    out = few.withColumn("place", by()).where(F.col("place") <= k)
    return out.select(F.col("query_id").alias("question_id"), "place", "score", "document_id", "chunk_index", F.col("id").alias("chunk_id"))


def evidence(chunks: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """What search finds, with question, tag, intent, filename and text: files of the kind that the question's intent
    prefers gain, and the places follow the scores anew."""
    keys, found = ["chunk_id", "document_id", "chunk_index"], search(chunks, questions, k)
    few = questions.limit(MOST_SENT // k + 1).count() * k <= MOST_SENT  # then the texts stay where they are read
    text_of = chunks.select(*keys, "filename", "text")
    found = text_of.join(F.broadcast(found), keys).dropDuplicates(["question_id", *keys]) if few else found.join(text_of.dropDuplicates(keys), keys)
    found = found.join(questions.select("question_id", "question", "tag"), "question_id").withColumn("intent", facts.intent(F.col("question")))
    score = F.round(F.least(F.lit(1.0), F.col("score") + facts.source_boost(F.col("intent"), F.col("filename"))), 6)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "document_id", "chunk_index", "place")
    return found.withColumn("score", score).withColumn("place", F.row_number().over(order))


def answers(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """question_id, intent, answer, confidence, retrieved, citations (place, document_id, chunk_id, score, preview, page),
    related (other tags in the chunks, in order) of each question; one that finds nothing says so."""
    e = evidence(chunks, questions, k)
    tags = F.transform(facts.tags(F.coalesce("text", F.lit(""))), lambda t: t["tag"])
    entry = F.struct("place", "document_id", "chunk_id", "score", _preview(F.coalesce("text", F.lit(""))).alias("preview"), facts.page_number(F.col("text")).alias("page"), tags.alias("named"))
    by = e.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # k rows a question
    all_ = questions.select("question_id", "question", "tag").join(by, "question_id", "left")
    intent, top = facts.intent(F.col("question")), F.expr("get(e, 0)")
    note = F.when(intent != "general", F.concat(F.lit(" ["), intent, F.lit("]"))).otherwise("")
    values, said = {"n": F.size("e").cast("string"), "intent": note, "question": F.col("question"), "evidence": top["preview"]}, []
    for text, name, *_ in Formatter().parse(ANSWER):
        said += [F.lit(text), *([values[name]] if name else [])]
    related = F.array_except(F.array_distinct(F.flatten(F.expr("e.named"))), F.array(F.upper(F.coalesce("tag", F.lit("")))))
    return all_.select(
        "question_id", intent.alias("intent"), F.when(F.col("e").isNull(), F.lit(NO_CONTEXT)).otherwise(F.concat(*said)).alias("answer"), F.coalesce(hybrid.confidence_label(top["score"], HIGH, MEDIUM), F.lit("low")).alias("confidence"),
        F.coalesce(F.size("e"), F.lit(0)).alias("retrieved"), F.expr("transform(e, x -> struct(x.place, x.document_id, x.chunk_id, x.score, x.preview, x.page))").alias("citations"), F.coalesce(related, F.array().cast("array<string>")).alias("related"),
    )


def names(text: Column, tag: Column) -> Column:
    """Whether the text has the tag as a whole word, in any case; not for an empty or null tag."""
    return F.coalesce((F.trim(tag) != "") & F.regexp_like(text, F.concat(F.lit(r"(?iU)\b\Q"), F.trim(tag), F.lit(r"\E\b"))), F.lit(False))
