"""Exact vector search, sparse hashing embeddings, chunks and conversation memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import blocked

#: Question vectors in one block; more go in several.
MOST_QUERIES = 10_000


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)"


def cosine(a: str, b: str) -> Column:
    """0 where a vector has no length, or the two have different dimensions."""
    return F.expr(f"if(size({a}) = size({b}), coalesce(try_divide({_dot(a, b)}, sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})), 0D), 0D)")


def fitted(vector: Column, dimension: int) -> Column:
    """Cut or padded with zeros to the dimension, then of length 1 (a vector of zeros stays)."""
    v = F.slice(F.concat(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), dimension)), 1, dimension)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, per_label: int | None = None) -> DataFrame:
    """query_id, place, vec_id, label, score: the k nearest vectors (vec_id, embedding, label) of each query (query_id,
    query), ties by vec_id; at most per_label of one label. A vector isn't met by the query of its own id."""
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = blocked.nearest(rows, queries, k, ["id"], blocked.Rules(cap=per_label, skip_same=True), most_queries=MOST_QUERIES)
    return found.select("query_id", "place", F.col("id").alias("vec_id"), "label", "score")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def signed_counts(docs: DataFrame, dimension: int = 384) -> DataFrame:
    """id, bucket, v (not 0): of each text (id, text) the sum of its hashed words' signs."""
    each = docs.select("id", F.explode(words(F.col("text"))).alias("w"))
    counts = each.groupBy("id", "w").agg(F.count("*").alias("n")).withColumn("h", F.md5("w"))
    bucket = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dimension
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("long") % 2 == 1, 1).otherwise(-1)
    places = counts.select("id", bucket.alias("bucket"), (sign * F.col("n")).alias("v")).groupBy("id", "bucket").agg(F.sum("v").alias("v"))
    return places.where("v <> 0")


def hashing_embedding(docs: DataFrame, dimension: int = 384) -> DataFrame:
    """doc_id, bucket, value of the non-zero places: signed counts of hashed words over their length."""
    places = signed_counts(docs.select(F.col("doc_id").alias("id"), "text"), dimension)
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return places.select(F.col("id").alias("doc_id"), "bucket", F.round(F.col("v") / length, 4).alias("value"))


def chunk_windows(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_index, start, chars of each overlapping window."""
    each = docs.select("doc_id", "text", F.posexplode(tx.chunk_starts(F.col("text"), size, overlap)).alias("chunk_index", "start"))
    return each.select("doc_id", "chunk_index", "start", F.length(F.substr(F.col("text"), F.col("start") + 1, F.lit(size))).alias("chars"), F.md5(F.substr(F.col("text"), F.col("start") + 1, F.lit(size)).cast("binary")).alias("digest"))


def chat_memory(messages: DataFrame, recent: int = 6) -> DataFrame:
    """The last messages of user and assistant in each conversation, oldest first."""
    m = messages.where(F.col("role").isin("user", "assistant"))
    back = m.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= recent)
    return back.select("conv_id", "back", "turn", "role", F.length("text").alias("chars"))


def chat_sessions(messages: DataFrame) -> DataFrame:
    """Messages, and messages to be summarized (all but the last six), by conversation."""
    n = F.count("*")
    return messages.groupBy("conv_id").agg(n.alias("message_count"), F.greatest(n - 6, F.lit(0)).alias("summarized"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("user_messages"))
