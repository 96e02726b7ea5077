"""Mentions joined to their documents and chunks while all three still come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def evidence(mentions: DataFrame, documents: DataFrame, chunks: DataFrame, entities: DataFrame, delay: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """What graph.evidence gives, of streams with a time ts each: mention_id, tag, document_id, chunk_index, entity_id;
    document_id, filename, created_at; document_id, chunk_index, text. entities: a table of entity_id, name.

    A mention meets a document or chunk that came within `within` of it. One that meets none comes out without it once
    the watermark says that none can come any more, so state holds rows of some `within` and `delay` only. Null keys
    meet nothing. Over tables: the same rows at once.
    """
    at = lambda df: df.withWatermark("ts", delay) if df.isStreaming else df
    near = f"{{0}}_ts BETWEEN mention_ts - INTERVAL {within} AND mention_ts + INTERVAL {within}"
    m = at(mentions).select("mention_id", "tag", "document_id", F.col("chunk_index").alias("said_chunk"), "entity_id", F.col("ts").alias("mention_ts"))
    d = at(documents).select(F.col("document_id").alias("d_document"), "filename", "created_at", F.lit(True).alias("found_document"), F.col("ts").alias("d_ts"))
    c = at(chunks).select(F.col("document_id").alias("c_document"), "chunk_index", "text", F.col("ts").alias("c_ts"))
    out = m.join(d, F.expr(f"document_id = d_document AND {near.format('d')}"), "left")
    out = out.join(c, F.expr(f"document_id = c_document AND said_chunk = chunk_index AND {near.format('c')}"), "left")
    out = out.join(entities.select("entity_id", F.col("name").alias("entity_name")), "entity_id", "left")
    return out.drop("d_document", "c_document", "d_ts", "c_ts", "said_chunk", "mention_ts")


def timeline(mentions: DataFrame, documents: DataFrame, chunks: DataFrame, entities: DataFrame, delay: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """graph.timeline of the evidence above."""
    return graph.timeline(evidence(mentions, documents, chunks, entities, delay, within))
