"""What answers cite, and the context that is put before a question.

found: item_id, place, chunk_id and what metadata.chunk_fields gives (file_name, section_title, page_start, row_start,
row_end, parent_chunk_id, retrieval_unit_id, retrieval_summary), and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .parents import said

# Characters of a snippet, and the wording of a block of context.
SNIPPET_CHARS = 220
HEAD, LABEL, EVIDENCE = "[{place}] file={file} {location} section={section} parent_chunk_id={parent}", "Retrieval summary label (not evidence): {summary}", "Raw parent chunk evidence:"
NO_CONVERSATION = "No prior conversation context."


def _known(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(0))


def location() -> Column:
    """'row r' of a chunk with one, else 'page p', else nothing; 0 is none."""
    return F.coalesce(F.concat(F.lit("row "), _known("row_start").cast("string")), F.concat(F.lit("page "), _known("page_start").cast("string")), F.lit(""))


def span() -> Column:
    """As location, with the last row of several."""
    first, last = _known("row_start"), F.coalesce(_known("row_end"), _known("row_start"))
    rows = F.when(last != first, F.concat(F.lit("rows "), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit("row "), first.cast("string")))
    return F.coalesce(rows, location())


def snippet(text: Column, most: int = SNIPPET_CHARS) -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("...")))


def citations(found: DataFrame) -> DataFrame:
    """item_id, place (from 1), chunk_id, file_name, page, row, location, section_title, parent_chunk_id,
    retrieval_unit_id, snippet: each chunk of a question once, in order. A null text has an empty snippet."""
    once = F.row_number().over(Window.partitionBy("item_id", "chunk_id").orderBy("place"))
    kept = found.withColumn("again", once).where("again = 1")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("place", "chunk_id"))
    return kept.select("item_id", place.alias("place"), "chunk_id", "file_name", _known("page_start").alias("page"), _known("row_start").alias("row"), location().alias("location"), "section_title", "parent_chunk_id", "retrieval_unit_id", snippet(F.coalesce("text", F.lit(""))).alias("snippet"))


def contexts(found: DataFrame) -> DataFrame:
    """item_id, context: a block for each chunk of a question, in order, a blank line between them."""
    head = said(HEAD, place=F.col("place").cast("string"), file=F.coalesce("file_name", F.lit("None")), location=span(), section=F.coalesce(F.nullif("section_title", F.lit("")), F.lit("n/a")), parent=F.coalesce(F.nullif("parent_chunk_id", F.lit("")), F.col("chunk_id").cast("string")))
    block = F.concat_ws("\n", head, said(LABEL, summary=F.coalesce("retrieval_summary", F.lit(""))), F.lit(EVIDENCE), F.coalesce("text", F.lit("")))
    by = found.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("b"))  # a question's chunks
    return by.select("item_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def conversation_context(entries: Column) -> Column:
    """'role: text' lines of the entries (role, text) of user and assistant that say something."""
    role = lambda e: F.lower(F.trim(F.coalesce(e["role"], F.lit(""))))
    text = lambda e: F.btrim(F.coalesce(e["text"], F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    lines = F.transform(F.filter(entries, lambda e: role(e).isin("user", "assistant") & (text(e) != "")), lambda e: F.concat(role(e), F.lit(": "), text(e)))
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit(NO_CONVERSATION))


def with_sources(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """cited with document_id, chunk_index and score of the chunks (item_id, chunk_id, document_id, chunk_index, score)
    behind them; of one that isn't there any more its parent, or itself, and 0."""
    there = chunks.select("item_id", F.col("chunk_id").cast("string").alias("_chunk"), F.col("document_id").cast("string").alias("_document"), F.col("chunk_index").alias("_index"), F.col("score").alias("_score")).dropDuplicates(["item_id", "_chunk"])
    joined = cited.withColumn("_chunk", F.col("chunk_id").cast("string")).join(there, ["item_id", "_chunk"], "left")
    return joined.withColumns({"document_id": F.coalesce("_document", F.nullif("parent_chunk_id", F.lit("")), "_chunk"), "chunk_index": F.coalesce("_index", F.lit(0)), "score": F.round(F.coalesce("_score", F.lit(0.0)), 6)}).drop("_chunk", "_document", "_index", "_score")
