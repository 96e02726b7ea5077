"""A folder of texts and tables into documents, elements, parent chunks, embeddings and mentions, a snapshot at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts
from ..operators import hybrid, layout, parents
from . import delimited, snapshots

#: By extension: what a file is read as. Others are skipped, and counted.
TEXTS, TABLES = ["txt", "md"], ["csv"]
ELEMENT = "path string, digest string, document_id string, position int, element_id string, element_type string, text string, source_type string, file_name string, page_number int, row_index int, section_title string, asset_tags array<string>, modality string, element_summary string"
CHUNK = "path string, digest string, document_id string, chunk_id string, chunk_index int, text string, summary string, questions array<string>, asset_tags array<string>, strategy string, file_name string, source_type string, section_title string, row_start int, row_end int, modality string"
#: Counts of a commit, taken while its tables are written.
OBSERVED = {"documents": {"skipped": "count_if(status = 'skipped')", "elements": "sum(elements)"}, "chunks": {"passthrough": "count_if(strategy = 'parent_passthrough')", "manual": "count_if(strategy = 'manual_parent_llm')", "chars": "sum(length(text))"}, "mentions": {"known": "count_if(asset_type is not null)"}}


def _extension() -> Column:
    return F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))


def _named(files: DataFrame) -> DataFrame:
    """files with document_id, file_name, source_type."""
    return files.withColumns({"document_id": facts.stable_id(F.col("path")), "file_name": F.element_at(F.split("path", "/"), -1), "source_type": _extension()})


def _csv_rows(files: DataFrame) -> DataFrame:
    """path, digest, position, row_index, text of each row of a table that says something; whole files, as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, digest, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                d = delimited.sniffed(content[: delimited.SAMPLE], "first")
                text = content[d.body :].decode("utf-8", "replace")
                rows = [(i, cells) for i, cells in enumerate((r for r in delimited.records(text, d) if r), 1)]
                n = len(rows)
                columns = [pa.array([path] * n), pa.array([digest] * n), pa.array([i for i, _ in rows], pa.int32()), pa.array([d.columns] * n, pa.list_(pa.string())), pa.array([c for _, c in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "digest", "row_index", "columns", "cells"])

    rows = files.select("path", "digest", "content").mapInArrow(run, "path string, digest string, row_index int, columns array<string>, cells array<string>")
    return delimited.labelled(rows).select("path", "digest", "row_index", "text")


def elements(files: DataFrame) -> DataFrame:
    """ELEMENT rows of files (path, digest, content): texts by their layout, tables by row, a header first. A file without
    a word, or of another kind, has none; bytes that aren't UTF-8 become U+FFFD."""
    ext = _extension()
    texts = files.where(ext.isin(TEXTS)).select(F.struct("path", "digest").alias("doc_id"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "").alias("text"))
    laid = layout.elements(texts).select("doc_id.path", "doc_id.digest", F.col("element").alias("position"), "element_type", "text", F.lit(None).cast("int").alias("row_index"), F.col("section").alias("section_title"))
    rows = _csv_rows(files.where(ext.isin(TABLES)))
    cells = rows.select("path", "digest", (F.col("row_index") - 1).alias("position"), F.lit("paragraph").alias("element_type"), "text", "row_index", F.lit(None).cast("string").alias("section_title"))
    each = _named(laid.unionByName(cells))
    kind = F.when(F.col("row_index").isNotNull(), "csv_row").otherwise(F.col("element_type"))
    tags = F.transform(facts.tags(F.col("text")), lambda t: t["tag"])
    return each.withColumns({"element_id": F.concat_ws(":", "document_id", F.lit("element"), kind, "position"), "page_number": F.lit(None).cast("int"), "asset_tags": tags, "modality": F.lit("text"), "element_summary": F.lit(None).cast("string")}).select(*(c.split()[0] for c in ELEMENT.split(", ")))


def chunks(elements_: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """CHUNK rows of elements."""
    of = elements_.groupBy("document_id").agg(F.first("path").alias("path"), F.first("digest").alias("digest"))
    p = parents.with_summaries(parents.parents(elements_), manual).join(of, "document_id")
    return p.select("path", "digest", "document_id", F.col("parent_chunk_id").alias("chunk_id"), F.col("parent").alias("chunk_index"), F.col("raw_text").alias("text"), "summary", "questions", F.col("summary_tags").alias("asset_tags"), "strategy", "file_name", "source_type", "section_title", "row_start", "row_end", "modality")


def extract(files: DataFrame, manual: DataFrame | None = None) -> dict[str, snapshots.Rows]:
    """The tables of some files; each is made from those written before it."""

    def documents(written: dict[str, DataFrame]) -> DataFrame:
        n = written["elements"].groupBy("path").agg(F.count("*").alias("elements"), F.sum(F.length("text")).alias("chars"))
        out = _named(files.select("path", "digest")).join(n, "path", "left").withColumns({"elements": F.coalesce("elements", F.lit(0)), "chars": F.coalesce("chars", F.lit(0))})
        return out.withColumn("status", F.when(F.col("elements") > 0, "processed").otherwise("skipped"))

    def embeddings(written: dict[str, DataFrame]) -> DataFrame:
        c = written["chunks"].select(F.struct("path", "digest", "chunk_id").alias("id"), F.concat_ws("\n", "summary", F.array_join("questions", "\n")).alias("text"))
        return hybrid.hashed(c).select("id.*", F.lit("local-hashing-v1").alias("model"), F.col("places.at").alias("at"), F.col("places.value").alias("value"))

    def mentions(written: dict[str, DataFrame]) -> DataFrame:
        found = written["chunks"].select("path", "digest", "document_id", "chunk_id", F.explode(facts.tags(F.col("text"))).alias("t"))
        return found.select("path", "digest", "document_id", "chunk_id", "t.*")

    return {"elements": elements(files), "chunks": lambda w: chunks(w["elements"], manual), "documents": documents, "embeddings": embeddings, "mentions": mentions}


def ingest(spark: SparkSession, folder: str, root: str, manual: DataFrame | None = None, files_a_commit: int = 10_000, force: bool = False) -> list[dict[str, int]]:
    """Brings the tables under root up to the files in folder; what each commit counted (see snapshots.ingest)."""
    return snapshots.ingest(spark, folder, root, lambda files: extract(files, manual), OBSERVED, files_a_commit, force)
