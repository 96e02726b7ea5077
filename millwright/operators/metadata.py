"""Metadata of chunks, written as JSON of several layouts, as the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where each field stands, by layout: flat, nested, and with lists for spans; the first that says something counts.
FIELDS: dict[str, tuple[str, list[str]]] = {
    "parent_chunk_id": ("string", ["$.parent_chunk_id", "$.parent.id", "$.parent"]),
    "retrieval_unit_id": ("string", ["$.retrieval_unit_id", "$.unit.id"]),
    "retrieval_summary": ("string", ["$.retrieval_summary", "$.unit.summary", "$.summary"]),
    "summary_strategy": ("string", ["$.summary_strategy", "$.unit.strategy"]),
    "file_name": ("string", ["$.file_name", "$.source.file", "$.source_file"]),
    "source_path": ("string", ["$.source_path", "$.source.path"]),
    "source_type": ("string", ["$.source_type", "$.source.type"]),
    "section_title": ("string", ["$.section_title", "$.parent.section", "$.section"]),
    "modality": ("string", ["$.modality", "$.parent.modality"]),
    "page_start": ("int", ["$.page_start", "$.parent.pages.first", "$.pages[0]", "$.page_number"]),
    "page_end": ("int", ["$.page_end", "$.parent.pages.last", "$.pages[1]", "$.page_number"]),
    "row_start": ("int", ["$.row_start", "$.parent.rows.first", "$.rows[0]", "$.row_index"]),
    "row_end": ("int", ["$.row_end", "$.parent.rows.last", "$.rows[1]", "$.row_index"]),
}
TAGS = ["$.asset_tags", "$.parent_summary_asset_tags", "$.parent.tags", "$.unit.tags", "$.tags"]
QUESTIONS = ["$.answerable_questions", "$.unit.questions", "$.questions"]


def _value(path: str, kind: str) -> Column:
    """What stands at the path; null for another kind, an object or list, or text without a character."""
    v = F.try_variant_get("_v", path, kind)
    if kind != "string":
        return v
    plain = ~F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    return F.when(plain, F.nullif(v, F.lit("")))


def _first(paths: list[str], kind: str) -> Column:
    return F.coalesce(*(_value(p, kind) for p in paths))


def chunk_fields(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, document_id, chunk_index, metadata, original_filename, storage_path) with FIELDS, asset_tags
    (all layouts' tags, sorted) and questions in place of metadata.

    A parent is the chunk itself, a unit its first summary, a file that of the document, where the metadata names none.
    Metadata that is null or isn't JSON says nothing; a field of another kind says nothing either.
    """
    parsed = chunks.withColumn("_v", F.try_parse_json("metadata"))
    out = {name: _first(paths, kind) for name, (kind, paths) in FIELDS.items()}
    chunk = F.col("chunk_id").cast("string")
    for name, other in (("parent_chunk_id", chunk), ("retrieval_unit_id", F.concat(chunk, F.lit(":summary:0"))), ("file_name", F.col("original_filename")), ("source_path", F.col("storage_path"))):
        out[name] = F.coalesce(out[name], other)
    none = F.array().cast("array<string>")
    tags = F.flatten(F.array(*(F.coalesce(F.try_variant_get("_v", p, "array<string>"), none) for p in TAGS)))
    out["asset_tags"] = F.array_sort(F.array_distinct(F.filter(tags, lambda t: t.isNotNull())))
    out["questions"] = F.coalesce(*(F.try_variant_get("_v", p, "array<string>") for p in QUESTIONS), none)
    return parsed.withColumns(out).drop("_v", "metadata")
