"""Elements of documents of any source into parent chunks, with what their parts say together.

elements: document_id, position (their order), element_id, element_type, text, source_type, file_name, page_number,
row_index, section_title, asset_tags (array), modality, element_summary.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import Formatter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts

# Sizes, kinds of what is seen rather than read, and the wording of summaries and questions.
TARGET_CHARS, OVERSIZED_CHARS, CSV_ROWS = 9000, 11000, 1
VISUAL_MODALITIES, VISUAL_TYPES = ["image", "ocr", "table"], ["table_row", "table_block", "image_caption", "ocr_text"]
ATOMIC_CHARS, PARENT_CHARS = 1200, 1600
ORIGINAL = "{type} original evidence for {id}: {text}"
ATOMIC = "{type} element from {file}. Asset tags: {tags}. Content representation: {text}"
SUMMARY = "{file} {location}. Asset tags: {tags}. Parent evidence summary input: {input}"
QUESTIONS = [
    "What information does {source} provide about {tags}?", "Which checks, actions, or limits are stated for {tags} in this chunk?", "What source evidence is available for {tags} in {file}?",
    "What status, date, or maintenance detail is mentioned for {tags}?", "What operational or compliance issue can be answered from this chunk?",
]
BLANK = " \t\n\r\x0b\x0c"


def said(pattern: str, **values: Column) -> Column:
    """The pattern with columns in its braces."""
    parts = [(F.lit(text), values[name] if name else F.lit("")) for text, name, *_ in Formatter().parse(pattern)]
    return F.concat(*(x for pair in parts for x in pair))


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def is_visual() -> Column:
    """Images, scans and tables; nothing of a csv or md source."""
    return ~F.col("source_type").isin("csv", "md") & (F.col("modality").isin(VISUAL_MODALITIES) | F.col("element_type").isin(VISUAL_TYPES))


def atomic_summaries(elements: DataFrame) -> DataFrame:
    """elements with element_summary of the visual ones that have none: from a template."""
    tags = F.when(F.size("asset_tags") > 0, F.array_join("asset_tags", ", ")).otherwise("none")
    flat = F.btrim(F.regexp_replace("text", r"(?U)\s+", " "))
    summary = said(ATOMIC, type=F.col("element_type"), file=F.col("file_name"), tags=tags, text=F.substring(flat, 1, ATOMIC_CHARS))
    return elements.withColumn("element_summary", F.when(is_visual() & F.col("element_summary").isNull(), summary).otherwise(F.col("element_summary")))


def group_key() -> Column:
    """What elements of one parent share: csv the file, txt and md the section, pdf the page, others both."""
    source = F.col("source_type")
    page = F.when(~source.isin("csv", "txt", "md"), F.col("page_number"))
    section = F.when(~source.isin("csv", "pdf"), F.col("section_title"))
    return F.struct(source, F.col("file_name"), page.isNull().alias("no_page"), page.alias("page"), section.isNull().alias("no_section"), section.alias("section"))


def split_oversized(elements: DataFrame, most: int = OVERSIZED_CHARS) -> DataFrame:
    """elements with part (from 0): those of more than `most` characters in parts of that many, stripped, blank ones left
    out, with :part:n behind their ids."""
    long = F.length("text") > most
    each = elements.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(long, F.ceil(F.length("text") / F.lit(float(most))) - 1).otherwise(0).cast("int"))))
    piece = stripped(F.substr("text", F.col("part") * most + 1, F.lit(most)))
    each = each.withColumn("element_id", F.when(long, F.concat("element_id", F.lit(":part:"), F.col("part").cast("string"))).otherwise(F.col("element_id")))
    return each.withColumn("text", F.when(long, piece).otherwise(F.col("text"))).where(~F.coalesce(long & (F.col("text") == ""), F.lit(False)) & (~F.expr("part > 0") | (F.col("text") != "")))


def numbered(rows: DataFrame, document: str, order: list[str], key: Column, weight: Column, after: Column, most: Column) -> DataFrame:
    """rows with parent (from 0 in their document). A row begins a parent where the key changes, and where what the
    parent's rows weigh so far and `after` of the row pass `most`; a first row is never too much.

    One pass over each document's rows in order, of their numbers alone: time is linear in rows, memory that of a batch.
    """
    names = [*rows.columns, "parent"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", parent int"
    n = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_document, at_key, held, parent = None, None, 0, 0
        for b in batches:
            out = []
            for d, k, w, a, m in zip(*(b.column(n + i).to_pylist() for i in range(5)), strict=True):
                if d != at_document:
                    at_document, at_key, held, parent = d, k, w, 0
                elif k != at_key or held + a > m:
                    at_key, held, parent = k, w, parent + 1
                else:
                    held += w
                out.append(parent)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.int32())], names=names)

    own = [F.xxhash64(F.struct(document)).alias("_document"), F.xxhash64(key).alias("_key"), weight.cast("long").alias("_weight"), after.cast("long").alias("_after"), most.cast("long").alias("_most")]
    return rows.select("*", *own).repartition(document).sortWithinPartitions(document, *order).mapInArrow(run, schema)


def page_texts(elements: DataFrame) -> DataFrame:
    """document_id, page_number, page_id, text of each page: its elements' texts in order, a line each. Elements without
    a page are on none; a null text is an empty line."""
    entry = F.struct("position", F.coalesce("text", F.lit("")).alias("text"))
    by = elements.where("page_number is not null").groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), "\n").alias("text"))
    return by.select("document_id", "page_number", F.sha1(F.concat_ws(":", "document_id", "page_number").cast("binary")).alias("page_id"), "text")


def parents(elements: DataFrame, target: int = TARGET_CHARS, csv_rows: int = CSV_ROWS) -> DataFrame:
    """document_id, parent (from 0), raw_text, text_evidence, file_name, source_type (of several 'unknown'), page_start,
    page_end, row_start, row_end, section_title (the first that isn't blank), element_ids, element_types, asset_tags
    (sorted), modality (the most frequent one, of equals the first), summaries (type, id and text of the elements that
    have one).

    Elements with one group key follow each other into a parent until the next one would pass the target, each counting
    two more than its length; of csv rows csv_rows go into one. A parent's texts are some `target` long, so its group is
    small. A null text is blank; elements without a position come first.
    """
    each = split_oversized(elements.withColumn("text", F.coalesce("text", F.lit(""))))
    csv = F.col("source_type") == "csv"
    weight = F.when(csv, F.col("row_index").isNotNull().cast("int")).otherwise(F.length("text") + 2)
    dealt = numbered(each, "document_id", ["position", "part"], group_key(), weight, F.when(csv, 1).otherwise(F.length("text")), F.when(csv, csv_rows).otherwise(target))
    row = csv & F.col("row_index").isNotNull()
    of_row = F.concat(F.lit("Row "), F.col("row_index").cast("string"), F.lit(": "), "text")
    heading = F.col("element_type") == "heading"
    original = said(ORIGINAL, type=F.col("element_type"), id=F.col("element_id"), text=F.col("text"))
    raw = F.when(heading, F.col("text")).when(is_visual(), original).when(row, of_row).otherwise(F.col("text"))
    evidence = F.when(is_visual() & (F.coalesce("element_summary", F.lit("")) != ""), "").when(heading, F.col("text")).when(row, of_row).when(~is_visual(), F.col("text")).otherwise("")
    entry = F.struct("position", "part", stripped(raw).alias("raw"), stripped(evidence).alias("evidence"), "element_id", "element_type", "section_title", "modality", "file_name", "source_type", "element_summary")
    by = dealt.groupBy("document_id", "parent").agg(
        F.array_sort(F.collect_list(entry)).alias("e"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.min("row_index").alias("row_start"), F.max("row_index").alias("row_end"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("asset_tags", F.array().cast("array<string>")))))).alias("asset_tags"),
    )
    lines = lambda c: F.array_join(F.filter(F.expr(f"e.{c}"), lambda x: x != ""), "\n")
    kinds = F.transform(F.array_distinct(F.expr("e.modality")), lambda m: F.struct(F.size(F.filter(F.expr("e.modality"), lambda x: x == m)).alias("n"), (-F.array_position(F.expr("e.modality"), m)).alias("first"), m.alias("m")))
    source = F.array_distinct(F.expr("e.source_type"))
    with_summary = F.transform(F.filter("e", lambda x: F.coalesce(x["element_summary"], F.lit("")) != ""), lambda x: F.struct(x["element_type"].alias("type"), x["element_id"].alias("id"), x["element_summary"].alias("text")))
    return by.select(
        "document_id", "parent", lines("raw").alias("raw_text"), lines("evidence").alias("text_evidence"), F.expr("e[0].file_name").alias("file_name"), F.when(F.size(source) == 1, source[0]).otherwise("unknown").alias("source_type"), "page_start", "page_end", "row_start", "row_end",
        F.expr("get(filter(e.section_title, x -> x <> ''), 0)").alias("section_title"), F.expr("e.element_id").alias("element_ids"), F.array_sort(F.array_distinct(F.expr("e.element_type"))).alias("element_types"), "asset_tags", F.array_max(kinds)["m"].alias("modality"), with_summary.alias("summaries"),
    )


def with_summaries(parents_: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """parents with summary, questions, summary_tags (those of the parent and of its text) and strategy: from templates,
    or where manual (parent_chunk_id, summary_text, questions) has the parent's id, from there; then an id of manual that
    is no parent's stays unused, and a parent without one is an error."""
    found = F.transform(facts.tags(F.col("raw_text")), lambda t: t["tag"])
    tags = F.array_sort(F.array_union("asset_tags", found))
    listed = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
    span = lambda name, a, b: F.when(F.col(a).isNotNull(), F.concat(F.lit(f"{name} "), F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string")))
    places = F.concat_ws(", ", F.concat(F.lit("section "), "section_title"), span("pages", "page_start", "page_end"), span("rows", "row_start", "row_end"))
    text = stripped(F.when(F.col("text_evidence") != "", F.col("text_evidence")).otherwise(F.col("raw_text")))
    atomic = F.array_join(F.transform("summaries", lambda x: F.concat(F.lit("- "), x["type"], F.lit(" "), x["id"], F.lit(": "), x["text"])), "\n")
    given = F.when(F.size("summaries") == 0, text).otherwise(F.concat(F.lit("Text evidence:\n"), text, F.lit("\n\nAtomic visual summaries:\n"), atomic))
    file, about = F.col("file_name"), listed(F.col("asset_tags"), "the referenced asset")
    template = said(SUMMARY, file=file, location=F.when(places != "", places).otherwise("source location unknown"), tags=listed(tags, "none"), input=F.substring(given, 1, PARENT_CHARS))
    asked = F.array(*(said(q, source=F.coalesce("section_title", "file_name"), tags=about, file=file) for q in QUESTIONS))
    out = parents_.withColumns({"parent_chunk_id": F.concat_ws(":parent:", "document_id", "parent"), "summary": template, "questions": asked, "summary_tags": tags, "strategy": F.lit("parent_passthrough")})
    if manual is None:
        return out
    own = manual.select(F.col("parent_chunk_id").alias("_id"), F.col("summary_text").alias("_summary"), F.col("questions").alias("_questions"))
    out = out.join(own, F.col("parent_chunk_id") == F.col("_id"), "left")
    missing = F.raise_error(F.concat(F.lit("no summary of parent "), "parent_chunk_id"))
    summary = F.when(F.col("_id").isNull(), missing.cast("string")).otherwise(F.col("_summary"))
    return out.withColumns({"summary": summary, "questions": F.coalesce("_questions", "questions"), "strategy": F.lit("manual_parent_llm")}).drop("_id", "_summary", "_questions")
