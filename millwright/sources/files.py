"""Files as rows: tables, texts, JSON lines; and the sinks beside them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import facts
from .snapshots import exists

# Kinds of files by extension and by content type; cells that say nothing.
EXTENSIONS = {"txt": "txt", "md": "md", "markdown": "md", "csv": "csv", "json": "json", "jsonl": "json", "pdf": "pdf", "xlsx": "xlsx", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "bmp": "image", "tif": "image", "tiff": "image"}
CONTENT_TYPES = {"text/plain": "txt", "text/markdown": "md", "text/csv": "csv", "application/json": "json", "application/pdf": "pdf"}
EMPTY = ["", "nan", "none"]


def kind_of(name: str, content_type: str | None = None) -> str:
    """The kind of a file by its extension, or else its content type; an error if neither is known."""
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    kind = EXTENSIONS.get(extension) or CONTENT_TYPES.get((content_type or "").split(";")[0].strip().lower())
    if kind is None:
        raise ValueError(f"unsupported file: {name}")
    return kind


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, document_id, text of each whole file, stripped."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), facts.stable_id(F.input_file_name()).alias("document_id"), F.btrim("value", F.lit(" \t\n\r\x0b\x0c")).alias("text"))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A table with all columns as text, quoted cells with line breaks whole; the delimiter that its first line has most of."""
    if delimiter is None:
        head = spark.read.text(path).limit(1).collect()
        line = head[0][0] if head else ","
        delimiter = max(",;\t|", key=line.count)
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', sep=delimiter)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that isn't JSON gives no row."""
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(row.alias("r")).where("r._bad is null").select("r.*").drop("_bad")


def manual_summaries(spark: SparkSession, path: str) -> DataFrame:
    """parent_chunk_id, summary_text, metadata of a file of summaries; an error on a line that isn't JSON, a missing or
    repeated id, or a missing text, when the rows are read."""
    rows = spark.read.schema("parent_chunk_id string, summary_text string, metadata map<string,string>").json(path, mode="FAILFAST")
    n = F.count("*").over(Window.partitionBy("parent_chunk_id"))
    good = (F.coalesce(F.trim("parent_chunk_id"), F.lit("")) != "") & (F.coalesce(F.trim("summary_text"), F.lit("")) != "") & (n == 1)
    return rows.withColumn("_good", good).where(F.when(F.col("_good"), True).otherwise(F.raise_error(F.lit("summary without id or text, or with a repeated id")).cast("boolean"))).drop("_good")


def row_text(rows: DataFrame, columns: list[str], sheet: str | None = None) -> Column:
    """'column: value' lines of the cells that say something."""
    cell = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    lines = [F.when(~F.lower(cell(c)).isin(EMPTY), F.concat(F.lit(f"{c}: "), cell(c))) for c in columns]
    return F.concat_ws("\n", *([F.lit(f"Sheet: {sheet}")] if sheet else []), *lines)


def labelled_row_text(rows: DataFrame, columns: list[str]) -> Column:
    """'column': value. sentences of the cells that aren't blank."""
    cell = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    end = lambda c: F.when(cell(c).rlike(r"[.!?;:]$"), "").otherwise(".")
    return F.concat_ws(" ", *(F.when(cell(c) != "", F.concat(F.lit(f"'{c}': "), cell(c), end(c))) for c in columns))


def row_chunks(rows: DataFrame, document: str, order: list[str], columns: list[str], sheet: str | None = None) -> DataFrame:
    """document_id, chunk_index, text, char_start, char_end and the facts of each row with text; the offsets run on
    through each document, a line break between its rows."""
    number = F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1
    found = facts.row_facts(rows.select(*columns))
    each = rows.withColumn("_n", number).withColumn("_text", row_text(rows, columns, sheet)).where("_text <> ''")
    before = F.sum(F.length("_text") + 1).over(Window.partitionBy(document).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return each.select(F.col(document).alias("document_id"), F.col("_n").alias("chunk_index"), F.col("_text").alias("text"), start.alias("char_start"), (start + F.length("_text")).alias("char_end"), *(v.alias(f"fact_{k}") for k, v in found.items()))


def write_once(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table at path doesn't have yet, each key once. Null keys are equal."""
    spark, fresh = rows.sparkSession, rows.dropDuplicates(keys)
    if exists(spark, path):
        there = spark.read.schema(rows.schema).parquet(path).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        fresh = fresh.join(there, same, "left_anti")
    fresh.write.mode("append").parquet(path)


def write_markdown(pages: DataFrame, folder: str) -> int:
    """Each of pages (file_name, markdown) as a file of its own in the folder, which is made if it isn't there; how many.

    A file is written beside its place and moved there whole, so a task that runs again leaves one whole file. A name
    that isn't a plain one (blank, dots alone, with a slash or a control character) or stands twice is an error, before
    anything is written. A null text is an empty file. The folder is local to all, or a URI that Arrow's file systems reach.
    """
    name = F.coalesce("file_name", F.lit(""))
    plain = ~name.rlike(r"[/\\\x00-\x1F]") & ~name.rlike(r"^[.\s]*$")
    odd = pages.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.bool_and(plain).alias("plain")).where("n > 1 or not plain").first()
    if odd is not None:
        raise ValueError(f"not a name of one file: {odd.name!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(at, recursive=True)
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = f"{at}/.{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write((text or "").encode())
                system.move(own, f"{at}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return pages.select("file_name", "markdown").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    """A folder with the report's summary (one row) and results as JSON lines; an older report there is replaced."""
    if (n := summary.count()) != 1:
        raise ValueError(f"a report has one summary, not {n}")
    results.write.mode("overwrite").json(f"{path}/results")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def read_report(spark: SparkSession, path: str, summary: str, results: str) -> tuple[DataFrame, DataFrame]:
    """summary and results of a report, by their schemas; an error where there is none, where the summary isn't one row,
    or where a line isn't JSON."""
    if not exists(spark, f"{path}/summary") or not exists(spark, f"{path}/results"):
        raise FileNotFoundError(f"no report at {path}")
    one = spark.read.schema(summary).json(f"{path}/summary", mode="FAILFAST")
    if one.count() != 1:
        raise ValueError(f"malformed report at {path}: no summary")
    return one, spark.read.schema(results).json(f"{path}/results", mode="FAILFAST")
