"""Documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import decontaminate, line_dedup, packing, quality, simhash
from millwright.llm.common import hidden, stored, table, with_row

#: SimHash groups, near-copies removal and packing aren't SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null text goes; rows that are alike are judged each; columns stay as
    they are, whatever their names. An empty table gives an empty one.

    The row number keeps the filter above the projection that computes kept: pushed below it, the filter would hold all
    of kept's nested expressions, each evaluated as often as it is named.
    """
    given, columns = hidden(docs, "text", "lang")
    return quality.assessed(given).withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0").select(columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen before; one of which no word is left goes, a null text too. n_chars follows the
    text where lines went. Rows that share a doc_id or have none are documents each; other columns stay as they are,
    whatever their names. An empty table gives an empty one."""
    given, columns = hidden(docs, "doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    left = line_dedup.deduplicated(given).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: that with the smallest doc_id, a null one last; of rows that share it, one of them.
    Null texts and texts without words are one group. Other columns stay as they are, whatever their names. An empty
    table gives an empty one."""
    given, columns = hidden(docs, "doc_id", "text")
    rows = with_row(given)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("key")
    copies = simhash.near_duplicates(rows.select(key, "text"), id_column="key").where("id <> component_id")
    found = stored(copies.select(F.col("id._row").alias("_copy_row")), "copies")
    return rows.join(found, F.col("_row") == F.col("_copy_row"), "left_anti").select(columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by a benchmark item, each row judged by itself; null texts stay. Other columns
    stay as they are, whatever their names. An empty table gives an empty one."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; a null text is the end id alone, each row has pieces of its own.
    Columns other than doc_id and text aren't read. An empty table gives an empty one."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
