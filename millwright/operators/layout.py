"""Text into elements (headings, paragraphs, lists) and elements into parent chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .parents import numbered

# Words of headings, how a list item begins, sizes of parents and of the parts of a long element.
HEADING_WORDS = ["procedure", "scope", "startup", "shutdown", "inspection", "checklist", "manual", "requirements", "findings", "limits", "maintenance"]
LIST_ITEM = r"^\s*(?:[-*]|\d+[.)])\s+"
PARENT_CHARS, LONG_CHARS, HEADING_CHARS, HEADING_LENGTH = 9000, 11000, 90, 10
BLANK = " \t\n\r\x0b\x0c"


def looks_like_heading(line: Column) -> Column:
    """line: stripped. Short, and ends in a colon, or all capitals, or has a heading's word among ten at most."""
    t = F.btrim(F.btrim(line, F.lit("#")), F.lit(BLANK))
    capitals = (F.upper(t) == t) & (F.lower(t) != t)
    worded = F.lit(False)
    for w in HEADING_WORDS:
        worded = worded | F.lower(t).contains(w)
    few = F.size(F.split(t, r"\s+")) <= HEADING_LENGTH
    return (F.length(t) > 0) & (F.length(t) <= HEADING_CHARS) & (t.endswith(":") | capitals | (worded & few))


def elements(docs: DataFrame) -> DataFrame:
    """doc_id, element (number from 0), element_type, section, text: headings, and runs of lines of one kind between
    blank lines and headings. A document's lines are one window; null and empty texts have no elements."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line")).withColumn("line", F.btrim("line", F.lit(BLANK)))
    marked = F.col("line").startswith("#")
    kind = F.when(F.col("line") == "", "blank").when(marked | looks_like_heading(F.col("line")), "heading").when(F.col("line").rlike(LIST_ITEM), "list_item").otherwise("paragraph")
    each = lines.withColumn("kind", kind)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    starts = (F.col("kind") == "heading") | (F.col("kind") != F.lag("kind", 1, "none").over(order))
    title = F.when(marked, F.btrim(F.regexp_replace("line", "^#+", ""), F.lit(BLANK))).otherwise(F.regexp_replace("line", ":+$", ""))
    each = each.withColumn("run", F.sum(starts.cast("int")).over(order)).withColumn("line", F.when(F.col("kind") == "heading", title).otherwise(F.col("line")))
    each = each.withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("line")), ignorenulls=True).over(order))
    runs = each.where("kind <> 'blank'").groupBy("doc_id", "run").agg(F.first("kind").alias("element_type"), F.max("section").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return runs.select("doc_id", number.alias("element"), "element_type", "section", "text")


def split_long(elements_: DataFrame, most: int = LONG_CHARS) -> DataFrame:
    """elements with part (from 0): those of more than `most` characters in parts of that many, stripped, empty ones left out."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / F.lit(float(most))) - 1, F.lit(0)).cast("int"))
    each = elements_.withColumn("part", F.explode(starts))
    piece = F.btrim(F.substr("text", F.col("part") * most + 1, F.lit(most)), F.lit(BLANK))
    return each.withColumn("text", F.when(F.length("text") > most, piece).otherwise(F.col("text"))).where("text <> ''")


def parents(elements_: DataFrame, target: int = PARENT_CHARS) -> DataFrame:
    """doc_id, parent (number from 0), section, text, elements (how many), types (sorted) of the parent chunks.

    Elements of one section go together until the next one would pass the target; each counts two more than its length.
    One pass over a document's elements, in order.
    """
    length = F.length("text")
    dealt = numbered(split_long(elements_), "doc_id", ["element", "part"], F.struct("section"), length + 2, length, F.lit(target))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "part", "text"))), lambda x: x["text"]), "\n")
    return dealt.groupBy("doc_id", "parent").agg(F.first("section").alias("section"), text.alias("text"), F.count("*").alias("elements"), F.array_sort(F.collect_set("element_type")).alias("types"))
