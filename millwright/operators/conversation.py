"""Memory of conversations: what is summarized, what stays, and how a question is put in scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import facts

RECENT, SUMMARY_CHARS = 6, 1400
BLANK = " \t\n\r\x0b\x0c"


def history(messages: DataFrame) -> DataFrame:
    """conv_id, role, said, place (from 1), n of the messages that count: of user and assistant, not blank."""
    said = F.btrim("text", F.lit(BLANK))
    m = messages.where(F.col("role").isin("user", "assistant")).withColumn("said", said).where("said <> ''")
    w = Window.partitionBy("conv_id")
    return m.select("conv_id", "turn", "role", "said", F.row_number().over(w.orderBy("turn")).alias("place"), F.count("*").over(w).alias("n"))


def summaries(messages: DataFrame, already: DataFrame | None = None) -> DataFrame:
    """conv_id, cursor (messages summarized), summary: all but the last RECENT messages, added to what was summarized
    before (already: conv_id, cursor, summary), of which the last SUMMARY_CHARS characters stay."""
    h = history(messages)
    if already is None:
        h = h.withColumn("old_cursor", F.lit(0)).withColumn("old", F.lit(None).cast("string"))
    else:
        h = h.join(already.select("conv_id", F.col("cursor").alias("old_cursor"), F.col("summary").alias("old")), "conv_id", "left").withColumn("old_cursor", F.coalesce("old_cursor", F.lit(0)))
    line = F.concat("role", F.lit(": "), "said")
    new = F.when((F.col("place") > F.col("old_cursor")) & (F.col("place") <= F.col("n") - RECENT), F.struct("place", line.alias("line")))
    by = h.groupBy("conv_id").agg(F.max("n").alias("n"), F.max("old_cursor").alias("old_cursor"), F.max("old").alias("old"), F.array_sort(F.collect_list(new)).alias("lines"))
    text = F.concat_ws("\n", F.nullif(F.btrim("old", F.lit(BLANK)), F.lit("")), F.nullif(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("")))
    return by.select("conv_id", F.greatest("old_cursor", F.col("n") - RECENT, F.lit(0)).cast("long").alias("cursor"), F.expr("1").alias("_"), F.when(F.size("lines") > 0, F.right(text, F.lit(SUMMARY_CHARS))).otherwise(F.col("old")).alias("summary")).drop("_")


def memory(messages: DataFrame, summaries_: DataFrame) -> DataFrame:
    """conv_id, entries (role and text): the summary, if there is one, and the last RECENT messages."""
    recent = history(messages).where(F.col("place") > F.col("n") - RECENT)
    by = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "said"))).alias("m"))
    first = F.when(F.col("summary").isNotNull() & (F.col("summary") != ""), F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("Conversation summary: "), "summary").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return by.join(summaries_, "conv_id", "left").select("conv_id", F.concat(first, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["said"].alias("text")))).alias("entries"))


def sessions(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, title (of its first message), messages: of every conversation, also those without messages."""
    by = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min_by("text", "turn").alias("first"))
    return conversations.join(by, "conv_id", "left").select("conv_id", F.coalesce(facts.title(F.col("first")), F.lit("New chat")).alias("title"), F.coalesce("messages", F.lit(0)).cast("long").alias("messages"))
