"""Cleaning and sampling of work orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Equipment numbers that are kept, kinds of orders, columns of the clean table.
EQUIPMENT = r"^(P|PP|COMP|C|HX|R|BLR|B|TK|T|M|MTR|V)-\d+[A-Z]?$"
ORDER_TYPES = {"CM": "CM", "PM": "PM", "PMD": "PM", "PDM": "PDM", "DPM": "PDM", "PPDM": "PDM", "PDDM": "PDM", "PDMM": "PDM"}
COLUMNS = ["Equipment_ID", "OrderType", "WorkOrderDescription", "OperationDescription", "Maintenance_activity_type", "CreatedDate", "ActualStartDate", "ActualFinishDate", "OrderStatus", "MaintenanceWorkCenter"]
PUMPS, SAMPLED = ["P-101", "P-102", "P-201"], ["TK", "M", "HX", "R", "BLR", "C"]
MOST = 60


def cleaned(orders: DataFrame) -> DataFrame:
    """Orders of known equipment and kind, both in capitals without blanks, with those of COLUMNS that there are."""
    kinds = F.create_map(*(F.lit(x) for pair in ORDER_TYPES.items() for x in pair))
    o = orders.withColumn("Equipment_ID", F.upper(F.trim("Equipment_ID"))).withColumn("OrderType", F.try_element_at(kinds, F.upper(F.trim("OrderType"))))
    kept = o.where(F.col("Equipment_ID").rlike(EQUIPMENT) & F.col("OrderType").isNotNull())
    return kept.select(*(c for c in COLUMNS if c in orders.columns))


def most_frequent(orders: DataFrame, prefixes: list[str]) -> DataFrame:
    """prefix, Equipment_ID: of each prefix the equipment with most orders, ties by name."""
    n = orders.groupBy("Equipment_ID").agg(F.count("*").alias("n")).withColumn("prefix", F.regexp_extract("Equipment_ID", "^([A-Z]+)-", 1)).where(F.col("prefix").isin(prefixes))
    order = Window.partitionBy("prefix").orderBy(F.desc("n"), "Equipment_ID")
    return n.withColumn("r", F.row_number().over(order)).where("r = 1").select("prefix", "Equipment_ID")


def sampled(orders: DataFrame, named: list[str] = PUMPS, prefixes: list[str] = SAMPLED, most: int = MOST) -> DataFrame:
    """At most `most` orders of each named equipment and of each prefix's most frequent one, those of the smallest hashes."""
    chosen = reduce(DataFrame.unionByName, [orders.sparkSession.createDataFrame([(x,) for x in named], "Equipment_ID string"), most_frequent(orders, prefixes).select("Equipment_ID")]).distinct()
    h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in orders.columns)))
    kept = orders.join(F.broadcast(chosen), "Equipment_ID", "left_semi").withColumn("h", h)  # a few names
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("Equipment_ID").orderBy("h"))).where(F.col("r") <= most).drop("r", "h")
