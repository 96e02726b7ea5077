"""Analytics over all assets at once. mentions: the columns of sources.star.mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.text import contains_any


def with_haystack(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("haystack", F.concat_ws(" ", F.lower("filename"), F.lower("text")))


def asset_facts(mentions: DataFrame) -> DataFrame:
    """Counts of mentions, documents, chunks and entities by tag."""
    return mentions.groupBy("tag").agg(F.count("*").alias("mention_count"), F.countDistinct("document_id").alias("document_count"), F.countDistinct("document_id", "chunk_index").alias("chunk_count"), F.countDistinct("entity_id").alias("entity_count"))


def risk(mentions: DataFrame) -> DataFrame:
    """Risk score, level, mentions, documents and last date by tag: any mention's keyword counts once."""
    m = with_haystack(mentions)
    flags = [F.max(contains_any(F.col("haystack"), keywords).cast("int")).alias(name) for name, _, keywords in rules.RISK]
    by = m.groupBy("tag").agg(*flags, F.count("*").alias("mentions"), F.countDistinct("document_id").alias("documents"), F.max("created_at").alias("last_seen"))
    score = sum((F.col(name) * points for name, points, _ in rules.RISK), F.lit(0))
    reasons = F.array_join(F.filter(F.array(*(F.when(F.col(name) == 1, F.lit(name)) for name, _, _ in rules.RISK)), lambda x: x.isNotNull()), "|")
    return by.select("tag", score.cast("long").alias("score"), reasons.alias("reasons"), "mentions", "documents", "last_seen").withColumn("level", rules.level(F.col("score")))


def risk_summary(mentions: DataFrame, limit: int = 10) -> DataFrame:
    return risk(mentions).orderBy(F.desc("score"), F.desc("mentions"), "tag").limit(limit)


def risk_histogram(mentions: DataFrame) -> DataFrame:
    return risk(mentions).groupBy("level").agg(F.count("*").alias("assets"))


def timeline(mentions: DataFrame) -> DataFrame:
    """Category and severity of each mention."""
    m = with_haystack(mentions)
    return m.select("tag", "document_id", "chunk_index", "created_at", rules.first_match(F.col("haystack"), rules.TIMELINE, "evidence_mention").alias("event_type"), rules.first_match(F.col("haystack"), rules.SEVERITY, "low").alias("severity"))


def timeline_counts(mentions: DataFrame) -> DataFrame:
    return timeline(mentions).groupBy("tag", "event_type", "severity").agg(F.count("*").alias("events"), F.max("created_at").alias("latest"))


def _modes(mentions: DataFrame) -> tuple[DataFrame, list[str]]:
    """tag, document_id, created_at of each mention and a flag for each failure mode, named as the mode."""
    named = {name: contains_any(F.col("haystack"), keywords) for name, keywords in rules.FAILURE_MODES}
    return with_haystack(mentions).select("tag", "document_id", "created_at", *(c.alias(n) for n, c in named.items())), [*named]


def failure_modes(mentions: DataFrame) -> DataFrame:
    """Events by tag and failure mode; repeated: two or more. Counted by tag in one pass, then a row for each mode."""
    m, names = _modes(mentions)
    by = m.groupBy("tag").agg(*(F.count_if(n).alias(n) for n in names))
    each = by.select("tag", F.explode(F.array(*(F.struct(F.lit(n).alias("mode"), F.col(n).alias("events")) for n in names))).alias("m")).select("tag", "m.*")
    return each.where("events > 0").withColumn("repeated", F.col("events") >= 2)


def failure_hotspots(mentions: DataFrame, limit: int = 10) -> DataFrame:
    """Tags with most failure events, their documents, different modes, last date and coverage. Each text is searched
    once; a filter on what was found would search it again for each keyword. Documents are counted by a group of their
    own, summed before it is sent."""
    m, names = _modes(mentions)
    failed = m.withColumn("failed", F.greatest(*names))
    of_document = failed.groupBy("tag", "document_id").agg(F.count_if("failed").alias("n"), F.max(F.when(F.col("failed"), F.col("created_at"))).alias("last_failure"), *(F.max(n).alias(n) for n in names))
    by = of_document.groupBy("tag").agg(F.sum("n").alias("failure_events"), F.count_if(F.col("n") > 0).alias("documents"), F.max("last_failure").alias("last_failure"), *(F.max(n).alias(n) for n in names)).where("failure_events > 0")
    different = sum((F.col(n).cast("long") for n in names), F.lit(0).cast("long"))
    out = by.select("tag", "failure_events", "documents", "last_failure", different.alias("distinct_modes"), rules.coverage(F.col("failure_events"), F.col("documents")).alias("coverage"))
    return out.orderBy(F.desc("failure_events"), F.desc("distinct_modes"), "tag").limit(limit)


def maintenance_actions(mentions: DataFrame, per_asset: int = 8) -> DataFrame:
    """The newest mentions of maintenance by tag."""
    m = with_haystack(mentions).where(contains_any(F.col("haystack"), rules.MAINTENANCE))
    order = Window.partitionBy("tag").orderBy(F.desc_nulls_last("created_at"), F.desc("document_id"), "chunk_index")
    return m.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_asset).select("tag", "place", "document_id", "chunk_index")


def documents_of_assets(mentions: DataFrame, top: int = 3) -> DataFrame:
    """The documents with most mentions by tag."""
    by = mentions.groupBy("tag", "document_id").agg(F.count("*").alias("mentions"), F.max("created_at").alias("created_at"))
    order = Window.partitionBy("tag").orderBy(F.desc("mentions"), F.desc("created_at"), F.desc("document_id"))
    return by.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("tag", "place", "document_id", "mentions")


def edges(mentions: DataFrame) -> DataFrame:
    """Distinct graph edges: each mention gives one to its document, its chunk and its entity."""
    source = F.concat(F.lit("asset:"), F.col("tag"))
    document, chunk, entity = F.col("document_id").cast("string"), F.concat_ws("-", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")), F.col("entity_id").cast("string")
    each = F.array(*(F.struct(F.lit(k).alias("relation_type"), F.concat(F.lit(p), x).alias("target")) for k, p, x in (("mentioned_in", "document:", document), ("supported_by_chunk", "chunk:", chunk), ("has_entity", "entity:", entity))))
    return mentions.select(source.alias("source"), F.explode(each).alias("e")).select("source", "e.relation_type", "e.target").where("target is not null").distinct()


def edge_counts(mentions: DataFrame) -> DataFrame:
    return edges(mentions).groupBy("relation_type").agg(F.count("*").alias("edges"), F.countDistinct("source").alias("assets"))
