"""Assets, their mentions and the graph around them, with the joins that may miss.

mentions: mention_id, tag, document_id, chunk_index, entity_id; documents: document_id, filename, created_at; chunks:
document_id, chunk_index, text; entities: entity_id, name. A mention whose document, chunk or entity is gone stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import facts, rules
from ..functions import text as tx

def newest() -> list[Column]:
    return [F.desc_nulls_last("created_at"), F.asc_nulls_last("chunk_index"), F.asc("mention_id")]


def extracted_tags(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_index, tag, raw, position, asset_type, confidence of each distinct tag in each chunk."""
    each = chunks.select("document_id", "chunk_index", F.explode(facts.tags(F.coalesce("text", F.lit("")))).alias("t"))
    return each.select("document_id", "chunk_index", "t.*")


def evidence(mentions: DataFrame, documents: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Each mention with what is left of its document, chunk and entity; found_* say which are."""
    d = documents.select("document_id", "filename", "created_at", F.lit(True).alias("found_document"))
    c = chunks.select(F.col("document_id").alias("chunk_document"), F.col("chunk_index").alias("found_chunk"), "text")
    e = entities.select("entity_id", F.col("name").alias("entity_name"))
    m = mentions.select("mention_id", "tag", "document_id", F.col("chunk_index").alias("said_chunk"), "entity_id")
    out = m.join(e, "entity_id", "left").join(d, "document_id", "left")
    out = out.join(c, F.expr("document_id = chunk_document and said_chunk = found_chunk"), "left")
    return out.withColumnRenamed("found_chunk", "chunk_index").drop("said_chunk", "chunk_document")


def asset_mentions(evidence_: DataFrame) -> DataFrame:
    """Mentions of each tag in order: newest document first, by chunk, those without one last."""
    place = F.row_number().over(Window.partitionBy("tag").orderBy(*newest()))
    return evidence_.select("tag", place.alias("place"), "mention_id", "document_id", "filename", "chunk_index", "entity_name", tx.preview(F.col("text")).alias("preview"))


def reasons(haystack: Column) -> Column:
    """Names of the timeline categories and severities whose keywords the text has, in order."""
    named = [*rules.TIMELINE, *rules.SEVERITY]
    return F.array_distinct(F.flatten(F.array(*(F.filter(F.array(*(F.when(haystack.contains(k), F.lit(k)) for k in keys)), lambda x: x.isNotNull()) for _, keys in named))))


def timeline(evidence_: DataFrame) -> DataFrame:
    """An event for each mention: tag, mention_id, event_type, severity, reason_tags, title, date, preview."""
    haystack = F.concat_ws(" ", F.lower(F.coalesce("filename", F.lit(""))), F.lower(F.coalesce("text", F.lit(""))))
    e = evidence_.withColumn("haystack", haystack)
    said = F.when(F.col("filename").isNull(), F.concat("tag", F.lit(" mentioned"))).otherwise(F.concat("tag", F.lit(" mentioned in "), "filename"))
    return e.select(
        "tag", "mention_id", rules.first_match(F.col("haystack"), rules.TIMELINE, "evidence_mention").alias("event_type"), rules.first_match(F.col("haystack"), rules.SEVERITY, "low").alias("severity"),
        reasons(F.col("haystack")).alias("reason_tags"), said.alias("title"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), tx.preview(F.col("text")).alias("preview"), "document_id", "filename", "chunk_index",
    )


def graph_edges(evidence_: DataFrame, include_chunks: bool = True, relation_type: str | None = None) -> DataFrame:
    """tag, relation_type, target: distinct edges to what is there."""
    chunk = F.when(F.col("chunk_index").isNotNull(), F.concat(F.lit("chunk:"), "document_id", F.lit("-"), "chunk_index"))
    kinds = {"mentioned_in": F.when(F.col("found_document"), F.concat(F.lit("document:"), "document_id")), "supported_by_chunk": chunk, "has_entity": F.when(F.col("entity_name").isNotNull(), F.concat(F.lit("entity:"), "entity_id"))}
    if not include_chunks:
        del kinds["supported_by_chunk"]
    if relation_type is not None:
        kinds = {k: v for k, v in kinds.items() if k == relation_type}
    each = F.array(*(F.struct(F.lit(k).alias("relation_type"), v.alias("target")) for k, v in kinds.items()))
    return evidence_.select("tag", F.explode(each).alias("e")).select("tag", "e.*").where("target is not null").distinct()


def graph_nodes(evidence_: DataFrame, assets: DataFrame, include_chunks: bool = True, relation_type: str | None = None) -> DataFrame:
    """tag, node, type, label: the tag itself and all nodes that an edge reaches."""
    edges = graph_edges(evidence_, include_chunks, relation_type)
    documents = evidence_.where("found_document").select(F.concat(F.lit("document:"), "document_id").alias("target"), F.col("filename").alias("label")).distinct()
    entities = evidence_.where("entity_name is not null").select(F.concat(F.lit("entity:"), "entity_id").alias("target"), F.col("entity_name").alias("label")).distinct()
    named = edges.join(documents.union(entities), "target", "left")
    label = F.coalesce("label", F.concat(F.lit("chunk #"), F.substring_index("target", "-", -1)))
    own = assets.select("tag", F.concat(F.lit("asset:"), "tag").alias("node"), F.lit("asset").alias("type"), F.col("tag").alias("label")).distinct()
    return own.union(named.select("tag", F.col("target").alias("node"), F.substring_index("target", ":", 1).alias("type"), label.alias("label")))


def graph_summary(evidence_: DataFrame) -> DataFrame:
    """Counts of mentions, documents, chunks and entities by tag, and the document with most of its mentions."""
    by = evidence_.groupBy("tag").agg(F.count("*").alias("mentions"), F.countDistinct(F.when(F.col("found_document"), F.col("document_id"))).alias("documents"), F.countDistinct(F.when(F.col("chunk_index").isNotNull(), F.struct("document_id", "chunk_index"))).alias("chunks"), F.countDistinct(F.when(F.col("entity_name").isNotNull(), F.col("entity_id"))).alias("entities"))
    per = evidence_.where("found_document").groupBy("tag", "document_id").agg(F.count("*").alias("n"))
    top = per.groupBy("tag").agg(F.max(F.struct("n", "document_id")).alias("m")).select("tag", F.col("m.document_id").alias("top_document"), F.col("m.n").alias("top_mentions"))
    return by.join(top, "tag", "left")


def endpoint_edges(edges: DataFrame, node: str) -> DataFrame:
    """Edges (source, relation_type, target) that begin or end at the node."""
    return edges.where((F.col("source") == node) | (F.col("target") == node))


def new_edges(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct incoming rows that existing lacks; two nulls are the same."""
    there = existing.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = eq if same is None else same & eq
    return incoming.dropDuplicates(keys).join(there, same, "left_anti")


def orphans(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges (document_id and any others) whose document isn't there."""
    return edges.join(documents.select("document_id"), "document_id", "left_anti")


def without_files(documents: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents without those of the file names, and edges without those that led to them."""
    kept = documents.join(names.select("filename").distinct(), "filename", "left_anti")
    return kept, edges.join(kept.select("document_id"), "document_id", "left_semi")


def registered(existing: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """tag, asset_type: existing assets and the new tags among incoming (tag, asset_type, seen_at; of one tag the first).
    Tags are compared stripped and in capitals. force: incoming types replace existing ones."""
    plain = F.upper(F.trim("tag")).alias("tag")
    first = incoming.select(plain, "asset_type", "seen_at").where("tag <> ''").groupBy("tag").agg(F.min_by(F.struct("asset_type"), "seen_at").alias("a")).select("tag", "a.asset_type")
    old = existing.select(plain, "asset_type")
    if force:
        new = first.select("tag", F.col("asset_type").alias("new_type"))
        old = old.join(new, "tag", "left").select("tag", F.coalesce("new_type", "asset_type").alias("asset_type"))
    return old.union(first.join(old.select("tag"), "tag", "left_anti"))


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the values of changes that aren't null."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    return rows.join(new, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def to_embed(chunks: DataFrame, active: str, force: bool = False) -> DataFrame:
    """chunk_id, text to embed (its summary, or else its text) of the chunks whose vectors are of another model, or none."""
    stale = F.lit(True) if force else ~F.col("embedding_model").eqNullSafe(active)
    said = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.col("text"))
    return chunks.where(stale & F.col("text").isNotNull()).select("chunk_id", said.alias("text"))


def document_details(documents: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """document_id, filename, assets (tags that the document mentions, sorted) and entities (those that its mentions name,
    by id) of each document, also of one without mentions.

    One group by document, distinct before it is sent, takes the place of a lookup for each asset and document.
    """
    pairs = mentions.where("document_id is not null").select("document_id", "tag", "entity_id").distinct()
    named = pairs.join(entities.select("entity_id", F.col("name").alias("entity")), "entity_id", "left")
    by = named.groupBy("document_id").agg(F.array_sort(F.collect_set("tag")).alias("assets"), F.array_sort(F.collect_set(F.when(F.col("entity").isNotNull(), F.struct("entity_id", "entity")))).alias("entities"))
    none = F.array().cast("array<string>")
    names = F.transform("entities", lambda x: x["entity"])
    return documents.select("document_id", "filename").join(by, "document_id", "left").select("document_id", "filename", F.coalesce("assets", none).alias("assets"), F.coalesce(names, none).alias("entities"))


def risk_evidence(evidence_: DataFrame, most: int = 3) -> DataFrame:
    """tag, score, level, reasons, mentions, documents (that are there), last_seen, evidence (document_id, filename,
    chunk_index and preview of the newest `most` mentions whose chunk is there), of every asset with a mention.

    The newest are cut to `most` in each task before they are sent. A mention whose document and chunk are gone counts,
    and says nothing.
    """
    m = evidence_.withColumn("haystack", F.concat_ws(" ", F.lower("filename"), F.lower("text")))
    flags = [F.max(tx.contains_any(F.col("haystack"), keywords).cast("int")).alias(name) for name, _, keywords in rules.RISK]
    by = m.groupBy("tag").agg(*flags, F.count("*").alias("mentions"), F.countDistinct(F.when(F.col("found_document"), F.col("document_id"))).alias("documents"), F.max("created_at").alias("last_seen"))
    score = sum((F.col(name) * points for name, points, _ in rules.RISK), F.lit(0)).cast("long")
    reasons = F.array_join(F.filter(F.array(*(F.when(F.col(name) == 1, F.lit(name)) for name, _, _ in rules.RISK)), lambda x: x.isNotNull()), "|")
    place = F.row_number().over(Window.partitionBy("tag").orderBy(*newest()))
    said = evidence_.where("text <> ''").withColumn("place", place).where(F.col("place") <= most)
    entry = F.struct("place", "document_id", "filename", "chunk_index", tx.preview(F.col("text")).alias("preview"))
    cited = said.groupBy("tag").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # `most` rows a tag
    none = F.array().cast("array<struct<document_id:bigint,filename:string,chunk_index:int,preview:string>>")
    shown = F.transform("e", lambda x: F.struct(x["document_id"].cast("long").alias("document_id"), x["filename"].alias("filename"), x["chunk_index"].cast("int").alias("chunk_index"), x["preview"].alias("preview")))
    out = by.select("tag", score.alias("score"), reasons.alias("reasons"), "mentions", "documents", "last_seen").withColumn("level", rules.level(F.col("score")))
    return out.join(cited, "tag", "left").select("tag", "score", "level", "reasons", "mentions", "documents", "last_seen", F.coalesce(shown, none).alias("evidence"))
