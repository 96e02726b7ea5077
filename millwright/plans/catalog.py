"""The engine's queries by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import analytics, compliance, evaluation, retrieval
from ..sources import star
from . import graph_queries, search_queries, text_queries
from .sql import GAPS, MODES, RISK, SEGMENTS, STAR, case, contains

Query = Callable[[SparkSession, str], DataFrame]


def _vectors(per_label: int | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = star.table(spark, sf_dir, "embeddings")
        q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        return retrieval.vector_topk(v, q, 5, per_label)

    return run


def _over_mentions(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(star.mentions(spark, sf_dir))


def _over_findings(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(star.findings(spark, sf_dir))


def _query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tx.query_tokens(F.col("text"))
    return star.table(spark, sf_dir, "benchmark").select("item_id", F.size(tokens).alias("n"), F.array_join(tokens, "|").alias("tokens"))


def _previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


def _json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return star.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("total"), F.max(k).alias("largest"))


def _dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"documents": "orders", "chunks": "lineitem", "assets": "part", "entities": "supplier"}
    counts = [star.table(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in names.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def _recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.documents(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("document_id")).limit(5)


def _asset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.assets(spark, sf_dir).groupBy("tag").agg(F.min_by("asset_type", "p_partkey").alias("asset_type"), F.min("p_partkey").alias("first_part"), F.count("*").alias("parts"))


def _top_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.mentions(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "tag").limit(5)


def _prefix_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most mentioned tag of each prefix."""
    by = star.mentions(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("mentions"))
    best = by.groupBy(F.regexp_extract("tag", "^([A-Z]+)-", 1).alias("prefix")).agg(F.max(F.struct("mentions", F.expr("-int(substring_index(tag, '-', -1))").alias("low"), "tag")).alias("m"))
    return best.select("prefix", "m.tag", "m.mentions")


def _filtered_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of 'n_chars is over 1000' against the gold labels of quality."""
    j = star.table(spark, sf_dir, "labels").join(star.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    said, gold = F.col("n_chars") > 1000, F.col("quality") == 1
    c = j.agg(F.count_if(said & gold).alias("tp"), F.count_if(said & ~gold).alias("fp"), F.count_if(~said & gold).alias("fn"))
    return evaluation.scored(c)


QUERIES: dict[str, Query] = {
    "vector_topk": _vectors(None),
    "vector_topk_capped": _vectors(2),
    "chunk_windows": lambda s, d: retrieval.chunk_windows(star.table(s, d, "documents")),
    "hashing_embedding": lambda s, d: retrieval.hashing_embedding(star.table(s, d, "documents")),
    "query_tokens": _query_tokens,
    "text_preview": _previews,
    "asset_registry": _asset_registry,
    "asset_facts": _over_mentions(analytics.asset_facts),
    "asset_documents": _over_mentions(analytics.documents_of_assets),
    "mention_edges": _over_mentions(analytics.edge_counts),
    "timeline_events": _over_mentions(analytics.timeline_counts),
    "risk_assets": _over_mentions(analytics.risk),
    "risk_summary": _over_mentions(analytics.risk_summary),
    "risk_histogram": _over_mentions(analytics.risk_histogram),
    "failure_modes": _over_mentions(analytics.failure_modes),
    "failure_hotspots": _over_mentions(analytics.failure_hotspots),
    "maintenance_actions": _over_mentions(analytics.maintenance_actions),
    "compliance_segments": _over_findings(lambda e: compliance.segments(e).select("tag", "document_id", "chunk_index", "span")),
    "compliance_gaps": _over_findings(compliance.gaps),
    "compliance_counts": _over_findings(compliance.gap_counts),
    "top_assets": _top_assets,
    "recent_documents": _recent_documents,
    "dashboard_counts": _dashboard_counts,
    "prefix_mode": _prefix_mode,
    "chat_memory": lambda s, d: retrieval.chat_memory(star.table(s, d, "conversations")),
    "chat_sessions": lambda s, d: retrieval.chat_sessions(star.table(s, d, "conversations")),
    "json_props": _json_props,
    "eval_precision_recall": _filtered_label_quality,
} | graph_queries.QUERIES | text_queries.QUERIES | search_queries.QUERIES


def _topk(capped: bool) -> str:
    scored = "SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id"
    if capped:
        scored = f"SELECT query_id, vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM ({scored})) WHERE r <= 2"
    return f"SELECT query_id, CAST(place AS INTEGER) AS place, vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM ({scored})) WHERE place <= 5"


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
ORACLE_SQL: dict[str, str] = {
    "vector_topk": _topk(False),
    "vector_topk_capped": _topk(True),
    "chunk_windows": "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 800 AS INTEGER) AS start, CAST(length(substring(text, i * 800 + 1, 1000)) AS INTEGER) AS chars, md5(substring(text, i * 800 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 1000) / 800.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)",
    "hashing_embedding": r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS w FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS bucket, CASE WHEN CAST('0x' || substr(md5(w), 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM words),
v AS (SELECT doc_id, bucket, sum(s) AS v FROM h GROUP BY doc_id, bucket HAVING sum(s) <> 0)
SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 4) AS value FROM v""",
    "query_tokens": f"""WITH t AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.-]*'), lambda t: trim(t, '._-')), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})) AS a FROM benchmark),
d AS (SELECT item_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM t) SELECT item_id, CAST(len(a) AS INTEGER) AS n, coalesce(array_to_string(a, '|'), '') AS tokens FROM d""",
    "text_preview": r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(substring(t, 1, 217)) || '...' END AS preview FROM f",
    "asset_registry": f"{STAR} SELECT tag, arg_min(asset_type, p_partkey) AS asset_type, min(p_partkey) AS first_part, count(*) AS parts FROM assets GROUP BY tag",
    "asset_facts": f"{STAR} SELECT tag, count(*) AS mention_count, count(DISTINCT document_id) AS document_count, count(DISTINCT (document_id, chunk_index)) AS chunk_count, count(DISTINCT entity_id) AS entity_count FROM star GROUP BY tag",
    "asset_documents": f"{STAR}, g AS (SELECT tag, document_id, count(*) AS mentions, max(created_at) AS created_at FROM star GROUP BY tag, document_id) SELECT tag, CAST(place AS INTEGER) AS place, document_id, mentions FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY mentions DESC, created_at DESC, document_id DESC) AS place FROM g) WHERE place <= 3",
    "mention_edges": f"""{STAR}, e AS (SELECT DISTINCT * FROM (SELECT tag, 'mentioned_in' AS relation_type, CAST(document_id AS VARCHAR) AS target FROM star UNION ALL SELECT tag, 'supported_by_chunk', document_id || '-' || chunk_index FROM star UNION ALL SELECT tag, 'has_entity', CAST(entity_id AS VARCHAR) FROM star))
SELECT relation_type, count(*) AS edges, count(DISTINCT tag) AS assets FROM e GROUP BY relation_type""",
    "timeline_events": f"{STAR}, t AS (SELECT tag, created_at, {case(rules.TIMELINE, 'evidence_mention')} AS event_type, {case(rules.SEVERITY, 'low')} AS severity FROM star) SELECT tag, event_type, severity, count(*) AS events, max(created_at) AS latest FROM t GROUP BY tag, event_type, severity",
    "risk_assets": f"{RISK} SELECT * FROM risk",
    "risk_summary": f"{RISK} SELECT * FROM risk ORDER BY score DESC, mentions DESC, tag LIMIT 10",
    "risk_histogram": f"{RISK} SELECT level, count(*) AS assets FROM risk GROUP BY level",
    "failure_modes": f"{MODES} SELECT tag, mode, count(*) AS events, count(*) >= 2 AS repeated FROM hit GROUP BY tag, mode",
    "failure_hotspots": f"""{MODES}, ev AS (SELECT DISTINCT tag, document_id, chunk_index, created_at FROM hit), g AS (SELECT tag, count(*) AS failure_events, count(DISTINCT document_id) AS documents, max(created_at) AS last_failure FROM ev GROUP BY tag),
d AS (SELECT tag, count(DISTINCT mode) AS distinct_modes FROM hit GROUP BY tag) SELECT tag, failure_events, documents, last_failure, distinct_modes, CASE WHEN failure_events >= 4 AND documents >= 2 THEN 'high' WHEN failure_events >= 2 THEN 'medium' ELSE 'low' END AS coverage FROM g JOIN d USING (tag) ORDER BY failure_events DESC, distinct_modes DESC, tag LIMIT 10""",
    "maintenance_actions": f"{STAR} SELECT tag, CAST(place AS INTEGER) AS place, document_id, CAST(chunk_index AS INTEGER) AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY created_at DESC NULLS LAST, document_id DESC, chunk_index) AS place FROM star WHERE {contains(rules.MAINTENANCE)}) WHERE place <= 8",
    "compliance_segments": f"{SEGMENTS} SELECT tag, document_id, CAST(chunk_index AS INTEGER) AS chunk_index, span FROM segments",
    "compliance_gaps": f"{GAPS} SELECT * FROM gaps",
    "compliance_counts": f"{GAPS} SELECT gap_type, severity, count(*) AS gaps, count(DISTINCT tag) AS assets FROM gaps GROUP BY gap_type, severity",
    "top_assets": f"{STAR} SELECT tag, count(*) AS mentions FROM star GROUP BY tag ORDER BY mentions DESC, tag LIMIT 5",
    "recent_documents": f"{STAR} SELECT document_id, filename, created_at FROM docs ORDER BY created_at DESC, document_id DESC LIMIT 5",
    "dashboard_counts": "SELECT 'documents' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'chunks', count(*) FROM lineitem UNION ALL SELECT 'assets', count(*) FROM part UNION ALL SELECT 'entities', count(*) FROM supplier",
    "prefix_mode": f"{STAR}, g AS (SELECT tag, count(*) AS mentions FROM star GROUP BY tag) SELECT prefix, tag, mentions FROM (SELECT split_part(tag, '-', 1) AS prefix, tag, mentions, row_number() OVER (PARTITION BY split_part(tag, '-', 1) ORDER BY mentions DESC, CAST(split_part(tag, '-', 2) AS INTEGER)) AS r FROM g) WHERE r = 1",
    "chat_memory": "SELECT conv_id, CAST(back AS INTEGER) AS back, turn, role, CAST(length(text) AS INTEGER) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 6",
    "chat_sessions": "SELECT conv_id, count(*) AS message_count, greatest(count(*) - 6, 0) AS summarized, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS user_messages FROM conversations GROUP BY conv_id",
    "json_props": "SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY event_type",
    "eval_precision_recall": """WITH c AS (SELECT count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000 AND quality <> 1) AS fp, count(*) FILTER (NOT n_chars > 1000 AND quality = 1) AS fn FROM labels JOIN documents USING (doc_id))
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 4) AS f1 FROM c""",
} | graph_queries.ORACLE_SQL | text_queries.ORACLE_SQL | search_queries.ORACLE_SQL
