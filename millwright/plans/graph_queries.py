"""Queries over the graph of assets and what follows from it, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import analytics, causes, compliance, evaluation, graph
from ..sources import star
from .sql import FILE, GAPS, RISK, RISK_FLAGS, RISK_REASONS, RISK_SCORE, STAR, TYPE, case, contains

Query = Callable[[SparkSession, str], DataFrame]
SYMPTOMS = ["high vibration after seal replacement", "motor overheating, then a trip", "oil leak and corrosion at the flange", "strange smell"]


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.evidence(**{("chunks" if k == "chunks" else k): v for k, v in star.gone(spark, sf_dir).items()})


def _tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.extracted_tags(star.findings(spark, sf_dir)).select("document_id", "chunk_index", "tag", "position", "asset_type", "confidence")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.timeline(_evidence(spark, sf_dir)).select("tag", "mention_id", "event_type", "severity", F.array_join("reason_tags", "|").alias("reasons"), "title", "date", "preview")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_edges(_evidence(spark, sf_dir))


def _nodes(relation_type: str | None, include_chunks: bool) -> Query:
    return lambda spark, sf_dir: graph.graph_nodes(_evidence(spark, sf_dir), star.assets(spark, sf_dir), include_chunks, relation_type)


def _new_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of documents from 1997 on that no older document gave; the chunk of every third edge isn't known."""
    m = star.mentions(spark, sf_dir).withColumn("chunk", F.when(F.col("chunk_index") % 3 > 0, F.col("chunk_index")))
    edges = m.select("tag", "entity_id", "chunk", "created_at")
    new = F.col("created_at") >= F.lit("1997-01-01").cast("timestamp_ntz")
    return graph.new_edges(edges.where(~new), edges.where(new).select("tag", "entity_id", "chunk"), ["tag", "entity_id", "chunk"])


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.gone(spark, sf_dir)
    return graph.orphans(g["mentions"].select("tag", "document_id"), g["documents"]).groupBy("tag").agg(F.count("*").alias("orphans"))


def _scoped_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = star.documents(spark, sf_dir)
    names = d.where("document_id % 4 = 0").select("filename")
    kept, edges = graph.without_files(d, star.mentions(spark, sf_dir).select("tag", "document_id"), names)
    return kept.agg(F.lit("documents").alias("name"), F.count("*").alias("left")).union(edges.agg(F.lit("edges").alias("name"), F.count("*").alias("left")))


def _registered(force: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = star.assets(spark, sf_dir)
        old = a.where("p_partkey % 3 = 0").groupBy("tag").agg(F.lit("unknown").alias("asset_type"))
        new = a.where("p_partkey % 2 = 0").select(F.concat(F.lit(" "), F.lower("tag"), F.lit(" ")).alias("tag"), "asset_type", F.col("p_partkey").alias("seen_at"))
        return graph.registered(old, new, force)

    return run


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = star.documents(spark, sf_dir).select("document_id", "filename", F.lit("uploaded").alias("status"))
    changes = d.where("document_id % 2 = 0").select("document_id", F.when(F.col("document_id") % 3 == 0, "renamed.txt").alias("filename"), F.when(F.col("document_id") % 5 == 0, "extracted").alias("status"))
    return graph.updated(d, changes, "document_id")


def _reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("chunk_id") % 3 == 0, "local-hashing-v1").when(F.col("chunk_id") % 3 == 1, "older")
    chunks = star.passages(spark, sf_dir).withColumn("embedding_model", model).withColumn("summary", F.when(F.col("chunk_id") % 2 == 0, F.col("summary")))
    return graph.to_embed(chunks, "local-hashing-v1").select("chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at each of two nodes."""
    e = analytics.edges(star.mentions(spark, sf_dir))
    return graph.endpoint_edges(e, "entity:3").union(graph.endpoint_edges(e, "asset:P-101")).distinct()


def _documents_with_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.gone(spark, sf_dir)
    failed = g["mentions"].join(g["chunks"].where(F.col("text").contains("Repeated failure")), ["document_id", "chunk_index"], "left_semi")
    return g["documents"].join(failed, "document_id", "left_semi").select("document_id", "filename")


def _vector_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = star.table(spark, sf_dir, "embeddings").where("embedding is not null")
    three = F.transform(F.slice("embedding", 1, 3), lambda x: F.format_string("%.4f", x.cast("double")))
    return v.select("vec_id", F.size("embedding").alias("dimension"), F.array_join(three, "|").alias("preview"))


def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section, name, value: counts of all tables, assets by risk level and by reason, the most mentioned assets."""
    m = star.mentions(spark, sf_dir)
    risk = analytics.risk(m)
    long = lambda df, section, name, value: df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("long").alias("value"))
    tables = {"documents": "orders", "chunks": "lineitem", "assets": "part", "entities": "supplier", "sessions": "conversations", "events": "events"}
    out = long(risk.groupBy("level").agg(F.count("*").alias("n")), "risk", "level", "n")
    out = out.union(long(risk.select(F.explode(F.split("reasons", r"\|")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n")), "reason", "reason", "n"))
    out = out.union(long(m.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(5), "top", "tag", "n"))
    for name, t in tables.items():
        out = out.union(star.table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit("rows"), F.lit(name), "n"))
    return out


def _symptoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, SYMPTOMS)), (F.col("p_partkey") % len(SYMPTOMS) + 1).cast("int"))
    return star.assets(spark, sf_dir).groupBy("tag").agg(F.min("p_partkey").alias("p_partkey")).select("tag", said.alias("symptom"))


def _root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = causes.root_causes(_symptoms(spark, sf_dir), star.mentions(spark, sf_dir).select("tag", "document_id", "chunk_index", "created_at", "text"))
    return found.select("tag", "number", "cause", "confidence", F.col("support").cast("long").alias("support"), F.array_join("evidence", "|").alias("evidence"), F.size("actions").alias("n_actions"), F.size("missing").alias("n_missing"))


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, findings = star.mentions_by_tag(spark, sf_dir)
    p = causes.packages(graph.timeline(left), compliance.open_kinds(findings))
    return p.select("tag", "mentions", "documents", "gaps", "high_gaps", F.size("inspection").alias("n_inspection"), F.size("maintenance").alias("n_maintenance"), F.array_join("missing", "|").alias("missing"), "summary")


def _browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pumps and motors with '1' in their tag and their risk; assets without mentions have none."""
    risk = analytics.risk(star.mentions(spark, sf_dir)).select("tag", "level", "score", "last_seen")
    found = star.assets(spark, sf_dir).select("tag", "asset_type").distinct().where(F.contains(F.lower("tag"), F.lit("1")) & F.col("asset_type").isin("pump", "motor"))
    return found.join(risk, "tag", "left").select("tag", "asset_type", F.coalesce("level", F.lit("low")).alias("level"), "score", "last_seen").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("last_seen"), "tag")


def _risk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = graph.risk_evidence(_evidence(spark, sf_dir))
    said = F.transform("evidence", lambda x: F.concat_ws(":", x["document_id"].cast("string"), x["chunk_index"].cast("string"), F.coalesce(x["filename"], F.lit("-")), x["preview"]))
    return r.select("tag", "score", "level", "reasons", "mentions", "documents", F.col("last_seen").cast("string").alias("last_seen"), F.array_join(said, "|").alias("evidence"))


def _document_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.gone(spark, sf_dir)
    d = graph.document_details(star.documents(spark, sf_dir), g["mentions"].where("document_id % 3 <> 0"), g["entities"])
    return d.select("document_id", "filename", F.array_join("assets", "|").alias("assets"), F.array_join("entities", "|").alias("entities"))


def _autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.assets(spark, sf_dir).select("tag").distinct().where(F.contains(F.lower("tag"), F.lit("p-1"))).orderBy("tag").limit(5)


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.assets(spark, sf_dir).groupBy("asset_type").agg(F.countDistinct("tag").alias("assets")).where("asset_type is not null").orderBy("asset_type")


def _latest_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date of each failure mode by tag, and the entities that it names."""
    m = analytics.with_haystack(star.mentions(spark, sf_dir)).withColumn("mode", F.explode(rules.modes(F.col("haystack"))))
    return m.groupBy("tag", "mode").agg(F.max("created_at").alias("latest"), F.array_join(F.array_sort(F.collect_set("entity_id")).cast("array<string>"), "|").alias("entities"))


def _entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.extracted_tags(star.findings(spark, sf_dir)).select("document_id", "tag")
    return evaluation.precision_recall(found, star.mentions(spark, sf_dir).where("chunk_index < 3").select("document_id", "tag"), ["document_id", "tag"])


def _completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.gone(spark, sf_dir)
    edges = _edges(spark, sf_dir).where("relation_type = 'mentioned_in'").select("tag", "target")
    return evaluation.completeness(edges, g["mentions"].select("tag", F.concat(F.lit("document:"), "document_id").alias("target")), ["tag", "target"])


QUERIES: dict[str, Query] = {
    "tag_extract": _tag_extract,
    "asset_mentions": lambda s, d: graph.asset_mentions(_evidence(s, d)),
    "asset_timeline": _timeline,
    "graph_edges": _edges,
    "graph_nodes": _nodes(None, True),
    "graph_nodes_pruned": _nodes("mentioned_in", False),
    "graph_summary": lambda s, d: graph.graph_summary(_evidence(s, d)),
    "edge_upsert": _new_edges,
    "orphan_edges": _orphans,
    "scoped_delete": _scoped_delete,
    "asset_upsert": _registered(False),
    "asset_seed": _registered(True),
    "partial_update": _updated,
    "reindex_queue": _reindex,
    "endpoint_edges": _endpoint,
    "mentioned_documents": _documents_with_mentions,
    "vector_preview": _vector_preview,
    "dashboard_summary": _dashboard,
    "failure_intelligence": lambda s, d: causes.failure_intelligence(star.mentions(s, d)),
    "root_causes": _root_causes,
    "evidence_packages": _packages,
    "gap_records": lambda s, d: compliance.gap_records(star.findings(s, d), F.lit("2025-03-01").cast("date")).withColumn("certified", F.col("certified").cast("string")),
    "gap_tabs": lambda s, d: compliance.gap_tabs(star.findings(s, d)),
    "asset_browse": _browse,
    "risk_evidence": _risk_evidence,
    "document_details": _document_details,
    "asset_autocomplete": _autocomplete,
    "asset_types": _types,
    "latest_modes": _latest_modes,
    "entity_scores": _entity_scores,
    "graph_completeness": _completeness,
}

# --- SQL ---------------------------------------------------------------------------------------------------------------

GONE = f"""{STAR}, m AS (SELECT document_id * 1000 + chunk_index AS mention_id, * FROM star),
kept AS (SELECT document_id, filename, created_at FROM docs WHERE document_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')),
ev AS (SELECT m.tag, m.mention_id, m.document_id, m.entity_id, k.filename, k.created_at, k.document_id IS NOT NULL AS found_document,
  CASE WHEN m.chunk_index % 5 <> 4 THEN m.chunk_index END AS chunk_index, CASE WHEN m.chunk_index % 5 <> 4 THEN m.text END AS text, s.s_name AS entity_name
  FROM m LEFT JOIN kept k ON m.document_id = k.document_id LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0) s ON m.entity_id = s.s_suppkey)
"""
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_PREVIEW = f"CASE WHEN length({_FLAT}) <= 220 THEN {_FLAT} ELSE rtrim(substring({_FLAT}, 1, 217)) || '...' END"
EVENTS = f"""{GONE}, hay AS (SELECT *, lower(coalesce(filename, '')) || ' ' || lower(coalesce(text, '')) AS haystack FROM ev),
tl AS (SELECT tag, mention_id, document_id, chunk_index, filename, {case(rules.TIMELINE, 'evidence_mention')} AS event_type, {case(rules.SEVERITY, 'low')} AS severity,
  array_to_string(list_filter([{', '.join(f"CASE WHEN contains(haystack, '{k}') AND NOT ({' OR '.join(['false'] + [repr(k) + ' = ' + repr(x) for x in before])}) THEN '{k}' END" for k, before in ((k, [x for _, ks in [*rules.TIMELINE, *rules.SEVERITY] for x in ks][:i]) for i, k in enumerate(x for _, ks in [*rules.TIMELINE, *rules.SEVERITY] for x in ks)))}], lambda x: x IS NOT NULL), '|') AS reasons,
  CASE WHEN filename IS NULL THEN tag || ' mentioned' ELSE tag || ' mentioned in ' || filename END AS title, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS date, {_PREVIEW} AS preview FROM hay)
"""
EDGES = f"""{GONE}, e AS (SELECT DISTINCT * FROM (SELECT tag, 'mentioned_in' AS relation_type, 'document:' || document_id AS target FROM ev WHERE found_document
UNION ALL SELECT tag, 'supported_by_chunk', 'chunk:' || document_id || '-' || chunk_index FROM ev WHERE chunk_index IS NOT NULL UNION ALL SELECT tag, 'has_entity', 'entity:' || entity_id FROM ev WHERE entity_name IS NOT NULL))
"""
_NODES = """ SELECT DISTINCT tag, 'asset:' || tag AS node, 'asset' AS type, tag AS label FROM assets UNION ALL
SELECT tag, target, split_part(target, ':', 1), CASE split_part(target, ':', 1) WHEN 'document' THEN (SELECT any_value(filename) FROM kept WHERE 'document:' || document_id = target)
  WHEN 'entity' THEN (SELECT any_value(s_name) FROM supplier WHERE 'entity:' || s_suppkey = target) ELSE 'chunk #' || list_last(string_split(target, '-')) END FROM e"""


def _registered_sql(force: bool) -> str:
    kept = "coalesce(f.asset_type, 'unknown')" if force else "'unknown'"
    return f"""{STAR}, old AS (SELECT DISTINCT tag FROM assets WHERE p_partkey % 3 = 0), f AS (SELECT tag, arg_min_null(asset_type, p_partkey) AS asset_type FROM assets WHERE p_partkey % 2 = 0 GROUP BY tag)
SELECT old.tag, {kept} AS asset_type FROM old LEFT JOIN f USING (tag) UNION ALL SELECT tag, asset_type FROM f WHERE tag NOT IN (SELECT tag FROM old)"""


def _cause_sql(i: int, c: causes.Cause) -> str:
    has = " OR ".join(f"contains(lower(x), '{k}')" for k in c.indicators)
    said = " OR ".join(f"contains(symptom, '{k}')" for k in c.indicators)
    asked = " OR ".join(f"contains(symptom, '{k}')" for k in c.triggers)
    cause = c.cause.replace("'", "''")
    hit = f"list_filter(list_zip(texts, chunks), lambda z: {has.replace('lower(x)', 'lower(z[1])')})"
    return f"SELECT tag, {i} AS number, '{cause}' AS cause, len({hit}) AS support, array_to_string(list_slice(CASE WHEN len({hit}) > 0 THEN list_transform({hit}, lambda z: z[2]) ELSE list_slice(chunks, 1, 1) END, 1, 3), '|') AS evidence, {len(c.actions)} AS n_actions, {len(c.missing)} AS n_missing FROM j WHERE ({asked}) AND (({said}) OR len({hit}) > 0)"


_SYMPTOM = "list_extract([" + ", ".join(f"'{x}'" for x in SYMPTOMS) + f"], CAST(min(p_partkey) % {len(SYMPTOMS)} + 1 AS INTEGER))"
_UNKNOWN = causes.UNKNOWN.split("{}")
ROOT_CAUSES = f"""{STAR}, sy AS (SELECT tag, {_SYMPTOM} AS symptom FROM assets GROUP BY tag),
newest AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY created_at DESC, document_id DESC, chunk_index) AS r FROM star),
j AS (SELECT tag, symptom, list(text ORDER BY r) AS texts, list(document_id || '-' || chunk_index ORDER BY r) AS chunks FROM newest JOIN sy USING (tag) WHERE r <= 10 GROUP BY tag, symptom),
c AS ({' UNION ALL '.join(_cause_sql(i, c) for i, c in enumerate(causes.CAUSES, 1))}),
every AS (SELECT * FROM c UNION ALL SELECT tag, 0, '{_UNKNOWN[0]}' || tag || '{_UNKNOWN[1]}', 0, array_to_string(list_slice(chunks, 1, 2), '|'), 1, 1 FROM j WHERE tag NOT IN (SELECT tag FROM c))
SELECT tag, CAST(number AS INTEGER) AS number, cause, CASE WHEN support = 0 THEN 0.25 ELSE round(least(0.3 + 0.12 * support, 0.75), 2) END AS confidence, CAST(support AS BIGINT) AS support, evidence, CAST(n_actions AS INTEGER) AS n_actions, CAST(n_missing AS INTEGER) AS n_missing FROM every"""

_MISSING = ", ".join([f"CASE WHEN list_contains(kinds, '{k}') THEN '{t}' END" for k, t in causes.MISSING] + [f"CASE WHEN n_inspection = 0 THEN '{causes.NO_INSPECTION}' END", f"CASE WHEN n_maintenance = 0 THEN '{causes.NO_MAINTENANCE}' END"])
PACKAGES = f"""{GAPS}, {EVENTS.removeprefix(STAR).lstrip(', ')},
f AS (SELECT tag, count(*) AS mentions, count(DISTINCT CASE WHEN filename IS NOT NULL THEN document_id END) AS documents FROM tl GROUP BY tag),
og AS (SELECT tag, count(*) AS gaps, count(*) FILTER (severity = 'high') AS high_gaps, list(gap_type) AS kinds FROM gaps GROUP BY tag),
once AS (SELECT tag, document_id, chunk_index, substring(preview, 1, 60) AS start, arg_max(event_type, (coalesce(date, ''), -mention_id)) AS event_type FROM tl WHERE preview IS NOT NULL GROUP BY ALL),
n AS (SELECT tag, least(count(*) FILTER (event_type IN ('inspection', 'failure', 'compliance')), 12) AS n_inspection, least(count(*) FILTER (event_type IN ('work_order', 'procedure')), 12) AS n_maintenance FROM once GROUP BY tag),
p AS (SELECT f.tag, mentions, documents, coalesce(gaps, 0) AS gaps, coalesce(high_gaps, 0) AS high_gaps, coalesce(kinds, []) AS kinds, coalesce(n_inspection, 0) AS n_inspection, coalesce(n_maintenance, 0) AS n_maintenance FROM f LEFT JOIN og USING (tag) LEFT JOIN n USING (tag))
SELECT tag, mentions, documents, gaps, high_gaps, CAST(n_inspection AS INTEGER) AS n_inspection, CAST(n_maintenance AS INTEGER) AS n_maintenance, concat_ws('|', {_MISSING}) AS missing,
tag || ' is supported by ' || mentions || ' evidence mention(s) across ' || documents || ' source document(s). The compliance engine detected ' || gaps || ' open gap(s), ' || high_gaps || ' at high severity, all backed by cited evidence.' AS summary FROM p"""

_SAID = "tag || ' ' || said || ' Certificate expired elsewhere.'"
_COUNTS = ", ".join(f"count(*) FILTER ({contains(k)}) AS {n}" for n, k in rules.FAILURE_MODES)
_FAILED = " OR ".join(contains(k) for _, k in rules.FAILURE_MODES)
_MODE_LIST = "[" + ", ".join(f"{{'n': -{n}, 'mode': '{n}'}}" for n, _ in rules.FAILURE_MODES) + "]"
_HIT = " UNION ALL ".join(f"SELECT tag, created_at, entity_id, '{n}' AS mode FROM star WHERE {contains(k)}" for n, k in rules.FAILURE_MODES)
_TAGS = f"""{STAR}, fi AS (SELECT DISTINCT tag, document_id, chunk_index, tag || ' ' || list_extract([{', '.join(f"'{x}'" for x in star.FINDINGS)}], CAST((document_id + 7 * chunk_index + entity_id) % {len(star.FINDINGS)} + 1 AS INTEGER)) || ' Certificate expired elsewhere.' AS said FROM star),
raw AS (SELECT document_id, chunk_index, said, regexp_extract_all(said, '\\b[A-Za-z]{{1,4}}-\\d{{1,4}}[A-Za-z]?\\b') AS found FROM fi),
tags AS (SELECT document_id, chunk_index, said, unnest(list_filter(found, lambda x, i: list_position(found, x) = i)) AS tag FROM raw)
"""

ORACLE_SQL: dict[str, str] = {
    "tag_extract": f"{_TAGS} SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, upper(tag) AS tag, CAST(strpos(said, tag) - 1 AS INTEGER) AS position, {TYPE} AS asset_type, CASE WHEN {TYPE} IS NULL THEN 0.6 ELSE 0.95 END AS confidence FROM tags",
    "asset_mentions": f"{GONE} SELECT tag, CAST(row_number() OVER (PARTITION BY tag ORDER BY created_at DESC NULLS LAST, chunk_index ASC NULLS LAST, mention_id) AS INTEGER) AS place, mention_id, document_id, filename, CAST(chunk_index AS INTEGER) AS chunk_index, entity_name, {_PREVIEW} AS preview FROM ev",
    "asset_timeline": f"{EVENTS} SELECT tag, mention_id, event_type, severity, reasons, title, date, preview FROM tl",
    "graph_edges": f"{EDGES} SELECT * FROM e",
    "graph_nodes": f"{EDGES} {_NODES}",
    "graph_nodes_pruned": f"{EDGES} {_NODES} WHERE relation_type = 'mentioned_in'",
    "graph_summary": f"""{GONE}, n AS (SELECT tag, count(*) AS mentions, count(DISTINCT CASE WHEN found_document THEN document_id END) AS documents, count(DISTINCT CASE WHEN chunk_index IS NOT NULL THEN document_id * 1000 + chunk_index END) AS chunks, count(DISTINCT CASE WHEN entity_name IS NOT NULL THEN entity_id END) AS entities FROM ev GROUP BY tag),
top AS (SELECT tag, document_id AS top_document, n AS top_mentions FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, document_id DESC) AS r FROM (SELECT tag, document_id, count(*) AS n FROM ev WHERE found_document GROUP BY tag, document_id)) WHERE r = 1) SELECT * FROM n LEFT JOIN top USING (tag)""",
    "edge_upsert": f"""{STAR}, x AS (SELECT tag, entity_id, CASE WHEN chunk_index % 3 > 0 THEN chunk_index END AS chunk, created_at >= TIMESTAMP '1997-01-01' AS new FROM star)
SELECT DISTINCT tag, entity_id, CAST(chunk AS INTEGER) AS chunk FROM x WHERE new AND NOT EXISTS (SELECT 1 FROM x o WHERE NOT o.new AND o.tag = x.tag AND o.entity_id = x.entity_id AND o.chunk IS NOT DISTINCT FROM x.chunk)""",
    "orphan_edges": f"{GONE} SELECT tag, count(*) AS orphans FROM ev WHERE NOT found_document GROUP BY tag",
    "scoped_delete": f"{STAR} SELECT 'documents' AS name, count(*) AS left FROM docs WHERE document_id % 4 <> 0 UNION ALL SELECT 'edges', count(*) FROM star WHERE document_id % 4 <> 0",
    "asset_upsert": _registered_sql(False),
    "asset_seed": _registered_sql(True),
    "partial_update": f"{STAR} SELECT document_id, CASE WHEN document_id % 6 = 0 THEN 'renamed.txt' ELSE filename END AS filename, CASE WHEN document_id % 10 = 0 THEN 'extracted' ELSE 'uploaded' END AS status FROM docs",
    "reindex_queue": "SELECT doc_id AS chunk_id, md5(CASE WHEN doc_id % 2 = 0 AND trim(substring(text, 1, 200), ' ') <> '' THEN trim(substring(text, 1, 200), ' ') ELSE text END) AS digest FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE doc_id % 3 <> 0",
    "endpoint_edges": f"{STAR} SELECT DISTINCT 'asset:' || tag AS source, relation_type, target FROM (SELECT tag, 'mentioned_in' AS relation_type, 'document:' || document_id AS target FROM star UNION ALL SELECT tag, 'supported_by_chunk', 'chunk:' || document_id || '-' || chunk_index FROM star UNION ALL SELECT tag, 'has_entity', 'entity:' || entity_id FROM star) WHERE tag = 'P-101' OR target = 'entity:3'",
    "mentioned_documents": f"{GONE} SELECT DISTINCT document_id, filename FROM ev WHERE found_document AND contains(text, 'Repeated failure')",
    "vector_preview": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension, array_to_string(list_transform(embedding[1:3], lambda x: printf('%.4f', CAST(x AS DOUBLE))), '|') AS preview FROM embeddings WHERE embedding IS NOT NULL",
    "dashboard_summary": f"""{RISK} SELECT 'risk' AS section, level AS name, count(*) AS value FROM risk GROUP BY level UNION ALL SELECT 'reason', reason, count(*) FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM risk) WHERE reason <> '' GROUP BY reason
UNION ALL (SELECT 'top', tag, count(*) FROM star GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 5) UNION ALL SELECT 'rows', 'documents', count(*) FROM orders UNION ALL SELECT 'rows', 'chunks', count(*) FROM lineitem UNION ALL SELECT 'rows', 'assets', count(*) FROM part UNION ALL SELECT 'rows', 'entities', count(*) FROM supplier
UNION ALL SELECT 'rows', 'sessions', count(*) FROM conversations UNION ALL SELECT 'rows', 'events', count(*) FROM events""",
    "failure_intelligence": f"""{STAR}, c AS (SELECT tag, count(*) FILTER ({_FAILED}) AS failure_events, count(DISTINCT CASE WHEN {_FAILED} THEN document_id END) AS documents, least(count(*) FILTER ({contains(rules.MAINTENANCE)}), 8) AS actions, {_COUNTS} FROM star GROUP BY tag),
l AS (SELECT *, list_sort(list_filter({_MODE_LIST}, lambda x: x.n < 0)) AS m FROM c)
SELECT tag, failure_events, documents, coalesce(array_to_string(list_transform(m, lambda x: x.mode || ':' || (-x.n)), '|'), '') AS modes, coalesce(array_to_string(list_transform(list_filter(m, lambda x: x.n <= -2), lambda x: x.mode || ':' || (-x.n)), '|'), '') AS repeated, CASE WHEN failure_events >= 4 AND documents >= 2 THEN 'high' WHEN failure_events >= 2 THEN 'medium' ELSE 'low' END AS coverage, actions, failure_events > 0 AS sufficient FROM l""",
    "root_causes": ROOT_CAUSES,
    "evidence_packages": PACKAGES,
    "gap_records": f"""{GAPS}, one AS (SELECT f.tag, f.gap_type, f.span, f.tag || ' ' || f.said AS sentence FROM found f WHERE r = 1), d AS (SELECT tag, gap_type, count(DISTINCT lower(substring(tag || ' ' || said, 1, 60))) AS n FROM found GROUP BY tag, gap_type)
SELECT tag, gap_type, g.severity, CASE WHEN gap_type = 'certificate_expired' AND contains(span, '01-Feb-2025') THEN '2025-02-01' END AS certified, CASE WHEN contains(sentence, 'Factories Act Section 31') THEN 'Factories Act Section 31' WHEN contains(sentence, 'ISO 10816:2009') THEN 'ISO 10816:2009' END AS standard,
CASE gap_type {' '.join(f"WHEN '{k}' THEN replace(replace(replace(replace('{v[0]}', '{{tag}}', tag), '{{n}}', CAST(d.n AS VARCHAR)), '{{date}}', CASE WHEN contains(span, '01-Feb-2025') THEN ' The certificate date on file (2025-02-01) is in the past relative to 2025-03-01.' ELSE '' END), '{{overdue}}', coalesce(' It is overdue by ' || CAST(x.days AS VARCHAR) || ' days.', ''))" for k, v in rules.GAP_TEXTS.items())} END AS reason, CASE gap_type {' '.join(f"WHEN '{k}' THEN replace('{v[1]}', '{{tag}}', tag)" for k, v in rules.GAP_TEXTS.items())} END AS action, sentence AS said
FROM gaps g JOIN one USING (tag, gap_type) JOIN d USING (tag, gap_type) JOIN (SELECT tag, gap_type, days FROM g) x USING (tag, gap_type)""",
    "gap_tabs": f"""{GAPS} SELECT 'certificates' AS tab, count(*) AS gaps FROM gaps WHERE starts_with(gap_type, 'certificate') UNION ALL SELECT 'overdue', count(*) FROM gaps WHERE gap_type IN ('calibration_overdue', 'inspection_overdue', 'sop_review_overdue')
UNION ALL SELECT 'severe', count(*) FROM gaps WHERE severity = 'high' UNION ALL SELECT 'pumps', count(*) FROM gaps WHERE starts_with(tag, 'P-')""",
    "risk_evidence": f"""{GONE}, hay AS (SELECT *, concat_ws(' ', lower(filename), lower(text)) AS haystack FROM ev), flags AS (SELECT tag, {RISK_FLAGS}, count(*) AS mentions, count(DISTINCT CASE WHEN found_document THEN document_id END) AS documents, max(created_at) AS last_seen FROM hay GROUP BY tag),
risk AS (SELECT *, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS level FROM (SELECT tag, CAST({RISK_SCORE} AS BIGINT) AS score, {RISK_REASONS} AS reasons, mentions, documents, last_seen FROM flags)),
top AS (SELECT *, {_PREVIEW} AS preview, row_number() OVER (PARTITION BY tag ORDER BY created_at DESC NULLS LAST, chunk_index ASC NULLS LAST, mention_id) AS place FROM ev WHERE text <> '' QUALIFY place <= 3),
cited AS (SELECT tag, string_agg(document_id || ':' || chunk_index || ':' || coalesce(filename, '-') || ':' || preview, '|' ORDER BY place) AS evidence FROM top GROUP BY tag)
SELECT tag, score, level, reasons, mentions, documents, CAST(last_seen AS VARCHAR) AS last_seen, coalesce(evidence, '') AS evidence FROM risk LEFT JOIN cited USING (tag)""",
    "document_details": f"""{STAR}, m AS (SELECT DISTINCT document_id, tag, entity_id FROM star WHERE document_id % 3 <> 0),
a AS (SELECT document_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS assets FROM m GROUP BY document_id), e AS (SELECT document_id, string_agg(s_name, '|' ORDER BY entity_id) AS entities FROM (SELECT DISTINCT document_id, entity_id, s_name FROM m JOIN supplier ON s_suppkey = entity_id WHERE entity_id % 7 <> 0) GROUP BY document_id)
SELECT document_id, filename, coalesce(assets, '') AS assets, coalesce(entities, '') AS entities FROM docs LEFT JOIN a USING (document_id) LEFT JOIN e USING (document_id)""",
    "asset_browse": f"""{RISK}
SELECT a.tag, a.asset_type, coalesce(level, 'low') AS level, score, last_seen FROM (SELECT DISTINCT tag, asset_type FROM assets WHERE contains(tag, '1') AND asset_type IN ('pump', 'motor')) a LEFT JOIN risk USING (tag)""",
    "asset_autocomplete": f"{STAR} SELECT DISTINCT tag FROM assets WHERE contains(lower(tag), 'p-1') ORDER BY tag LIMIT 5",
    "asset_types": f"{STAR} SELECT asset_type, count(DISTINCT tag) AS assets FROM assets WHERE asset_type IS NOT NULL GROUP BY asset_type",
    "latest_modes": f"{STAR}, hit AS ({_HIT}) SELECT tag, mode, max(created_at) AS latest, array_to_string(list_sort(list(DISTINCT entity_id)), '|') AS entities FROM hit GROUP BY tag, mode",
    "entity_scores": f"""{_TAGS}, f AS (SELECT DISTINCT document_id, tag FROM tags), g AS (SELECT DISTINCT document_id, tag FROM star WHERE chunk_index < 3),
c AS (SELECT count(*) FILTER (f.tag IS NOT NULL AND g.tag IS NOT NULL) AS tp, count(*) FILTER (g.tag IS NULL) AS fp, count(*) FILTER (f.tag IS NULL) AS fn FROM f FULL JOIN g ON f.document_id = g.document_id AND f.tag = g.tag)
SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""",
    "graph_completeness": f"""{EDGES}, g AS (SELECT DISTINCT tag, 'document:' || document_id AS target FROM m), h AS (SELECT DISTINCT tag, target FROM e WHERE relation_type = 'mentioned_in')
SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM g SEMI JOIN h USING (tag, target)) AS found, round((SELECT count(*) FROM g SEMI JOIN h USING (tag, target)) / (SELECT count(*) FROM g), 4) AS completeness""",
}
