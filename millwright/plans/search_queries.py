"""Queries of asset search, evidence, extractive answers and causes from retrieval, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import causes, citations, metadata, search
from ..sources import star
from .text_queries import INTENT, PASSAGES, QUESTIONS, SOURCE, counts

Query = Callable[[SparkSession, str], DataFrame]


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(star.records(spark, sf_dir), star.scoped_questions(spark, sf_dir)).select("question_id", "place", "document_id", "chunk_id", "score")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = search.evidence(star.records(spark, sf_dir), star.scoped_questions(spark, sf_dir))
    return e.select("question_id", "place", "chunk_id", "score", "intent", F.md5(F.col("text").cast("binary")).alias("digest"))


def _extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = search.answers(star.records(spark, sf_dir), star.scoped_questions(spark, sf_dir))
    cited = F.expr("array_join(transform(citations, c -> concat(c.chunk_id, ':', format_number(c.score, 6))), '|')")
    return a.select("question_id", "intent", "confidence", "retrieved", cited.alias("citations"), F.md5(F.col("answer").cast("binary")).alias("digest"))


def _retrieved_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = causes.retrieved_causes(star.symptoms(spark, sf_dir), star.records(spark, sf_dir))
    return c.select("tag", "symptom", "number", "cause", "confidence", F.col("support").cast("long").alias("support"), F.array_join("evidence", "|").alias("evidence"), F.size("actions").alias("n_actions"), F.size("missing").alias("n_missing"), "summary", "n_retrieved", "n_evidence")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that search finds, with the fields of their metadata and their text."""
    r, fields = star.records(spark, sf_dir), metadata.chunk_fields(star.chunk_metadata(spark, sf_dir)).drop("document_id", "chunk_index")
    hits = search.search(r, star.scoped_questions(spark, sf_dir)).withColumnRenamed("question_id", "item_id")
    return hits.join(fields, "chunk_id").join(r.select("chunk_id", "text"), "chunk_id")


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = citations.contexts(_found(spark, sf_dir))
    return c.select("item_id", F.length("context").alias("chars"), F.md5(F.col("context").cast("binary")).alias("digest"))


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and their sources, of which those of every seventh chunk are gone."""
    found = _found(spark, sf_dir)
    c = citations.with_sources(citations.citations(found), found.where("chunk_id % 7 <> 0"))
    return c.select("item_id", "place", "chunk_id", "file_name", "page", "location", "snippet", "document_id", "chunk_index", "score")


QUERIES: dict[str, Query] = {"asset_search": _searched, "search_evidence": _evidence, "extractive_answers": _extractive, "retrieved_causes": _retrieved_causes, "answer_contexts": _contexts, "answer_citations": _citations}

# --- SQL ---------------------------------------------------------------------------------------------------------------


def _quoted(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


# Records and their questions; every pair of one model has a score, also without a common word.
RECORDS = f"""{PASSAGES}, rec AS (SELECT chunk_id, chunk_id % 40 AS document_id, chunk_id AS chunk_index, file_name, 'P-' || (chunk_id % 50) || ': ' || list_extract({_quoted(star.SAID)}, CAST(chunk_id % {len(star.SAID)} + 1 AS INTEGER)) || ' ' || coalesce(text, '') AS text, CASE WHEN chunk_id % 11 = 0 THEN 'other' ELSE 'hash' END AS model FROM c)"""
SCOPED = f"{QUESTIONS}, ask AS (SELECT item_id, question, CASE WHEN item_id % 5 <> 4 THEN 'P-' || (item_id % 50) END AS tag FROM q)"
SYMPTOMS = f"""sy AS (SELECT DISTINCT CASE WHEN item_id % 9 = 8 THEN 'Q-' || item_id ELSE 'P-' || (item_id % 50) END AS tag, list_extract({_quoted(star.SYMPTOMS)}, CAST(item_id % {len(star.SYMPTOMS)} + 1 AS INTEGER)) AS symptom FROM benchmark),
ask AS (SELECT tag || chr(10) || symptom AS item_id, 'Evidence for root cause of ''' || symptom || ''' on asset ' || tag AS question, tag FROM sy)"""


def _found_sql(k: int) -> str:
    """found: the k chunks of each question in ask; evidence: the same with what their files gain."""
    return f"""{counts('rv', 'rec', 'chunk_id', 'text')}, {counts('av', 'ask', 'item_id', 'question')}, rn AS (SELECT id, sum(v * v) AS n FROM rv GROUP BY id), an AS (SELECT id, sum(v * v) AS n FROM av GROUP BY id),
dots AS (SELECT av.id AS item_id, rv.id AS chunk_id, sum(av.v * rv.v) AS dot FROM rv JOIN av USING (bucket) GROUP BY av.id, rv.id),
pairs AS (SELECT ask.item_id, rec.chunk_id, document_id, chunk_index, file_name, rec.text, question, tag, round(coalesce(dot, 0) / sqrt(CAST(rn.n AS DOUBLE) * CAST(an.n AS DOUBLE)), 6) AS plain, CASE WHEN contains(lower(rec.text), lower(tag)) THEN regexp_matches(lower(rec.text), '(^|[^\\p{{L}}\\p{{N}}_])' || lower(tag) || '($|[^\\p{{L}}\\p{{N}}_])') ELSE false END AS named
  FROM rec JOIN ask ON rec.model = 'hash' JOIN rn ON rn.id = rec.chunk_id JOIN an ON an.id = ask.item_id LEFT JOIN dots ON dots.item_id = ask.item_id AND dots.chunk_id = rec.chunk_id),
boosted AS (SELECT *, CASE WHEN named THEN least(1.0, round(plain + 0.15, 6)) ELSE plain END AS score FROM pairs),
pooled AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id, chunk_index, chunk_id) AS pool_place FROM boosted QUALIFY pool_place <= {3 * k + 10}),
few AS (SELECT *, row_number() OVER (PARTITION BY item_id, document_id ORDER BY pool_place) AS of_document FROM pooled QUALIFY of_document <= 3),
found AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pool_place) AS place FROM few QUALIFY place <= {k}),
intents AS (SELECT *, {INTENT} AS intent FROM found),
gained AS (SELECT * REPLACE (round(least(1.0, score + {SOURCE.replace(INTENT, 'intent')}), 6) AS score) FROM intents),
evidence AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id, chunk_index, place) AS place FROM gained)"""


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _rule(number: int, c: causes.Cause) -> str:
    holds = f"list_filter(e, lambda x: {_any('x.low', c.indicators)})"
    return f"""SELECT tag, symptom, {number} AS number, '{c.cause}' AS cause, len({holds}) AS support, list_transform({holds}, lambda x: x.chunk) AS holds, list_transform(e, lambda x: x.chunk) AS every, {len(c.actions)} AS n_actions, {len(c.missing)} AS n_missing
FROM g WHERE n_evidence > 0 AND {_any('symptom', c.triggers)} AND (len({holds}) > 0 OR {_any('symptom', c.indicators)})"""


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
CAUSES = f"""WITH {RECORDS}, {SYMPTOMS}, {_found_sql(10)},
g AS (SELECT sy.tag, sy.symptom, count(item_id) AS n_retrieved, count(item_id) FILTER (named) AS n_evidence, list({{'chunk': chunk_id, 'low': lower(text)}} ORDER BY place) FILTER (named) AS e FROM sy LEFT JOIN evidence ON item_id = sy.tag || chr(10) || sy.symptom GROUP BY sy.tag, sy.symptom),
hits AS ({' UNION ALL '.join(_rule(i, c) for i, c in enumerate(causes.CAUSES, 1))}),
every AS (SELECT tag, symptom, number, cause, support, CASE WHEN support > 0 THEN holds[1:3] ELSE every[1:1] END AS evidence, n_actions, n_missing FROM hits
  UNION ALL SELECT tag, symptom, 0, 'Condition consistent with the most recent records retrieved for ' || tag || '; specific root cause could not be isolated from the available evidence.', 0, list_transform(e, lambda x: x.chunk)[1:2], 1, 1 FROM g WHERE n_evidence > 0 AND NOT EXISTS (SELECT 1 FROM hits WHERE hits.tag = g.tag AND hits.symptom = g.symptom)),
sure AS (SELECT *, CASE WHEN support = 0 THEN 0.25 ELSE round(least(0.3 + 0.12 * support, 0.75), 2) END AS confidence FROM every)
SELECT tag, symptom, CAST(number AS INTEGER) AS number, cause, confidence, CAST(support AS BIGINT) AS support, array_to_string(evidence, '|') AS evidence, CAST(n_actions AS INTEGER) AS n_actions, CAST(n_missing AS INTEGER) AS n_missing,
  'Analysis of ' || n_evidence || ' evidence item(s) retrieved for ' || tag || ' indicates ' || count(*) OVER (PARTITION BY tag, symptom) || ' likely cause(s) for ''' || symptom || ''' (top confidence ' || format('{{:.2f}}', max(confidence) OVER (PARTITION BY tag, symptom)) || ').' AS summary, n_retrieved, n_evidence FROM sure JOIN g USING (tag, symptom)
UNION ALL SELECT tag, symptom, NULL, NULL, NULL, 0, '', 2, 1, CASE WHEN n_retrieved > 0 THEN 'Insufficient evidence specific to ' || tag || ' was retrieved to determine a root cause for ''' || symptom || '''. Retrieved documents did not reference this asset.' ELSE 'No documents were retrieved for ' || tag || ', so a root cause for ''' || symptom || ''' cannot be determined.' END, n_retrieved, 0 FROM g WHERE n_evidence = 0"""

ORACLE_SQL: dict[str, str] = {
    "asset_search": f"WITH {RECORDS}, {SCOPED}, {_found_sql(5)} SELECT item_id AS question_id, CAST(place AS INTEGER) AS place, document_id, chunk_id, score FROM found",
    "search_evidence": f"WITH {RECORDS}, {SCOPED}, {_found_sql(10)} SELECT item_id AS question_id, CAST(place AS INTEGER) AS place, chunk_id, score, intent, md5(text) AS digest FROM evidence",
    "extractive_answers": f"""WITH {RECORDS}, {SCOPED}, {_found_sql(5)}, a AS (SELECT item_id, count(*) AS n, string_agg(chunk_id || ':' || format('{{:.6f}}', score), '|' ORDER BY place) AS citations, arg_min(score, place) AS top, arg_min(CASE WHEN length({_FLAT}) <= 280 THEN {_FLAT} ELSE rtrim(substring({_FLAT}, 1, 280)) || '...' END, place) AS said FROM evidence GROUP BY item_id),
b AS (SELECT *, {INTENT} AS intent FROM ask JOIN a USING (item_id))
SELECT item_id AS question_id, intent, CASE WHEN top >= 0.6 THEN 'high' WHEN top >= 0.3 THEN 'medium' ELSE 'low' END AS confidence, CAST(n AS INTEGER) AS retrieved, citations,
md5('Based on ' || n || ' retrieved chunk(s)' || CASE WHEN intent <> 'general' THEN ' [' || intent || ']' ELSE '' END || ', the most relevant evidence for "' || question || '" is: "' || said || '" (Extractive answer — no LLM; see citations for full provenance.)') AS digest FROM b""",
    "retrieved_causes": CAUSES,
    "answer_contexts": f"""WITH {RECORDS}, {SCOPED}, {_found_sql(5)}, x AS (SELECT item_id, place, '[' || place || '] file=' || CASE WHEN chunk_id % 4 = 3 THEN 'd' || chunk_id ELSE 'f' || chunk_id || '.txt' END || ' ' || CASE WHEN chunk_id % 4 = 3 OR chunk_id = 0 THEN '' ELSE 'page ' || chunk_id END || ' section=' || CASE WHEN chunk_id % 4 = 3 THEN 'n/a' ELSE 'S' || chunk_id END || ' parent_chunk_id=' || CASE WHEN chunk_id % 4 = 3 THEN '' ELSE 'p' END || chunk_id
  || chr(10) || 'Retrieval summary label (not evidence): ' || chr(10) || 'Raw parent chunk evidence:' || chr(10) || text AS block FROM found), y AS (SELECT item_id, string_agg(block, chr(10) || chr(10) ORDER BY place) AS context FROM x GROUP BY item_id)
SELECT item_id, CAST(length(context) AS INTEGER) AS chars, md5(context) AS digest FROM y""",
    "answer_citations": f"""WITH {RECORDS}, {SCOPED}, {_found_sql(5)}
SELECT item_id, CAST(place AS INTEGER) AS place, chunk_id, CASE WHEN chunk_id % 4 = 3 THEN 'd' || chunk_id ELSE 'f' || chunk_id || '.txt' END AS file_name, CASE WHEN chunk_id % 4 <> 3 AND chunk_id <> 0 THEN CAST(chunk_id AS INTEGER) END AS page, CASE WHEN chunk_id % 4 <> 3 AND chunk_id <> 0 THEN 'page ' || chunk_id ELSE '' END AS location,
  CASE WHEN length({_FLAT}) <= 220 THEN {_FLAT} ELSE rtrim(substring({_FLAT}, 1, 220)) || '...' END AS snippet, CASE WHEN chunk_id % 7 <> 0 THEN CAST(document_id AS VARCHAR) WHEN chunk_id % 4 = 3 THEN CAST(chunk_id AS VARCHAR) ELSE 'p' || chunk_id END AS document_id, CASE WHEN chunk_id % 7 <> 0 THEN chunk_index ELSE 0 END AS chunk_index, CASE WHEN chunk_id % 7 <> 0 THEN score ELSE 0.0 END AS score FROM found""",
}
