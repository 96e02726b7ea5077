"""Queries over texts, questions, conversations and events, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts
from ..functions import text as tx
from ..operators import conversation, evaluation, hybrid, layout, metadata, parents, retrieval, work_orders
from ..sources import files, star
from ..streaming import events as stream
from .sql import STAR

Query = Callable[[SparkSession, str], DataFrame]
CELLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "status", "part_no"]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = star.reports(spark, sf_dir)
    found = facts.free_text_facts(F.col("text"))
    return r.select("document_id", "chunk_index", *(v.alias(k) for k, v in found.items()), facts.page_number(F.col("text")).alias("page"), facts.standard(F.col("text")).alias("standards"), facts.first_date(F.col("text")).cast("string").alias("date"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells of text: a status only where it is open, a part number for every second part."""
    i = star.table(spark, sf_dir, "lineitem")
    return i.select("l_orderkey", F.col("l_linenumber").cast("string").alias("l_linenumber"), F.col("l_quantity").cast("int").cast("string").alias("l_quantity"), "l_returnflag", F.when(F.col("l_linestatus") == "O", "Open!").otherwise("nan").alias("status"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(" 1234-"), F.col("l_partkey").cast("string"))).alias("part_no"), "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def _row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).withColumn("l_orderkey", F.col("l_orderkey").cast("string"))
    return files.row_chunks(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], CELLS).select("document_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("digest"), "char_start", "char_end", "fact_spare_part", "fact_open_action")


def _labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    return c.groupBy(files.labelled_row_text(c, CELLS).alias("text")).agg(F.count("*").alias("rows"))


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star.questions(spark, sf_dir)
    said = star.table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("item_id"), F.col("text").alias("question"))
    return q.unionByName(said).groupBy(facts.intent(F.col("question")).alias("intent")).agg(F.count("*").alias("questions"))


def _boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file kind gains for each kind of question."""
    kinds = spark.createDataFrame([(x + "7.txt",) for x in ("work_order_", "inspection_report_", "sop_", "compliance_checklist_", "rca_")], "file_name string")
    q = star.questions(spark, sf_dir)
    each = q.join(F.broadcast(kinds))  # five rows
    return each.select("item_id", "file_name", facts.file_boost(F.col("question"), F.col("file_name")).alias("file_boost"), facts.source_boost(facts.intent(F.col("question")), F.col("file_name")).alias("source_boost"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = star.table(spark, sf_dir, "pages")
    return p.select("page_id", facts.safe_component(F.col("url")).alias("component"), facts.safe_file_name(F.col("url")).alias("file_name"), facts.stable_id(F.col("url")).alias("stable_id"))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.elements(star.table(spark, sf_dir, "documents")).select("doc_id", F.col("element").alias("element"), "element_type", F.md5(F.col("text").cast("binary")).alias("digest"))


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parents.with_summaries(parents.parents(parents.atomic_summaries(star.layout_elements(spark, sf_dir))))
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return p.select(
        F.col("document_id").alias("doc_id"), "parent", F.col("section_title").alias("section"), "file_name", "source_type", "modality", "page_start", "page_end", "row_start", "row_end", F.size("element_ids").alias("elements"), F.array_join("element_types", "|").alias("types"),
        F.array_join("asset_tags", "|").alias("asset_tags"), F.length("raw_text").alias("chars"), digest("raw_text").alias("digest"), digest("text_evidence").alias("evidence_digest"), F.size("summaries").alias("n_summaries"), digest("summary").alias("summary_digest"), F.md5(F.array_join("questions", "|").cast("binary")).alias("questions_digest"),
    )


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metadata.chunk_fields(star.chunk_metadata(spark, sf_dir))
    return m.select("chunk_id", "parent_chunk_id", "retrieval_unit_id", "file_name", "source_path", "source_type", "section_title", "modality", "page_start", "page_end", "row_start", F.array_join("asset_tags", "|").alias("asset_tags"), F.array_join("questions", "|").alias("questions"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parents.page_texts(star.layout_elements(spark, sf_dir))
    return p.select(F.col("document_id").alias("doc_id"), "page_number", "page_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = conversation.summaries(star.table(spark, sf_dir, "conversations"))
    return s.select("conv_id", "cursor", F.length("summary").alias("chars"), F.md5(F.col("summary").cast("binary")).alias("digest"))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star.table(spark, sf_dir, "conversations")
    m = conversation.memory(c, conversation.summaries(c))
    return m.select("conv_id", F.size("entries").alias("n"), F.expr("entries[0].role").alias("first_role"), F.md5(F.expr("array_join(transform(entries, e -> concat(e.role, ': ', e.text)), '\\n')").cast("binary")).alias("digest"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star.table(spark, sf_dir, "conversations")
    return conversation.sessions(c.select("conv_id").distinct(), c.where("conv_id % 5 <> 0"))


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star.questions(spark, sf_dir)
    tag = F.when(F.col("item_id") % 3 == 0, "P-1").when(F.col("item_id") % 3 == 1, "HX-999")
    return q.select("item_id", facts.scoped(F.col("question"), tag).alias("question"), F.array_join(facts.question_tags(F.col("question")), "|").alias("asked"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["cm", "PM ", "PMD", "PDM", "DPM", "PPDM", "X", "EMERGENCY"]))
    noise = F.when(F.col("document_id") % 4 == 0, F.lower("tag")).when(F.col("document_id") % 4 == 1, F.concat(F.lit(" "), "tag")).when(F.col("document_id") % 4 == 2, F.regexp_replace("tag", "-", "/")).otherwise(F.col("tag"))
    return star.mentions(spark, sf_dir).select(noise.alias("Equipment_ID"), F.element_at(kinds, (F.col("document_id") % 8 + 1).cast("int")).alias("OrderType"), F.concat(F.col("document_id").cast("string"), F.lit("-"), F.col("chunk_index").cast("string")).alias("WorkOrderDescription"), F.lit("x").alias("Unlisted"))


def _retrieved(f: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: f(star.passages(spark, sf_dir), star.questions(spark, sf_dir))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = hybrid.fused(star.passages(spark, sf_dir), star.questions(spark, sf_dir))
    return f.select("item_id", "chunk_id", F.round("vector_score", 4).alias("vector_score"), F.round("keyword_score", 4).alias("keyword_score"), "vector_rank", "keyword_rank", F.round("rrf", 6).alias("rrf"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hybrid.ranked(star.passages(spark, sf_dir), star.questions(spark, sf_dir))
    return r.select("item_id", "place", "chunk_id", "raw", F.round("score", 9).alias("score"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = hybrid.answers(star.passages(spark, sf_dir), star.questions(spark, sf_dir))
    return a.select("item_id", "intent", "sufficient", "confidence", "label", F.md5(F.col("answer").cast("binary")).alias("digest"), F.array_join("citations", "|").alias("citations"), F.array_join("related", "|").alias("related"))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of the first document that has an item's text; no file is there for every seventh item."""
    p, q = star.passages(spark, sf_dir), star.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("start"))
    found = p.join(F.broadcast(q), F.contains("text", F.col("start")))  # a stated set of questions
    named = found.groupBy("item_id").agg(F.min_by("file_name", "chunk_id").alias("file_name"))
    return named.withColumn("file_name", F.when(F.col("item_id") % 7 == 0, "elsewhere.pdf").otherwise(F.col("file_name")))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = star.passages(spark, sf_dir)
    hits = hybrid.keyword_topk(p, star.questions(spark, sf_dir), 5).join(p.select("chunk_id", "file_name"), "chunk_id").select("item_id", "rank", "file_name")
    return evaluation.outcomes(_expected(spark, sf_dir), hits, p)


def _answer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the answers do: the benchmark through retrieval, fusion, selection and answers."""
    p, q = star.passages(spark, sf_dir), star.questions(spark, sf_dir)
    asset = F.when(F.col("item_id") % 5 != 4, F.concat(F.lit("p-"), (F.col("item_id") % 50).cast("string")))
    expected = _expected(spark, sf_dir).withColumn("asset", asset)
    evidence = hybrid.diverse(p, q).join(p.select("chunk_id", "tags", "text"), "chunk_id")
    return evaluation.answer_rates(evaluation.answer_outcomes(expected, hybrid.answers(p, q), p, evidence))


def _sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut to 16 places and padded to 70, each of length 1, by their first and last values and length."""
    v = star.table(spark, sf_dir, "embeddings")
    short, long = retrieval.fitted(F.col("embedding"), 16), retrieval.fitted(F.col("embedding"), 70)
    return v.select("vec_id", F.round(F.get(short, F.lit(0)), 4).alias("first"), F.round(F.get(short, F.lit(15)), 4).alias("last"), F.size(long).alias("dimension"), F.get(long, F.lit(69)).alias("padding"))


QUERIES: dict[str, Query] = {
    "free_text_facts": _facts,
    "row_chunks": _row_chunks,
    "labelled_rows": _labelled_rows,
    "question_intents": _intents,
    "file_boosts": _boosts,
    "safe_names": _names,
    "layout_elements": _layout,
    "parent_chunks": _parents,
    "chunk_metadata": _metadata,
    "page_texts": _pages,
    "chat_summaries": _summaries,
    "chat_context": _context,
    "chat_titles": _sessions,
    "question_scope": _scopes,
    "work_orders_clean": lambda s, d: work_orders.cleaned(_orders(s, d)),
    "work_order_sample": lambda s, d: work_orders.sampled(work_orders.cleaned(_orders(s, d))),
    "keyword_topk": _retrieved(lambda c, q: hybrid.keyword_topk(c, q, 50)),
    "hashing_topk": _retrieved(lambda c, q: hybrid.vector_topk(c, q, 50)),
    "rrf_fusion": _fused,
    "hybrid_rank": _ranked,
    "mmr_select": _retrieved(lambda c, q: hybrid.diverse(c, q).select("item_id", "place", "chunk_id", F.round("score", 4).alias("score"))),
    "rag_answers": _answers,
    "retrieval_rates": lambda s, d: evaluation.rates(_outcomes(s, d)),
    "retrieval_categories": lambda s, d: evaluation.categories(_outcomes(s, d)),
    "answer_rates": _answer_rates,
    "value_p95": lambda s, d: evaluation.nearest_rank(star.table(s, d, "events"), "event_type", "value"),
    "fitted_vectors": _sort_key,
    "event_windows": lambda s, d: stream.windowed(star.table(s, d, "events")).select("start", "event_type", "events", F.round("total", 4).alias("total")),
    "event_sessions": lambda s, d: stream.sessions(star.table(s, d, "events")),
    "events_once": lambda s, d: stream.once(star.table(s, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"]).select("user_id", "event_type", F.col("day").cast("string").alias("day")),
}

# --- SQL ---------------------------------------------------------------------------------------------------------------

_REPORT = "list_extract([" + ", ".join(f"'{x}'" for x in star.REPORTS) + f"], CAST((document_id + 3 * chunk_index) % {len(star.REPORTS)} + 1 AS INTEGER))"


def _by_report(values: list[str | None], null: str = "NULL") -> str:
    """What each report states, written out by hand."""
    return "CASE (document_id + 3 * chunk_index) % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + f" ELSE {null} END"


def _plain(text: str) -> str:
    """Letters and digits beyond ASCII as _, so that RE2's \\b and \\w take them for what they are; spaces as such."""
    return f"regexp_replace(regexp_replace(translate({text}, 'ſK', 'sk'), '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]|[^\\x00-\\x7F\\P{{M}}]', '_', 'g'), '[^\\x00-\\x7F\\P{{Z}}]', ' ', 'g')"


INTENT = "CASE " + " ".join(f"WHEN regexp_matches({_plain('question')}, '(?i){p}') THEN '{n}'" for n, p in facts.INTENTS) + " ELSE 'general' END"
QUESTIONS = f"q AS (SELECT item_id, text || list_extract([{', '.join(repr(x) for x in star.ASKED)}], CAST(item_id % {len(star.ASKED)} + 1 AS INTEGER)) || ' for P-' || (item_id % 50) AS question FROM benchmark)"
PASSAGES = """c AS (SELECT doc_id AS chunk_id, list_extract(['work_order_', 'inspection_report_', 'sop_', 'compliance_checklist_', 'rca_'], CAST(doc_id % 5 + 1 AS INTEGER)) || (doc_id % 40) || '.txt' AS file_name, lower(coalesce(text, '')) AS body,
lower(coalesce(substring(text, 1, 200), '')) AS summary, lower(coalesce(substring(text, 201, 150), '')) AS asked, 'P-' || (doc_id % 50) AS tag, doc_id % 9 AS row_start, text FROM documents)"""
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
TERMS = f"""{QUESTIONS}, t0 AS (SELECT *, list_filter(list_transform(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9_.-]*'), lambda t: trim(t, '._-')), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})) AS a, regexp_extract_all(upper(question), '\\b[A-Z]{{1,8}}-[A-Z0-9-]*\\d[A-Z0-9-]*\\b') AS b FROM q),
terms AS (SELECT item_id, question, list_filter(a, lambda x, i: list_position(a, x) = i) AS tokens, list_filter(b, lambda x, i: list_position(b, x) = i) AS assets FROM t0)"""


def _sum(items: str, weights: dict[str, float], lowered: bool = False) -> str:
    x = "lower(x)" if lowered else "x"
    return f"coalesce(list_sum(list_transform({items}, lambda x: " + " + ".join(f"{w} * CAST(contains({c}, {x}) AS INTEGER)" for c, w in weights.items()) + ")), 0)"


KEYWORD = f"""{PASSAGES}, {TERMS}, ks AS (SELECT item_id, chunk_id, file_name, row_start, CAST({_sum('tokens', {'summary': 2, 'body': 1, 'asked': 3})} + {_sum('assets', {'summary': 4, 'body': 2, 'asked': 4}, True)} + 8 * CAST(list_contains(assets, tag) AS INTEGER) AS DOUBLE) AS score FROM c, terms),
k AS (SELECT item_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, file_name DESC, row_start, chunk_id) AS rank FROM ks WHERE score > 0) WHERE rank <= 50)"""


def counts(name: str, source: str, key: str, text: str) -> str:
    return f"""{name} AS (SELECT id, bucket, sum(s) AS v FROM (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS bucket, CASE WHEN CAST('0x' || substr(md5(w), 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS s
  FROM (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+')) AS w FROM {source})) GROUP BY id, bucket HAVING sum(s) <> 0)"""


VECTOR = f"""{counts('cv', 'c', 'chunk_id', 'text')}, {counts('qv', 'q', 'item_id', 'question')}, cn AS (SELECT id, sum(v * v) AS n FROM cv GROUP BY id), qn AS (SELECT id, sum(v * v) AS n FROM qv GROUP BY id),
vs AS (SELECT item_id, chunk_id, round(dot / sqrt(CAST(cn.n AS DOUBLE) * CAST(qn.n AS DOUBLE)), 6) AS score FROM (SELECT qv.id AS item_id, cv.id AS chunk_id, sum(qv.v * cv.v) AS dot FROM cv JOIN qv USING (bucket) GROUP BY qv.id, cv.id) d JOIN cn ON cn.id = chunk_id JOIN qn ON qn.id = item_id),
v AS (SELECT item_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM vs) WHERE rank <= 50)"""
FUSED = f"""WITH {KEYWORD}, {VECTOR}, nv AS (SELECT item_id, chunk_id, rank, greatest(0.0, score / coalesce(nullif(max(score) OVER (PARTITION BY item_id), 0), 1.0)) AS s FROM v), nk AS (SELECT item_id, chunk_id, rank, greatest(0.0, score / coalesce(nullif(max(score) OVER (PARTITION BY item_id), 0), 1.0)) AS s FROM k),
f AS (SELECT coalesce(nv.item_id, nk.item_id) AS item_id, coalesce(nv.chunk_id, nk.chunk_id) AS chunk_id, coalesce(nv.s, 0.0) AS vector_score, coalesce(nk.s, 0.0) AS keyword_score, CAST(nv.rank AS INTEGER) AS vector_rank, CAST(nk.rank AS INTEGER) AS keyword_rank, coalesce(0.7 / (60 + nv.rank), 0.0) + coalesce(0.3 / (60 + nk.rank), 0.0) AS rrf
  FROM nv FULL JOIN nk ON nv.item_id = nk.item_id AND nv.chunk_id = nk.chunk_id)"""


def _boost(question: str, name: str) -> str:
    return "CASE WHEN " + " OR ".join(f"(regexp_matches({_plain(question)}, '(?i){p}') AND (" + " OR ".join(f"contains({name}, '{h}')" for h in hints) + "))" for p, hints in facts.FILE_HINTS) + " THEN 0.12 ELSE 0.0 END"


SOURCE = "CASE WHEN " + " OR ".join(f"({INTENT} = '{n}' AND (" + " OR ".join(f"contains(file_name, '{h}')" for h in hints) + "))" for n, hints in facts.PREFERRED_FILES.items()) + " THEN 0.08 ELSE 0.0 END"
_OVERLAP = "len(list_filter(tokens, lambda x: contains(asked, x)))"
RANKED = f"""{FUSED}, r AS (SELECT f.*, row_start, round(0.7 * vector_score + 0.3 * keyword_score + rrf + least(0.55, CASE WHEN list_contains(assets, tag) THEN 0.25 ELSE 0.0 END + CASE WHEN {_OVERLAP} >= 2 THEN least(0.25, {_OVERLAP} * 0.05) ELSE 0.0 END
  + CASE WHEN len(list_filter(tokens, lambda x: contains(lower(tag), x))) > 0 THEN 0.05 ELSE 0.0 END) + {_boost('question', 'file_name')}, 9) AS raw FROM f JOIN c USING (chunk_id) JOIN terms USING (item_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, vector_score DESC, keyword_score DESC, row_start, chunk_id) AS place, greatest(0.0, least(1.0, raw / coalesce(nullif(max(raw) OVER (PARTITION BY item_id), 0), 1.0))) AS score FROM r)"""
OUTCOMES = f"""WITH {KEYWORD}, ex AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'elsewhere.pdf' ELSE arg_min(file_name, chunk_id) END AS file_name FROM benchmark b JOIN c ON contains(coalesce(c.text, ''), b.text) GROUP BY item_id),
hf AS (SELECT item_id, file_name, min(rank) AS rank FROM k JOIN c USING (chunk_id) WHERE rank <= 5 GROUP BY item_id, file_name), hr AS (SELECT item_id, file_name, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS hit_at FROM hf),
o AS (SELECT ex.item_id, coalesce(hit_at, 0) AS place, ex.file_name IN (SELECT file_name FROM c) AS answerable FROM ex LEFT JOIN hr ON hr.item_id = ex.item_id AND hr.file_name = ex.file_name)"""

_B = " || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BLANKS = f"(' '{_B})"
HISTORY = f"h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, turn, role, trim(text, {_BLANKS}) AS said FROM conversations WHERE role IN ('user', 'assistant')) WHERE said <> '')"
SUMMARIES = f"{HISTORY}, s AS (SELECT conv_id, greatest(max(n) - 6, 0) AS cursor, right(string_agg(role || ': ' || said, chr(10) ORDER BY place) FILTER (place <= n - 6), 1400) AS summary FROM h GROUP BY conv_id)"
_HEAD_WORDS = " OR ".join(f"contains(lower(t), '{w}')" for w in layout.HEADING_WORDS)
LAYOUT = f"""lines AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, trim(unnest(ls), {_BLANKS}) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS ls FROM documents WHERE text IS NOT NULL)),
kinds AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '#') OR (t <> '' AND length(t) <= 90 AND (ends_with(t, ':') OR (upper(t) = t AND lower(t) <> t) OR (({_HEAD_WORDS}) AND len(regexp_split_to_array(t, '\\s+')) <= 10))) THEN 'heading' WHEN regexp_matches(line, '^\\s*(?:[-*]|\\d+[.)])\\s+') THEN 'list_item' ELSE 'paragraph' END AS kind
  FROM (SELECT *, trim(trim(line, '#'), {_BLANKS}) AS t FROM lines)),
runs AS (SELECT *, sum(CAST(kind = 'heading' OR kind <> before AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT doc_id, line_no, kind, CASE WHEN kind <> 'heading' THEN line WHEN starts_with(line, '#') THEN trim(ltrim(line, '#'), {_BLANKS}) ELSE rtrim(line, ':') END AS line, lag(kind, 1, 'none') OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM kinds)),
el AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS element, any_value(kind) AS element_type, string_agg(line, chr(10) ORDER BY line_no) AS text FROM runs WHERE kind <> 'blank' GROUP BY doc_id, run)"""
_TEXT_LINE = "CASE WHEN element_type = 'heading' THEN text WHEN visual THEN element_type || ' original evidence for ' || element_id || ': ' || text WHEN row_index IS NOT NULL THEN 'Row ' || row_index || ': ' || text ELSE text END"
_EVIDENCE_LINE = "CASE WHEN visual THEN '' WHEN element_type <> 'heading' AND row_index IS NOT NULL THEN 'Row ' || row_index || ': ' || text ELSE text END"
# Elements as parts, their parents by a walk over the parts of all documents at once.
PARENTS = f"""WITH RECURSIVE {LAYOUT}, sections AS (SELECT *, last_value(CASE WHEN element_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY element) AS section_title, list_extract(['txt', 'md', 'csv', 'pdf'], CAST(doc_id % 4 + 1 AS INTEGER)) AS source_type FROM el),
e0 AS (SELECT doc_id, element, doc_id || ':element:' || element AS element_id, CASE WHEN source_type = 'pdf' AND element % 5 = 3 THEN 'table_block' WHEN source_type = 'pdf' AND element % 5 = 4 THEN 'image_caption' ELSE element_type END AS element_type, text, source_type, 'f' || doc_id || '.' || source_type AS file_name,
  CASE WHEN source_type = 'pdf' THEN element // 6 + 1 END AS page_number, CASE WHEN source_type = 'csv' AND element % 4 <> 3 THEN element + 1 END AS row_index, section_title, CASE WHEN element % 3 = 0 THEN ['P-' || (element % 7)] ELSE [] END AS tags, CASE WHEN source_type = 'pdf' AND element % 5 = 3 THEN 'table' WHEN source_type = 'pdf' AND element % 5 = 4 THEN 'image' ELSE 'text' END AS modality FROM sections),
e1 AS (SELECT *, modality <> 'text' AS visual, CASE WHEN modality = 'text' THEN NULL WHEN element % 10 = 3 THEN 'short table' ELSE element_type || ' element from ' || file_name || '. Asset tags: ' || CASE WHEN len(tags) > 0 THEN tags[1] ELSE 'none' END || '. Content representation: ' || substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 1200) END AS summary FROM e0),
cut AS (SELECT * REPLACE (CASE WHEN length(text) > 11000 THEN element_id || ':part:' || part ELSE element_id END AS element_id, CASE WHEN length(text) > 11000 THEN trim(substring(text, part * 11000 + 1, 11000), {_BLANKS}) ELSE text END AS text) FROM (SELECT *, unnest(range(CASE WHEN length(text) > 11000 THEN CAST(ceil(length(text) / 11000.0) AS BIGINT) ELSE 1 END)) AS part FROM e1)),
parts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY element, part) AS i, CASE source_type WHEN 'csv' THEN '' WHEN 'pdf' THEN CAST(page_number AS VARCHAR) ELSE coalesce('s' || section_title, '') END AS k FROM cut WHERE text <> ''),
w AS (SELECT doc_id, i, k, source_type = 'csv' AS csv, CASE WHEN source_type = 'csv' THEN CAST(row_index IS NOT NULL AS INTEGER) ELSE length(text) + 2 END AS weight, CASE WHEN source_type = 'csv' THEN 1 ELSE length(text) END AS after FROM parts),
walk AS (SELECT doc_id, i, k, weight AS held, 0 AS parent FROM w WHERE i = 1 UNION ALL
  SELECT w.doc_id, w.i, w.k, CASE WHEN w.k <> walk.k OR walk.held + w.after > CASE WHEN w.csv THEN 1 ELSE 9000 END THEN w.weight ELSE walk.held + w.weight END, CASE WHEN w.k <> walk.k OR walk.held + w.after > CASE WHEN w.csv THEN 1 ELSE 9000 END THEN walk.parent + 1 ELSE walk.parent END FROM walk JOIN w ON w.doc_id = walk.doc_id AND w.i = walk.i + 1),
said AS (SELECT parts.*, parent, trim({_TEXT_LINE}, {_BLANKS}) AS line, trim({_EVIDENCE_LINE}, {_BLANKS}) AS evidence FROM parts JOIN walk USING (doc_id, i)),
modal AS (SELECT doc_id, parent, arg_min(modality, (-n, first_at)) AS modality FROM (SELECT doc_id, parent, modality, count(*) AS n, min(i) AS first_at FROM said GROUP BY ALL) GROUP BY ALL),
p AS (SELECT doc_id, parent, arg_min(section_title, i) FILTER (section_title <> '') AS section, any_value(file_name) AS file_name, any_value(source_type) AS source_type, min(page_number) AS page_start, max(page_number) AS page_end, min(row_index) AS row_start, max(row_index) AS row_end, count(*) AS elements,
  list_sort(list(DISTINCT element_type)) AS types, list_sort(list_distinct(flatten(list(tags)))) AS tags, string_agg(line, chr(10) ORDER BY i) FILTER (line <> '') AS raw_text, coalesce(string_agg(evidence, chr(10) ORDER BY i) FILTER (evidence <> ''), '') AS text_evidence,
  count(summary) AS n_summaries, string_agg('- ' || element_type || ' ' || element_id || ': ' || summary, chr(10) ORDER BY i) AS atomic FROM said GROUP BY doc_id, parent),
q AS (SELECT *, list_sort(list_distinct(list_concat(tags, list_transform(regexp_extract_all(raw_text, '\\b[A-Za-z]{{1,4}}-\\d{{1,4}}[A-Za-z]?\\b'), lambda t: upper(t))))) AS every_tag, CASE WHEN text_evidence <> '' THEN text_evidence ELSE raw_text END AS given, coalesce(array_to_string(nullif(tags, []), ', '), 'the referenced asset') AS about,
  concat_ws(', ', 'section ' || section, 'pages ' || page_start || '-' || page_end, 'rows ' || row_start || '-' || row_end) AS places FROM p)
SELECT doc_id, CAST(parent AS INTEGER) AS parent, section, file_name, source_type, modality, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, CAST(row_start AS INTEGER) AS row_start, CAST(row_end AS INTEGER) AS row_end, CAST(elements AS INTEGER) AS elements, array_to_string(types, '|') AS types, coalesce(array_to_string(tags, '|'), '') AS asset_tags,
  CAST(length(raw_text) AS INTEGER) AS chars, md5(raw_text) AS digest, md5(text_evidence) AS evidence_digest, CAST(n_summaries AS INTEGER) AS n_summaries,
  md5(file_name || ' ' || CASE WHEN places <> '' THEN places ELSE 'source location unknown' END || '. Asset tags: ' || coalesce(array_to_string(nullif(every_tag, []), ', '), 'none') || '. Parent evidence summary input: ' || substring(CASE WHEN n_summaries = 0 THEN given ELSE 'Text evidence:' || chr(10) || given || chr(10) || chr(10) || 'Atomic visual summaries:' || chr(10) || atomic END, 1, 1600)) AS summary_digest,
  md5('What information does ' || coalesce(section, file_name) || ' provide about ' || about || '?|Which checks, actions, or limits are stated for ' || about || ' in this chunk?|What source evidence is available for ' || about || ' in ' || file_name || '?|What status, date, or maintenance detail is mentioned for ' || about || '?|What operational or compliance issue can be answered from this chunk?') AS questions_digest
FROM q JOIN modal USING (doc_id, parent)"""

_CELL = "CASE WHEN {0} IS NOT NULL AND lower(trim(CAST({0} AS VARCHAR))) NOT IN ('', 'nan', 'none') THEN '{0}: ' || trim(CAST({0} AS VARCHAR)) END"
_LABEL = "CASE WHEN {0} IS NOT NULL AND trim(CAST({0} AS VARCHAR)) <> '' THEN '''{0}'': ' || trim(CAST({0} AS VARCHAR)) || CASE WHEN regexp_matches(trim(CAST({0} AS VARCHAR)), '[.!?;:]$') THEN '' ELSE '.' END END"
CELL_ROWS = "cells AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'Open!' ELSE 'nan' END AS status, CASE WHEN l_partkey % 2 = 0 THEN ' 1234-' || l_partkey END AS part_no, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem)"
ORDERS = f"""{STAR}, o AS (SELECT CASE document_id % 4 WHEN 0 THEN lower(tag) WHEN 1 THEN ' ' || tag WHEN 2 THEN replace(tag, '-', '/') ELSE tag END AS id, list_extract(['cm', 'PM ', 'PMD', 'PDM', 'DPM', 'PPDM', 'X', 'EMERGENCY'], CAST(document_id % 8 + 1 AS INTEGER)) AS kind, document_id || '-' || chunk_index AS d FROM star),
clean AS (SELECT upper(trim(id)) AS "Equipment_ID", CASE upper(trim(kind)) WHEN 'CM' THEN 'CM' WHEN 'PM' THEN 'PM' WHEN 'PMD' THEN 'PM' ELSE 'PDM' END AS "OrderType", d AS "WorkOrderDescription" FROM o WHERE contains(id, '-') AND kind NOT IN ('X', 'EMERGENCY'))
"""

ORACLE_SQL: dict[str, str] = {
    "free_text_facts": f"""{STAR} SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, {_by_report(['7.8 mm/s', None, None, '2 bar', None, None, None, None])} AS inspection_reading, {_by_report([None, 'SOP-PUMP-STARTUP'])} AS sop_reference, {_by_report([None, None, 'OISD-137', None, None, None, 'PESO'])} AS compliance_reference,
{_by_report([None, 'MS-45-CR'])} AS spare_part, {_by_report([None, None, 'leakage', 'low suction pressure', None, 'bearing failure'])} AS failure_mode, {_by_report([None, None, 'immediate action required'])} AS risk_phrase, {_by_report(['follow-up required', None, 'action required', 'do not restart', None, 'raise work order'])} AS open_action, {_by_report([None, 'Replace the mechanical seal MS', None, None, 'Inspect impeller for wear'])} AS maintenance_action,
CAST({_by_report([None, None, None, None, '3'])} AS INTEGER) AS page, {_by_report(['ISO 10816', None, 'OISD-137', None, None, None, 'Factories Act Section 31 / PESO'])} AS standards, CASE WHEN (document_id + 3 * chunk_index) % 8 <> 6 OR NOT regexp_matches(tag, '^[A-Z]{{3,}}-[0-9]{{4}}$') THEN {_by_report([None, None, None, None, None, '2025-02-01', '2024-03-01'])} END AS date FROM star""",
    "row_chunks": f"""WITH {CELL_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_linenumber AS VARCHAR), l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS i, concat_ws(chr(10), {', '.join(_CELL.format(c) for c in CELLS)}) AS text FROM cells),
o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at FROM n)
SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(i AS INTEGER) AS chunk_index, md5(text) AS digest, CAST(begin_at AS BIGINT) AS char_start, CAST(begin_at + length(text) AS BIGINT) AS char_end, trim(part_no) AS fact_spare_part, CASE WHEN status <> 'nan' THEN status END AS fact_open_action FROM o""",
    "labelled_rows": f"WITH {CELL_ROWS} SELECT concat_ws(' ', {', '.join(_LABEL.format(c) for c in CELLS)}) AS text, count(*) AS rows FROM cells GROUP BY 1",
    "question_intents": f"WITH {QUESTIONS}, every AS (SELECT question FROM q UNION ALL SELECT text FROM conversations WHERE role = 'user') SELECT {INTENT} AS intent, count(*) AS questions FROM every GROUP BY 1",
    "file_boosts": f"WITH {QUESTIONS} SELECT item_id, file_name, {_boost('question', 'file_name')} AS file_boost, {SOURCE} AS source_boost FROM q, (SELECT unnest(['work_order_7.txt', 'inspection_report_7.txt', 'sop_7.txt', 'compliance_checklist_7.txt', 'rca_7.txt']) AS file_name)",
    "safe_names": "SELECT page_id, substring(trim(regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g'), '.-'), 1, 64) AS component, substring(ltrim(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '.'), 1, 200) AS file_name, 'rag-' || substring(sha1(lower(url)), 1, 20) AS stable_id FROM pages",
    "layout_elements": f"WITH {LAYOUT} SELECT doc_id, CAST(element AS INTEGER) AS element, element_type, md5(text) AS digest FROM el",
    "parent_chunks": PARENTS,
    "page_texts": f"WITH {LAYOUT} SELECT doc_id, CAST(element // 6 + 1 AS INTEGER) AS page_number, sha1(doc_id || ':' || (element // 6 + 1)) AS page_id, md5(string_agg(text, chr(10) ORDER BY element)) AS digest FROM el WHERE doc_id % 4 = 3 GROUP BY doc_id, element // 6",
    "chunk_metadata": """WITH m AS (SELECT doc_id, doc_id % 4 < 3 AS good, doc_id % 4 AS layout FROM documents)
SELECT doc_id AS chunk_id, CASE WHEN good THEN 'p' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS parent_chunk_id, doc_id || ':summary:0' AS retrieval_unit_id, CASE WHEN good THEN 'f' || doc_id || '.txt' ELSE 'd' || doc_id END AS file_name, '/d/' || doc_id AS source_path, CASE WHEN good THEN 'txt' END AS source_type, CASE WHEN good THEN 'S' || doc_id END AS section_title,
CASE WHEN layout = 1 THEN 'table' END AS modality, CASE WHEN good THEN CAST(doc_id AS INTEGER) END AS page_start, CASE WHEN good THEN CAST(doc_id AS INTEGER) END AS page_end, CAST(NULL AS INTEGER) AS row_start, CASE WHEN good THEN 'C-' || doc_id || '|HX-1|P-' || doc_id ELSE '' END AS asset_tags, CASE WHEN good THEN 'what is ' || doc_id || '?' ELSE '' END AS questions FROM m""",
    "chat_summaries": f"WITH {SUMMARIES} SELECT conv_id, CAST(cursor AS BIGINT) AS cursor, CAST(length(summary) AS INTEGER) AS chars, md5(summary) AS digest FROM s",
    "chat_context": f"""WITH {SUMMARIES}, l AS (SELECT conv_id, 0 AS place, 'assistant' AS role, 'Conversation summary: ' || summary AS said FROM s WHERE summary <> '' UNION ALL SELECT conv_id, place, role, said FROM h WHERE place > n - 6)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n, arg_min(role, place) AS first_role, md5(string_agg(role || ': ' || said, chr(10) ORDER BY place)) AS digest FROM l GROUP BY conv_id""",
    "chat_titles": r"""WITH f AS (SELECT conv_id, count(*) AS messages, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS t FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id)
SELECT c.conv_id, coalesce(CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substring(t, 1, 77)) || '...' END, 'New chat') AS title, coalesce(messages, 0) AS messages FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id)""",
    "question_scope": f"""WITH {TERMS}, s AS (SELECT item_id, question, assets, CASE item_id % 3 WHEN 0 THEN 'P-1' WHEN 1 THEN 'HX-999' END AS tag FROM terms)
SELECT item_id, CASE WHEN tag IS NULL OR contains(lower(question), lower(tag)) THEN question ELSE question || ' Asset tag: ' || tag || '.' END AS question, coalesce(array_to_string(assets, '|'), '') AS asked FROM s""",
    "work_orders_clean": f"{ORDERS} SELECT * FROM clean",
    "work_order_sample": f"""{ORDERS}, n AS (SELECT "Equipment_ID" AS id, split_part("Equipment_ID", '-', 1) AS prefix, count(*) AS n FROM clean GROUP BY 1, 2), top AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, id) AS r FROM n WHERE prefix IN ('TK', 'M', 'HX', 'R', 'BLR', 'C')) WHERE r = 1 UNION SELECT unnest(['P-101', 'P-102', 'P-201']))
SELECT "Equipment_ID", "OrderType", "WorkOrderDescription" FROM (SELECT *, row_number() OVER (PARTITION BY "Equipment_ID" ORDER BY md5("Equipment_ID" || '|' || "OrderType" || '|' || "WorkOrderDescription")) AS r FROM clean WHERE "Equipment_ID" IN (SELECT id FROM top)) WHERE r <= 60""",
    "keyword_topk": f"WITH {KEYWORD} SELECT item_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM k",
    "hashing_topk": f"WITH {PASSAGES}, {QUESTIONS}, {VECTOR} SELECT item_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM v",
    "rrf_fusion": f"{FUSED} SELECT item_id, chunk_id, round(vector_score, 4) AS vector_score, round(keyword_score, 4) AS keyword_score, vector_rank, keyword_rank, round(rrf, 6) AS rrf FROM f",
    "hybrid_rank": f"{RANKED} SELECT item_id, CAST(place AS INTEGER) AS place, chunk_id, raw, round(score, 9) AS score FROM ranked",
    "retrieval_rates": f"{OUTCOMES} SELECT count(*) AS questions, round(coalesce(avg(CAST(place = 1 AS INTEGER)), 0), 4) AS top1_rate, round(coalesce(avg(CAST(place BETWEEN 1 AND 3 AS INTEGER)), 0), 4) AS top3_rate, round(coalesce(avg(CAST(place = 1 AS INTEGER)) FILTER (answerable), 0), 4) AS answerable_top1, round(coalesce(avg(CAST(place BETWEEN 1 AND 3 AS INTEGER)) FILTER (answerable), 0), 4) AS answerable_top3 FROM o",
    "retrieval_categories": f"{OUTCOMES} SELECT CASE WHEN place BETWEEN 1 AND 3 THEN 'pass' WHEN NOT answerable THEN 'expected_source_absent_from_corpus' WHEN place > 3 THEN 'correct_document_outside_top3' ELSE 'correct_document_not_retrieved' END AS category, count(*) AS questions FROM o GROUP BY 1",
    "value_p95": "SELECT event_type, n, round(mean, 4) AS mean, round(value, 4) AS percentile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS mean FROM events WHERE value IS NOT NULL) WHERE r = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1",
    "fitted_vectors": "WITH v AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v) SELECT vec_id, round(coalesce(e[1] / nullif(l, 0), 0), 4) AS first, round(coalesce(e[16] / nullif(l, 0), 0), 4) AS last, 70 AS dimension, 0.0 AS padding FROM n",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS end, count(*) AS events FROM s GROUP BY user_id, k""",
    "events_once": "SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
}
