"""The star of assets and documents in SQL, and what several queries share."""

from __future__ import annotations

from ..functions import rules
from ..functions import text as tx
from ..sources import star


def contains(keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains(haystack, '{k}')" for k in keywords) + ")"


def case(named: list[tuple[str, list[str]]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {contains(k)} THEN '{n}'" for n, k in named) + f" ELSE '{default}' END"


PREFIX = "CASE " + " ".join(f"WHEN starts_with(p_type, '{w}') THEN '{p}'" for w, p in star.PREFIXES.items()) + " ELSE 'C' END"
FILE = "CASE " + " ".join(f"WHEN starts_with(o_orderpriority, '{w}') THEN '{p}'" for w, p in star.FILES.items()) + " ELSE 'rca_' END"
TYPE = "CASE split_part(tag, '-', 1) " + " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in tx.ASSET_TYPES.items()) + " END"
STAR = f"""WITH assets AS (SELECT p_partkey, tag, {TYPE} AS asset_type FROM (SELECT p_partkey, {PREFIX} || '-' || CAST(p_partkey % 10000 AS VARCHAR) AS tag FROM part)),
docs AS (SELECT o_orderkey AS document_id, {FILE} || CAST(o_orderkey AS VARCHAR) || '.txt' AS filename, o_orderdate AS created_at FROM orders),
items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS chunk_index FROM lineitem),
bare AS (SELECT tag, asset_type, document_id, filename, created_at, chunk_index, l_suppkey AS entity_id, 'Equipment_ID: ' || tag || chr(10) || CASE
  WHEN l_returnflag = 'R' AND p_partkey % 7 = 0 THEN 'Repeated failure: high vibration and bearing wear.'
  WHEN l_returnflag = 'A' AND p_partkey % 5 = 0 THEN 'Certificate expired; follow-up pending.'
  WHEN l_linestatus = 'O' AND p_partkey % 3 = 0 THEN 'Inspection reading abnormal, alarm exceeds threshold.'
  WHEN l_returnflag = 'N' AND p_partkey % 4 = 1 THEN 'Work order: replaced seal, oil leak repaired.'
  ELSE 'Routine startup procedure checked.' END AS text
  FROM items JOIN assets ON l_partkey = p_partkey JOIN docs ON l_orderkey = document_id),
star AS (SELECT *, lower(filename) || ' ' || lower(text) AS haystack FROM bare)
"""
RISK_FLAGS = ", ".join(f"max(CASE WHEN {contains(k)} THEN 1 ELSE 0 END) AS {n}" for n, _, k in rules.RISK)
RISK_SCORE = " + ".join(f"{n} * {p}" for n, p, _ in rules.RISK)
RISK_REASONS = "concat_ws('|', " + ", ".join(f"CASE WHEN {n} = 1 THEN '{n}' END" for n, _, _ in rules.RISK) + ")"
RISK = f"""{STAR}, flags AS (SELECT tag, {RISK_FLAGS}, count(*) AS mentions, count(DISTINCT document_id) AS documents, max(created_at) AS last_seen FROM star GROUP BY tag),
risk AS (SELECT *, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS level FROM (SELECT tag, CAST({RISK_SCORE} AS BIGINT) AS score, {RISK_REASONS} AS reasons, mentions, documents, last_seen FROM flags))
"""
MODES = f"{STAR}, hit AS (" + " UNION ALL ".join(f"SELECT tag, document_id, chunk_index, created_at, '{n}' AS mode FROM star WHERE {contains(k)}" for n, k in rules.FAILURE_MODES) + ")"

_SAID = "list_extract([" + ", ".join(f"'{x}'" for x in star.FINDINGS) + f"], CAST((document_id + 7 * chunk_index + entity_id) % {len(star.FINDINGS)} + 1 AS INTEGER))"
_CUT = " ".join(f"WHEN strpos(said, '{o}') > 0 AND split_part(tag, '-', 2) <> '{o[2:]}' THEN tag || ' ' || substring(said, 1, strpos(said, '{o}') - 1)" for o in ("Q-9901", "C-9902"))
SEGMENTS = f"""{STAR}, said AS (SELECT DISTINCT tag, document_id, chunk_index, created_at, {_SAID} AS said FROM star),
segments AS (SELECT *, CASE {_CUT} ELSE tag || ' ' || said END AS span, lower(said) AS corpus FROM said)
"""
_HITS = " UNION ALL ".join(f"SELECT *, '{g.name}' AS gap_type, '{g.severity}' AS usual FROM segments WHERE " + " AND ".join(f"regexp_matches(lower(span), '{p}')" for p in g.span) for g in rules.GAPS)
_OPEN = " AND ".join(f"NOT (gap_type = '{g.name}' AND tag IN (SELECT tag FROM segments WHERE regexp_matches(corpus, '{g.closed}')))" for g in rules.GAPS if g.closed)
GAPS = f"""{SEGMENTS}, found AS (SELECT *, row_number() OVER (PARTITION BY tag, gap_type ORDER BY created_at DESC, document_id DESC, chunk_index) AS r,
  TRY_CAST(regexp_extract(lower(span), '{rules.OVERDUE_DAYS}', 1) AS INTEGER) AS days FROM ({_HITS})),
g AS (SELECT tag, gap_type, any_value(usual) AS usual, count(*) AS n_evidence, count(DISTINCT said) AS different, string_agg(document_id || '-' || chunk_index, '|' ORDER BY r) FILTER (r <= 3) AS evidence, arg_min(days, r) FILTER (days IS NOT NULL) AS days FROM found GROUP BY tag, gap_type),
gaps AS (SELECT tag, gap_type, CASE WHEN gap_type = 'calibration_overdue' AND days >= {rules.LONG_OVERDUE} THEN 'high' ELSE usual END AS severity, n_evidence, evidence FROM g WHERE {_OPEN} AND NOT (gap_type = 'repeated_failure_no_rca' AND different < 2))
"""
