"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, chat, decontaminate, filter_audit, importance, language, licenses, line_dedup, lm_score, packing, quality, simhash, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": lm_score.op1,
    "op2_licenses": licenses.op2,
    "op3_decontamination": decontaminate.op3,
    "op4_chat": chat.op4,
    "op5_language": language.op5,
    "op6_quality_rules": quality.op6,
    "op7_token_store": token_store.op7,
    "op8_simhash": simhash.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_packing": packing.op10,
    "op11_importance": importance.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_best_fit": best_fit.op13,
}

ORACLE_SQL: dict[str, str] = {"op11_importance": importance.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
