"""Keyword rules of the analytics, as data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

# Points and keywords of the risk score.
RISK = [
    ("repeated_failure", 2, ["repeated failure", "repeated issue", "recurring", "repeatedly"]),
    ("compliance_gap", 2, ["overdue", "expired", "compliance gap", "missing certificate", "not recorded"]),
    ("condition", 1, ["high vibration", "leakage", "overheating", "cavitation", "corrosion", "bearing wear", "misalignment", "fouling"]),
    ("abnormal", 1, ["abnormal", "alarm", "exceeds", "threshold", "high priority"]),
    ("open_action", 1, ["open action", "recheck", "follow-up", "follow up", "pending", "not closed"]),
]
# Timeline categories, first match wins; severities.
TIMELINE = [
    ("inspection", ["inspection", "vibration reading", "reading", "calibration", "test"]),
    ("work_order", ["work order", "maintenance", "repair", "replaced", "action taken"]),
    ("procedure", ["sop", "procedure", "startup", "shutdown", "checklist"]),
    ("compliance", ["compliance", "audit", "certificate", "oisd", "factory act", "peso", "iso"]),
    ("failure", ["failure", "vibration", "leakage", "overheating", "cavitation", "alarm", "abnormal"]),
]
SEVERITY = [
    ("high", ["high priority", "alarm", "exceeds", "overdue", "expired", "abnormal", "shutdown"]),
    ("medium", ["vibration", "leakage", "follow-up", "follow up", "recheck", "pending", "inspection"]),
]
# Failure modes and signs of maintenance.
FAILURE_MODES = [
    ("vibration", ["high vibration", "excessive vibration", "vibration"]),
    ("leakage", ["seal leak", "oil leak", "leakage", "leak"]),
    ("overheating", ["overheating", "overheat", "high temperature"]),
    ("cavitation", ["cavitation"]),
    ("corrosion", ["corrosion", "corroded"]),
    ("bearing_wear", ["bearing failure", "bearing wear", "worn bearing"]),
    ("misalignment", ["misalignment", "misaligned"]),
    ("fouling", ["fouling", "fouled"]),
    ("seal_failure", ["seal failure", "seal damage"]),
    ("alarm_trip", ["emergency shutdown", "unplanned shutdown", "alarm", "trip", "abnormal"]),
]
MAINTENANCE = ["work order", "maintenance", "repair", "replaced", "replacement", "action taken", "rework", "overhaul"]


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    out = F.lit(default)
    for name, keywords in reversed(rules):
        out = F.when(contains_any(text, keywords), name).otherwise(out)
    return out


def modes(text: Column) -> Column:
    """Failure modes named in the text, in the rules' order."""
    return F.filter(F.array(*(F.when(contains_any(text, keywords), F.lit(name)) for name, keywords in FAILURE_MODES)), lambda x: x.isNotNull())


def level(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def coverage(events: Column, documents: Column) -> Column:
    return F.when((events >= 4) & (documents >= 2), "high").when(events >= 2, "medium").otherwise("low")


class Gap(NamedTuple):
    """A compliance gap: patterns that one span must all have, and what closes it anywhere in the asset's texts."""

    name: str
    severity: str
    span: list[str]
    closed: str | None = None
    at_least: int = 1


# Compliance gaps, over lower-cased text; from how many days on an overdue calibration is severe.
GAPS = [
    Gap("certificate_expired", "high", ["certificate", "expired|lapse"]),
    Gap("calibration_overdue", "medium", ["calibrat", "overdue|past due|due by"]),
    Gap("inspection_overdue", "high", ["vibrat", r"exceed|non-compliant|non compliant|above.*limit|limit.*above|within 48 hour|trip setpoint"], r"alignment\s+(check\s+)?(completed|done|verified and within)|re-?baselined?[^.]*within\s+limit|vibration[^.]*within\s+limit\s+after|ncr[^.]*closed|finding\s+closed"),
    Gap("sop_review_overdue", "medium", ["sop|procedure|lockout|loto", "review", "due"]),
    Gap("repeated_failure_no_rca", "medium", ["failure|failed|breakdown|leakage|alarm|exceeding trip|recurring|repeated"], r"root\s+cause|\brca\b|failure\s+analysis|5[\s-]?why|why[\s-]?why", 2),
    Gap("safety_procedure_missing", "high", [r"open\s+pump\s+casing|disassembl|mechanical\s+work|hot\s+work|confined\s+space|pressuris|depressuris|entry\s+permit|seal\s+replacement|casing\s+removal"], r"loto|lock\s?out|lock-?out|tag\s?out|isolation\s+procedure|permit\s+to\s+work"),
]
# What a gap's record says: reason and recommended action; {n}: different sentences.
GAP_TEXTS = {
    "certificate_expired": ("Evidence records an expired test/inspection certificate for {tag}.{date} Operating without a valid certificate is a regulatory non-conformance.", "Contact the approved inspection authority to renew the certificate and withhold {tag} from certified service until a valid certificate is on file."),
    "calibration_overdue": ("Instrument calibration for {tag} is overdue per the evidence on file.{overdue}", "Schedule and complete the overdue calibration for {tag}, then record the result to restore compliant status."),
    "inspection_overdue": ("{tag} shows a vibration exceedance flagged for follow-up, but the evidence contains no record of a completed follow-up inspection/alignment closing it out.", "Complete the required follow-up inspection (e.g. laser alignment / re-baseline) for {tag} and record closure of the exceedance."),
    "sop_review_overdue": ("The procedure/SOP associated with {tag} is past its scheduled review date per the evidence on file.", "Complete the periodic review and re-approval of the {tag} procedure and update its revision/approval record."),
    "repeated_failure_no_rca": ("{tag} has repeated failure/corrective evidence ({n} distinct events) but the evidence contains no recorded root-cause analysis.", "Raise and document a formal root-cause analysis for the recurring failures on {tag} and link corrective actions to it."),
    "safety_procedure_missing": ("{tag} has safety-critical maintenance evidence, but no LOTO / lockout-tagout or equivalent safety-isolation procedure is referenced in the evidence.", "Attach the applicable LOTO / permit-to-work procedure to the {tag} maintenance records before the work is authorised."),
}
# What a reason says of a certificate's date and of the days that a calibration is overdue.
DATE_NOTE, OVERDUE_NOTE = (" The certificate date on file (", ") is in the past relative to ", "."), (" It is overdue by ", " days.")
OVERDUE_DAYS = r"overdue\s+by\s+(\d{1,4})\s+days?"
LONG_OVERDUE = 30


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)
