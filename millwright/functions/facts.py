"""Facts that free text and table rows state: tags, readings, references, dates, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import asset_type

# What an equipment tag looks like in text and in a question.
TAG = r"\b([A-Za-z]{1,4})-(\d{1,4})([A-Za-z]?)\b"
QUESTION_TAG = r"\b[A-Z]{1,8}-[A-Z0-9-]*\d[A-Z0-9-]*\b"
KNOWN_TYPE, UNKNOWN_TYPE = 0.95, 0.6
# Patterns of single facts, and labels in order of priority.
READING = r"(?i)\b(\d+(?:\.\d+)?)\s*(mm/s|m/s|bar|kPa|MPa|m3/h|m³/h|RPM|°C|deg\s*C|kW|MW|Hz|psi|L/min|m|kg|A)\b"
SOP = r"(?i)\bSOP-[A-Z0-9][A-Z0-9\-]{2,29}\b"
STANDARDS = [r"(?i)\bOISD-\d+\b", r"(?i)\bISO\s+\d{4}(?::\d{4})?\b", r"\bPESO\b", r"(?i)\bFactory\s+Act\b", r"\bIBR\b", r"\bCEIG\b", r"(?i)\bAPI\s+\d+\b", r"\bASME\b", r"\bBIS\b"]
SPARE = r"\b(?:[A-Z]{1,6}-\d{2,6}-[A-Z0-9]{1,8}|\d{4}-[A-Z0-9]{2,8}|BRG-[A-Z0-9\-]{2,12})\b"
FAILURES = [
    (r"\bbearing\s+(failure|wear|damage|degradation)\b", "bearing failure"),
    (r"\bseal\s+(failure|damage|wear)\b", "seal failure"),
    (r"\blow\s+suction\s+pressure\b", "low suction pressure"),
    (r"\b(high|excessive)\s+vibration\b", "high vibration"),
    (r"\b(low|reduced)\s+(flow|pressure)\b", "low flow/pressure"),
    (r"\boverheating\b|\bover\s*heat(?:ing)?\b", "overheating"),
    (r"\bleakage?\b|\bseal\s+leak\b", "leakage"),
    (r"\bcavitation\b", "cavitation"),
    (r"\bfouling\b", "fouling"),
    (r"\bcorrosion\b", "corrosion"),
    (r"\berosion\b", "erosion"),
    (r"\bmisalign\w*\b", "misalignment"),
    (r"\bclog\w*\b|\bblockage\b", "blockage"),
    (r"\babnormal\s+noise\b|\bnoisy\b", "abnormal noise"),
    (r"\bflutter\b", "flutter"),
]
RISKS = [
    (r"\bimmediate\s+action\s+required\b", "immediate action required"),
    (r"\bnon.?compliant\b", "non-compliant"),
    (r"\bhigh\s+risk\b", "high risk"),
    (r"\bhigh\s+priority\b", "high priority"),
    (r"\bcritical\b", "critical"),
    (r"\boverdue\b", "overdue"),
    (r"\bexpired\b", "expired"),
    (r"\burgent\b", "urgent"),
    (r"\bmedium\s+risk\b", "medium risk"),
    (r"\blow\s+risk\b", "low risk"),
]
OPEN_ACTIONS = [
    (r"\balignment\s+recheck\b", "alignment recheck required"),
    (r"\brecheck\s+required\b", "recheck required"),
    (r"\bfollow.?up\s+required\b", "follow-up required"),
    (r"\baction\s+required\b", "action required"),
    (r"\bopen\s+action\b", "open action"),
    (r"\bpending\s+(?:inspection|verification|action|maintenance)\b", "pending"),
    (r"\bmonitor\s+closely\b", "monitor closely"),
    (r"\bimmediately?\s+(?:inspect|replace|shut|repair|check)\b", "immediate action"),
    (r"\brake\s+(?:a\s+)?(?:maintenance\s+)?work\s+order\b", "raise work order"),
    (r"\bdo\s+not\s+(attempt\s+to\s+)?restart\b", "do not restart"),
]
ACTION = r"(?i)\b(replac\w+|repair\w*|inspect\w*|calibrat\w*|clean\w*|align\w*|overhaul\w*|lubricat\w*|tighten\w*|adjust\w*|flush\w*|install\w*|remov\w*|check\w*|verif\w*|test\w*|measur\w*|trim\w*)\s+(?:the\s+|and\s+)?(\w+(?:\s+\w+){0,4})"
PAGE = r"\[Page (\d+)\]"
# Intents of a question in order of priority; file names that each intent prefers.
INTENTS = [
    ("procedure", r"\bhow\s+to\b|\bstep(s|s\s+to)?\b|\bprocedure\b|\bstart(up|ing)?\b|\bshutdown\b|\bcommission\w*\b|\bcheck(list)?\b|\bloto\b|\bsafety\s+steps\b|\bsop\b"),
    ("failure_rca", r"\bwhy\s+(is|was|did|does)\b|\broot\s+cause\b|\bcause(d|s)?\b|\bfault\b|\bfail(ed|ure|ing)?\b|\bvibrat(ing|ion)\b|\boverheating\b|\bleaking\b|\brca\b|\bwhat\s+(caused|went\s+wrong)\b"),
    ("maintenance_history", r"\bhistory\b|\bpast\b|\bprevious\b|\blast\s+(maintenance|service|inspection|repair|year|month)\b|\bwork\s+order(s)?\b|\bwhat\s+maintenance\b|\bmaintenance\s+(done|performed|carried|was)\b|\brepair(ed|s)?\b|\breplace(d|ment)?\b"),
    ("inspection", r"\binspection\b|\bfinding(s)?\b|\breading(s)?\b|\bmeasurement(s)?\b|\bq[1-4]\b|\bquarterly\b|\bannual\s+inspection\b|\bvibration\s+level\b|\btemperature\s+reading\b"),
    ("compliance", r"\bcompliance\b|\bregulation\b|\bstandard\b|\boisd\b|\bpeso\b|\biso\b|\bfactory\s+act\b|\bcertificate\b|\baudits?\b|\bgap\b|\bexpired?\b|\boverdue\b|\bnon.?compliant\b"),
]
PREFERRED_FILES = {
    "failure_rca": ["inspection", "work_order", "work-order", "near_miss"],
    "maintenance_history": ["work_order", "work-order", "maintenance"],
    "inspection": ["inspection", "report"],
    "procedure": ["sop", "manual", "oem", "startup", "procedure"],
    "compliance": ["compliance", "checklist", "certificate"],
}
FILE_HINTS = [
    (r"\b(step|steps|procedure|start|starting|startup|shut\s*down|shutdown|isolation|loto|lockout|commission\w*|checklist before)\b", ["sop", "manual", "procedure", "startup", "oem"]),
    (r"\b(compliance|recertif\w*|certificat\w*|standard|regulat\w*|audit|deadline|govern\w*|oisd|peso|non.?compliant|expired?)\b", ["compliance", "checklist", "certificate"]),
    (r"\b(reading|readings|vibration|inspection|finding|findings|measurement|measurements|pending|current|acceptable limit)\b", ["inspection", "report"]),
    (r"\b(work\s*order|maintenance|repair\w*|replaced|replacement|history|past|previous|seal failure)\b", ["work_order", "work-order", "maintenance", "rca"]),
]
# Standards cited in evidence, dates, months.
CITED_STANDARD = r"(?i)(OISD-\d+|PESO|Factories?\s+Act(?:\s+Section\s+\d+|\s+Schedule\s+[IVX]+)?|Factory\s+Act(?:\s+Schedule\s+[IVX]+)?|ISO\s*\d{3,5}(?::\d{4})?|IEC\s*\d+|API\s*\d+|NFPA\s*\d+|OSHA\s*[\d.]+)"
DAY_DATE = r"\b(\d{1,2})[ \-]([A-Za-z]{3,9})[ \-](\d{4})\b"
MONTH_DATE = r"\b([A-Za-z]{3,9})[ \-](\d{4})\b"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# By fact, names of columns that state it, best first.
FACT_COLUMNS = {
    "equipment_tag": ["equipment_id", "asset_tag", "equipment", "asset_id", "tag"],
    "asset_type": ["asset_type", "equipment_type", "type", "category"],
    "failure_mode": ["failure_mode", "fault_type", "failure", "problem", "issue", "work_order_description", "fault_description"],
    "maintenance_action": ["maintenance_action", "corrective_action", "operation_description", "action", "repair", "work_done", "ordertype"],
    "inspection_reading": ["inspection_reading", "reading", "measurement", "sensor_value", "measured_value", "value"],
    "date": ["order_date", "inspection_date", "event_date", "created_at", "timestamp", "date"],
    "sop_reference": ["sop_reference", "sop_id", "procedure", "sop"],
    "compliance_reference": ["compliance_reference", "compliance_ref", "standard", "regulation", "oisd", "compliance"],
    "spare_part": ["spare_part", "part_number", "part_no", "spare", "component", "bom"],
    "risk_phrase": ["risk_phrase", "risk_level", "severity", "priority", "criticality", "risk"],
    "open_action": ["open_action", "pending_action", "next_action", "recommendation", "status"],
}


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _label(text: Column, labelled: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(text.rlike(f"(?i){p}"), label) for p, label in labelled))


def free_text_facts(text: Column) -> dict[str, Column]:
    """The eight kinds of facts of a text; null where it states none."""
    return {
        "inspection_reading": F.trim(_first(text, READING)),
        "sop_reference": F.upper(_first(text, SOP)),
        "compliance_reference": F.coalesce(*(_first(text, p) for p in STANDARDS)),
        "spare_part": _first(text, SPARE),
        "failure_mode": _label(text, FAILURES),
        "risk_phrase": _label(text, RISKS),
        "open_action": _label(text, OPEN_ACTIONS),
        "maintenance_action": F.regexp_replace(_first(text, ACTION), r"\s+", " "),
    }


def page_number(text: Column) -> Column:
    return _first(text, PAGE, 1).cast("int")


def row_facts(rows: DataFrame) -> dict[str, Column]:
    """Facts by column names: of each fact's names the first that the row has a value for. Case, blanks and underscores
    in names don't count; 'nan' and 'none' are no values."""
    plain = lambda name: name.lower().replace(" ", "").replace("_", "")
    by_name = {plain(c): c for c in rows.columns}

    def value(name: str) -> Column:
        v = F.trim(F.col(f"`{name}`").cast("string"))
        return F.when((v != "") & ~F.lower(v).isin("nan", "none"), v)

    found = {fact: [value(by_name[plain(n)]) for n in names if plain(n) in by_name] for fact, names in FACT_COLUMNS.items()}
    return {fact: F.coalesce(*values) for fact, values in found.items() if values}


def intent(question: Column) -> Column:
    return F.coalesce(*(F.when(question.rlike(f"(?iU){p}"), name) for name, p in INTENTS), F.lit("general"))


def _has_any(name: Column, parts: list[str]) -> Column:
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return out


def file_boost(question: Column, file_name: Column, boost: float = 0.12) -> Column:
    """What a file gains whose name has a hint of a kind that the question asks for."""
    fits = F.lit(False)
    for pattern, hints in FILE_HINTS:
        fits = fits | (question.rlike(f"(?iU){pattern}") & _has_any(file_name, hints))
    return F.when(fits, boost).otherwise(0.0)


def source_boost(intent_name: Column, file_name: Column, boost: float = 0.08) -> Column:
    fits = F.lit(False)
    for name, parts in PREFERRED_FILES.items():
        fits = fits | ((intent_name == name) & _has_any(file_name, parts))
    return F.when(fits, boost).otherwise(0.0)


def question_tags(question: Column) -> Column:
    """Distinct tags of a question, in order."""
    return F.array_distinct(F.regexp_extract_all(F.upper(question), F.lit(QUESTION_TAG), F.lit(0)))


def tags(text: Column) -> Column:
    """Distinct tags of a text in order: struct of tag, raw (as first written), position (from 0), asset_type, confidence."""
    raw = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))
    upper = F.transform(raw, F.upper)
    each = F.transform(F.array_distinct(upper), lambda t: F.struct(t.alias("tag"), F.element_at(raw, F.array_position(upper, t).cast("int")).alias("raw")))
    kind = lambda t: asset_type(t["tag"])
    place = lambda t: F.regexp_instr(text, F.concat(F.lit(r"\b\Q"), t["raw"], F.lit(r"\E\b"))) - 1
    return F.transform(each, lambda t: F.struct(t["tag"].alias("tag"), t["raw"].alias("raw"), place(t).alias("position"), kind(t).alias("asset_type"), F.when(kind(t).isNull(), UNKNOWN_TYPE).otherwise(KNOWN_TYPE).alias("confidence")))


def standard(text: Column) -> Column:
    """Distinct standards of a text, joined; null without one."""
    found = F.transform(F.regexp_extract_all(text, F.lit(CITED_STANDARD), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " "))
    return F.nullif(F.array_join(F.array_distinct(found), " / "), F.lit(""))


def first_date(text: Column) -> Column:
    """The first day-month-year, or else the first month and year (its first day); null if there is none that exists."""
    number = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)))
    month = lambda pattern, group: F.try_element_at(number, F.lower(F.substring(F.regexp_extract(text, pattern, group), 1, 3)))
    date = lambda year, month, day: F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    by_day = month(DAY_DATE, 2)
    whole = date(F.regexp_extract(text, DAY_DATE, 3), by_day, F.regexp_extract(text, DAY_DATE, 1))
    return F.when(by_day.isNotNull(), whole).otherwise(date(F.regexp_extract(text, MONTH_DATE, 2), month(MONTH_DATE, 1), F.lit("01")))


def safe_component(name: Column, most: int = 64) -> Column:
    """A name as a part of a path: letters, digits, '.', '_' and '-' only, without '.' and '-' at its ends."""
    return F.substring(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9._-]", "-"), F.lit(".-")), 1, most)


def safe_file_name(name: Column, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), r"^\.+", ""), 1, most)


def stable_id(path: Column) -> Column:
    return F.concat(F.lit("rag-"), F.substring(F.sha1(F.lower(path).cast("binary")), 1, 20))


def scoped(question: Column, tag: Column) -> Column:
    """The question with its asset named at its end, unless it names it or there is none."""
    return F.when(tag.isNull() | (tag == "") | F.lower(question).contains(F.lower(tag)), question).otherwise(F.concat(question, F.lit(" Asset tag: "), tag, F.lit(".")))


def title(message: Column, most: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(message, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def cut(text: Column, most: int, ellipsis: str = "") -> Column:
    """Stripped; cut to most characters, the ellipsis included, without white space before it."""
    stripped = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    return F.when(F.length(stripped) <= most, stripped).otherwise(F.concat(F.rtrim(F.substring(stripped, 1, most - len(ellipsis))), F.lit(ellipsis)))
