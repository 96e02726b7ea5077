"""Compliance gaps of all assets at once. evidence: tag, document_id, chunk_index, created_at, text of each mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import facts, rules

# What may stand beside a tag, and what a tag looks like here.
ALONE = (r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])")
CLOSED = [r for r in rules.GAPS if r.closed]
ANY_TAG = ALONE[0] + r"[A-Z]{1,5}-\d{1,4}[A-Za-z]?" + ALONE[1]


def _place(text: str, tag: str) -> str:
    """SQL for where tag stands as a whole word in text, from 1; 0 if nowhere."""
    return f"regexp_instr({text}, concat('(?i)', r'{ALONE[0]}', r'\\Q', {tag}, r'\\E', r'{ALONE[1]}'))"


def segments(evidence: DataFrame) -> DataFrame:
    """tag, document_id, chunk_index, created_at, span, sentence, line of each sentence that names its mention's tag.

    The span runs from the tag to the next tag with another number. Of one chunk's spans with the same first 60
    characters the first counts. Texts that are null or name no tag give no rows.
    """
    return _segments(evidence.dropDuplicates(["tag", "document_id", "chunk_index"]), ["tag", "document_id", "chunk_index", "created_at"])


def _segments(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys (of a text, tag among them), line_no, sentence_no, span, sentence, line."""
    lines = texts.select(*keys, F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line"))
    each = lines.select(*keys, "line_no", "line", F.posexplode(F.split("line", r"(?<=[.!?])\s+")).alias("sentence_no", "sentence")).withColumn("sentence", F.trim("sentence"))
    found = each.withColumn("hit", F.expr(_place("sentence", "tag"))).where("hit > 0").withColumn("rest", F.expr("substring(sentence, hit + length(tag))"))
    other = f"filter(regexp_extract_all(rest, r'{ANY_TAG}', 0), o -> regexp_extract(o, r'\\d+', 0) <> regexp_extract(tag, r'\\d+', 0))"
    found = found.withColumn("other", F.expr(f"get({other}, 0)"))
    kept = f"if(other is null, rest, substring(rest, 1, {_place('rest', 'other')} - 1))"
    found = found.withColumn("span", F.expr(f"concat(substring(sentence, hit, length(tag)), {kept})"))
    first = found.groupBy(*keys, F.lower(F.substring("span", 1, 60)).alias("start")).agg(F.min(F.struct("line_no", "sentence_no", "span", "sentence", "line")).alias("s"))
    return first.select(*keys, "s.line_no", "s.sentence_no", "s.span", "s.sentence", "s.line")


def _all_of(text: Column, groups: list[str]) -> Column:
    out = F.lit(True)
    for pattern in groups:
        out = out & text.rlike(pattern)
    return out


def newest() -> list[Column]:
    return [F.desc_nulls_last("created_at"), F.desc("document_id"), F.asc("chunk_index"), F.asc("line_no"), F.asc("sentence_no")]


def _found(segments_: DataFrame) -> DataFrame:
    """segments with the gap_type that each has the patterns of, and the days that it says something is overdue."""
    low = F.lower("span")
    hits = F.filter(F.array(*(F.when(_all_of(low, r.span), F.lit(r.name)) for r in rules.GAPS)), lambda x: x.isNotNull())
    days = F.regexp_extract(low, rules.OVERDUE_DAYS, 1)
    return segments_.withColumn("gap_type", F.explode(hits)).withColumn("days", F.when(days != "", days.cast("int")))


def _judged() -> tuple[Column, Column]:
    """Whether a gap is open, and its severity, by gap_type, different, days and the columns of CLOSED (whether a text of
    the asset closes it)."""
    open_gap, severity = F.lit(True), F.lit(None).cast("string")
    for r in rules.GAPS:
        severity = F.when(F.col("gap_type") == r.name, r.severity).otherwise(severity)
        if r.closed:
            open_gap = open_gap & ((F.col("gap_type") != r.name) | ~F.coalesce(F.col(r.name), F.lit(False)))
        if r.at_least > 1:
            open_gap = open_gap & ((F.col("gap_type") != r.name) | (F.col("different") >= r.at_least))
    severity = F.when((F.col("gap_type") == "calibration_overdue") & (F.col("days") >= rules.LONG_OVERDUE), "high").otherwise(severity)
    return open_gap, severity.alias("severity")


def _different() -> Column:
    return F.countDistinct(F.lower(F.substring("sentence", 1, 60)))


def open_gaps(evidence: DataFrame, most_evidence: int = 3) -> DataFrame:
    """tag, gap_type, severity, n_evidence, different (sentences), days (overdue, of the newest match that says so), evidence (chunks of the newest matches), and span,
    sentence and line of the newest, in no order.

    A gap needs its rule's patterns in one span and no closing evidence in any text of the asset; each text is searched
    on its own, so that no pattern spans two. The segments are made once and dealt once. Empty evidence gives no gaps.
    """
    place = F.row_number().over(Window.partitionBy("tag", "gap_type").orderBy(*newest()))
    found = _found(segments(evidence)).withColumn("r", place)
    cited = F.struct("r", F.concat_ws("-", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("c"))
    by = found.groupBy("tag", "gap_type").agg(
        F.count("*").alias("n_evidence"), _different().alias("different"), F.min_by("days", F.when(F.col("days").isNotNull(), F.col("r"))).alias("days"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= most_evidence, cited))).alias("e"), F.min_by(F.struct("span", "sentence", "line"), "r").alias("first"),
    )
    flags = evidence.groupBy("tag").agg(*(F.max(F.lower("text").rlike(r.closed)).alias(r.name) for r in CLOSED))
    open_gap, severity = _judged()
    out = by.join(flags, "tag").where(open_gap)
    return out.select("tag", "gap_type", severity, "n_evidence", "different", "days", F.expr("array_join(transform(e, x -> x.c), '|')").alias("evidence"), "first.*")


def open_kinds(evidence: DataFrame) -> DataFrame:
    """tag, gap_type, severity of the open gaps: those of open_gaps, without what they are cited by.

    Each different text of a tag is searched once, with the newest chunk that has it. If evidence is dealt by tag,
    nothing is dealt again.
    """
    newest_ = F.max(F.struct("created_at", "document_id", F.col("chunk_index").isNull().alias("none"), (-F.col("chunk_index")).alias("before"))).alias("newest")
    flag = lambda r: F.max(F.lower("text").rlike(r.closed)).over(Window.partitionBy("tag")).alias(r.name)
    texts = evidence.groupBy("tag", "text").agg(newest_).select("*", *map(flag, CLOSED))
    closed = [r.name for r in CLOSED]
    found = _found(_segments(texts, ["tag", "text", "newest", *closed]))
    place = F.when(F.col("days").isNotNull(), F.struct("newest", (-F.col("line_no")).alias("line"), (-F.col("sentence_no")).alias("sentence")))
    by = found.groupBy("tag", "gap_type").agg(_different().alias("different"), F.max_by("days", place).alias("days"), *(F.max(c).alias(c) for c in closed))
    open_gap, severity = _judged()
    return by.where(open_gap).select("tag", "gap_type", severity)


def gaps(evidence: DataFrame, most_evidence: int = 3) -> DataFrame:
    """tag, gap_type, severity, n_evidence, evidence of the open gaps, ordered by severity."""
    found = open_gaps(evidence, most_evidence).select("tag", "gap_type", "severity", "n_evidence", "evidence")
    return found.orderBy(F.desc(rules.severity_rank(F.col("severity"))), "tag", "gap_type")


def gap_counts(evidence: DataFrame) -> DataFrame:
    """gap_type, severity, gaps, assets."""
    return open_gaps(evidence).groupBy("gap_type", "severity").agg(F.count("*").alias("gaps"), F.countDistinct("tag").alias("assets"))


def gap_records(evidence: DataFrame, today: Column | None = None) -> DataFrame:
    """tag, gap_type, severity, certified (the date of an expired certificate), standard (of the newest match's line),
    reason, action, said (its sentence, cut). today: what dates are compared with, in UTC unless it is given."""
    today = F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())) if today is None else today
    each = open_gaps(evidence)
    text = lambda kind: F.element_at(F.create_map(*(F.lit(x) for g, t in rules.GAP_TEXTS.items() for x in (g, t[kind]))), F.col("gap_type"))
    filled = lambda kind: F.replace(F.replace(text(kind), F.lit("{tag}"), F.col("tag")), F.lit("{n}"), F.col("different").cast("string"))
    certified = F.when(F.col("gap_type") == "certificate_expired", facts.first_date(F.col("span")))
    a, b, c = map(F.lit, rules.DATE_NOTE)
    dated = F.coalesce(F.concat(a, certified.cast("string"), b, today.cast("string"), c), F.lit(""))
    late = F.coalesce(F.when(F.col("days") > 0, F.concat(F.lit(rules.OVERDUE_NOTE[0]), F.col("days").cast("string"), F.lit(rules.OVERDUE_NOTE[1]))), F.lit(""))
    reason = F.replace(F.replace(filled(0), F.lit("{date}"), dated), F.lit("{overdue}"), late)
    return each.select("tag", "gap_type", "severity", certified.alias("certified"), facts.standard(F.col("line")).alias("standard"), reason.alias("reason"), filled(1).alias("action"), facts.cut(F.col("sentence"), 320, "…").alias("said"))


def filtered(gaps_: DataFrame, tag: str | None = None, severity: str | None = None, gap_type: str | None = None) -> DataFrame:
    """gaps of a tag, a severity, a type; case doesn't matter, None takes all."""
    for column, value in (("tag", tag), ("severity", severity), ("gap_type", gap_type)):
        if value is not None:
            gaps_ = gaps_.where(F.lower(column) == value.strip().lower())
    return gaps_


def gap_tabs(evidence: DataFrame) -> DataFrame:
    """tab, gaps: counts of certificates, of what is overdue, of severe gaps and of pumps'."""
    tabs = {"certificates": F.col("gap_type").startswith("certificate"), "overdue": F.col("gap_type").isin("calibration_overdue", "inspection_overdue", "sop_review_overdue"), "severe": F.col("severity") == "high", "pumps": F.col("tag").startswith("P-")}
    one = open_gaps(evidence).agg(*(F.count_if(c).alias(n) for n, c in tabs.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("tab"), F.col(n).alias("gaps")) for n in tabs))).alias("t")).select("t.*")
