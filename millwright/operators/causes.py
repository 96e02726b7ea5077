"""Root causes of symptoms, and evidence packages, for all assets at once."""

from __future__ import annotations

from string import Formatter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import facts, rules
from ..functions.text import contains_any
from . import search


class Cause(NamedTuple):
    triggers: list[str]
    cause: str
    indicators: list[str]
    actions: list[str]
    missing: list[str]


# What a symptom may come from.
CAUSES = [
    Cause(["vibrat", "imbalance", "unbalance"], "Shaft/coupling misalignment, likely introduced during recent maintenance.", ["misalign", "coupl", "align", "seal", "replace", "maintenance", "overhaul"],
          ["Perform a precision (laser) shaft alignment check between the driver and driven equipment.", "Re-baseline vibration readings after any alignment correction."], ["Confirmation that a post-maintenance alignment check was completed.", "Latest vibration spectrum / FFT analysis."]),
    Cause(["vibrat", "noise", "bearing"], "Bearing wear or degradation on the affected equipment.", ["bearing", "defect frequency", "lubric", "grease", "noise"],
          ["Inspect and trend the drive-end and non-drive-end bearings.", "Review the lubrication schedule and bearing condition history."], ["Bearing vibration / temperature trend data.", "Lubricant (oil) analysis results."]),
    Cause(["overheat", "temperature", "hot", "thermal"], "Inadequate lubrication or cooling.", ["lubric", "oil", "grease", "cool", "coolant", "flow"],
          ["Verify lubrication level/quality and confirm the cooling system is operating.", "Check for restricted cooling passages or fouling."], ["Lubricant analysis and temperature trend data."]),
    Cause(["overheat", "temperature", "overload", "load", "current", "trip"], "Excessive load or overcurrent condition.", ["load", "current", "amp", "overload", "power", "overcurrent"],
          ["Review operating load and motor current against rated values."], ["Recent load / motor current readings."]),
    Cause(["overheat", "temperature", "insulation", "winding", "earth", "phase"], "Insulation or winding degradation.", ["insulation", "winding", "megger", "earth", "phase", "ir "],
          ["Perform insulation resistance (IR) testing on the windings."], ["Insulation resistance test records."]),
    Cause(["leak", "leakage", "seep", "weep"], "Mechanical seal degradation.", ["seal", "gland", "packing", "flush"],
          ["Inspect the mechanical seal condition and seal faces.", "Verify the seal flush plan and shaft alignment."], ["Seal inspection / replacement history."]),
    Cause(["leak", "leakage", "corros"], "Gasket / joint or corrosion-related leakage.", ["gasket", "flange", "joint", "corros"],
          ["Inspect flange joints, gaskets and surfaces for corrosion."], ["Recent inspection findings for joints/gaskets."]),
    Cause(["foul", "clog", "block", "restrict"], "Fouling or flow restriction.", ["foul", "clean", "tube", "clog", "deposit"],
          ["Schedule cleaning / de-fouling and inspect for flow restriction."], ["Differential pressure / flow trend data."]),
]
# What an asset without a known cause is told.
UNKNOWN = "Condition consistent with the most recent records retrieved for {}; specific root cause could not be isolated from the available evidence."


def cause_confidence(support: Column) -> Column:
    return F.when(support <= 0, 0.25).otherwise(F.bround(F.least(0.3 + 0.12 * support, F.lit(0.75)), 2))


def root_causes(symptoms: DataFrame, evidence: DataFrame, most: int = 10, cited: int = 3) -> DataFrame:
    """tag, number (of the rule, 0 if none applied), cause, confidence, support, evidence (chunks), actions, missing.

    symptoms: tag, symptom; evidence: tag, document_id, chunk_index, created_at, text, of which the newest `most` that
    name the tag count. A rule applies if the symptom has a trigger, and the symptom or a chunk an indicator. A symptom
    without evidence gives no row.
    """
    named = evidence.where(F.expr(r"regexp_like(text, concat('(?i)\\b\\Q', tag, '\\E\\b'))"))
    newest = Window.partitionBy("tag").orderBy(F.desc_nulls_last("created_at"), F.desc("document_id"), "chunk_index")
    kept = named.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= most)
    by = kept.groupBy("tag").agg(_entries(F.concat_ws("-", "document_id", "chunk_index")))  # `most` rows a tag
    return _by_rules(symptoms.select("tag", "symptom").join(by, "tag"), cited)


def _entries(chunk: Column) -> Column:
    """e: the chunks of a group by r, and which rule's indicators each has."""
    low = F.lower("text")
    return F.array_sort(F.collect_list(F.struct("r", chunk.alias("chunk"), *(contains_any(low, c.indicators).alias(f"has_{i}") for i, c in enumerate(CAUSES))))).alias("e")


def _by_rules(joined: DataFrame, cited: int) -> DataFrame:
    """(tag, symptom, e) -> what root_causes returns."""
    joined = joined.withColumn("low", F.lower("symptom"))

    def rule(i: int, c: Cause) -> Column:
        holds = F.expr(f"filter(e, x -> x.has_{i})")
        applies = contains_any(F.col("low"), c.triggers) & ((F.size(holds) > 0) | contains_any(F.col("low"), c.indicators))
        chunks = F.slice(F.transform(F.when(F.size(holds) > 0, holds).otherwise(F.slice("e", 1, 1)), lambda x: x["chunk"]), 1, cited)
        return F.when(applies, F.struct(F.lit(i + 1).alias("number"), F.lit(c.cause).alias("cause"), F.size(holds).alias("support"), chunks.alias("evidence"), F.array(*map(F.lit, c.actions)).alias("actions"), F.array(*map(F.lit, c.missing)).alias("missing")))

    found = joined.withColumn("found", F.filter(F.array(*(rule(i, c) for i, c in enumerate(CAUSES))), lambda x: x.isNotNull()))
    before, after = UNKNOWN.split("{}")
    tag, symptom = F.col("tag"), F.col("symptom")
    unknown = F.struct(
        F.lit(0).alias("number"), F.concat(F.lit(before), tag, F.lit(after)).alias("cause"), F.lit(0).alias("support"), F.slice(F.transform("e", lambda x: x["chunk"]), 1, 2).alias("evidence"),
        F.array(F.concat(F.lit("Review the retrieved records for "), tag, F.lit(" and gather targeted diagnostic data for the reported symptom."))).alias("actions"),
        F.array(F.concat(F.lit("Diagnostic data (trends, spectra, readings) specific to '"), symptom, F.lit("'."))).alias("missing"),
    )
    rows = found.select("tag", "symptom", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(unknown))).alias("c"))
    return rows.select("tag", "symptom", "c.number", "c.cause", cause_confidence(F.col("c.support")).alias("confidence"), "c.support", "c.evidence", "c.actions", "c.missing")


# The question for evidence, and what a symptom without any is told.
ASK = "Evidence for root cause of '{symptom}' on asset {tag}"
NOT_SPECIFIC = "Insufficient evidence specific to {tag} was retrieved to determine a root cause for '{symptom}'. Retrieved documents did not reference this asset."
NOTHING = "No documents were retrieved for {tag}, so a root cause for '{symptom}' cannot be determined."
ANALYSIS = "Analysis of {n_evidence} evidence item(s) retrieved for {tag} indicates {n_causes} likely cause(s) for '{symptom}' (top confidence {top})."
REVIEW = ["Manually review maintenance logs and inspection reports for {tag}.", "Confirm that documentation for {tag} has been ingested into the knowledge base."]
RECORDS = ["Any maintenance, inspection or work-order records that explicitly reference {tag}."]


def _said(pattern: str, **values: Column) -> Column:
    parts = [(F.lit(text), values[name] if name else F.lit("")) for text, name, *_ in Formatter().parse(pattern)]
    return F.concat(*(x for pair in parts for x in pair))


def retrieved_causes(symptoms: DataFrame, chunks: DataFrame, k: int = 10, cited: int = 3) -> DataFrame:
    """What root_causes returns, and summary, n_retrieved, n_evidence: of the k chunks that search finds for each symptom
    (tag, symptom, model) those that name its tag are the evidence. A symptom without any has one row with a null number
    and cause, and says what to look for. Rows of one tag and symptom are one symptom; a null tag or symptom is ''."""
    once = symptoms.select(F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("symptom", F.lit("")).alias("symptom"), "model").dropDuplicates(["tag", "symptom"])
    tag, symptom = F.col("tag"), F.col("symptom")
    asked = once.select(F.struct("tag", "symptom").alias("question_id"), _said(ASK, tag=tag, symptom=symptom).alias("question"), "tag", "model")
    found = search.evidence(chunks, asked, k).select("question_id.tag", "question_id.symptom", F.col("place").alias("r"), F.col("chunk_id").cast("string").alias("chunk"), "text")
    names = search.names(F.col("text"), tag)
    by = found.where(names).groupBy("tag", "symptom").agg(_entries(F.col("chunk")))  # k rows a symptom
    counted = found.groupBy("tag", "symptom").agg(F.count("*").alias("n_retrieved"), F.count_if(names).alias("n_evidence"))
    said = _by_rules(by, cited).join(counted, ["tag", "symptom"])
    group = Window.partitionBy("tag", "symptom")  # a row for each rule
    top = F.format_string("%.2f", F.max("confidence").over(group))
    said = said.withColumn("summary", _said(ANALYSIS, tag=tag, symptom=symptom, n_evidence=F.col("n_evidence").cast("string"), n_causes=F.count("*").over(group).cast("string"), top=top))
    without = once.join(counted, ["tag", "symptom"], "left").where("coalesce(n_evidence, 0) = 0")
    none = F.when(F.coalesce("n_retrieved", F.lit(0)) > 0, _said(NOT_SPECIFIC, tag=tag, symptom=symptom)).otherwise(_said(NOTHING, tag=tag, symptom=symptom))
    rest = without.select(
        "tag", "symptom", F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("cause"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("support"), F.array().cast("array<string>").alias("evidence"),
        F.array(*(_said(x, tag=tag) for x in REVIEW)).alias("actions"), F.array(*(_said(x, tag=tag) for x in RECORDS)).alias("missing"), F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"), F.lit(0).cast("long").alias("n_evidence"), none.alias("summary"),
    )
    return said.unionByName(rest)


# Which events are evidence of which kind, and what a package says is missing.
INSPECTION_EVENTS, MAINTENANCE_EVENTS = ["inspection", "failure", "compliance"], ["work_order", "procedure"]
MISSING = [
    ("inspection_overdue", "No completed follow-up inspection is recorded for the flagged exceedance."),
    ("repeated_failure_no_rca", "No formal root-cause analysis is on file for the recurring failures."),
    ("safety_procedure_missing", "No LOTO / permit-to-work evidence is linked to safety-critical maintenance."),
]
NO_INSPECTION = "No inspection evidence was found for this asset in the indexed corpus."
NO_MAINTENANCE = "No maintenance/work-order evidence was found for this asset."
MOST_FINDINGS = 12


def packages(events: DataFrame, gaps: DataFrame) -> DataFrame:
    """tag, mentions, documents, gaps, high_gaps, inspection and maintenance (texts of the newest events, distinct by chunk
    and beginning, MOST_FINDINGS each), missing, summary. events: graph.timeline; gaps: tag, gap_type, severity.

    All that is said of an asset comes from one chain of groups within its tag: if events are dealt by tag, nothing is
    dealt again."""
    of_gaps = gaps.groupBy("tag").agg(F.count("*").alias("gaps"), F.count_if(F.col("severity") == "high").alias("high_gaps"), F.collect_set("gap_type").alias("kinds"))
    start = F.substring("preview", 1, 60)
    x = F.max_by(F.struct("event_type", "preview", "date", "mention_id"), F.struct("date", -F.col("mention_id")))
    once = events.groupBy("tag", "document_id", "chunk_index", start.alias("start")).agg(x.alias("x"), F.count("*").alias("n"), F.max(F.col("filename").isNotNull()).alias("named"))
    kind = F.when(F.col("x.preview").isNull(), None).when(F.col("x.event_type").isin(INSPECTION_EVENTS), "inspection").when(F.col("x.event_type").isin(MAINTENANCE_EVENTS), "maintenance")
    of_document = Window.partitionBy("tag", "document_id").orderBy("chunk_index")  # in the order that the groups leave
    first = (F.row_number().over(of_document) == 1) & F.max("named").over(of_document.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = once.select("tag", "n", (first & F.col("document_id").isNotNull()).alias("document"), kind.alias("kind"), "x.preview", "x.date", "x.mention_id")
    order = Window.partitionBy("tag", "kind").orderBy(F.desc_nulls_last("date"), "mention_id")
    kept = each.withColumn("r", F.row_number().over(order))
    text = lambda k: F.when((F.col("kind") == k) & (F.col("r") <= MOST_FINDINGS), F.struct("r", "preview"))
    texts = lambda k: F.transform(F.array_sort(F.collect_list(text(k))), lambda x: x["preview"]).alias(k)
    facts_ = kept.groupBy("tag").agg(F.sum("n").alias("mentions"), F.count_if("document").alias("documents"), texts("inspection"), texts("maintenance"))
    none = F.array().cast("array<string>")
    out = facts_.join(of_gaps, "tag", "left").withColumns({"kinds": F.coalesce("kinds", none), "gaps": F.coalesce("gaps", F.lit(0)), "high_gaps": F.coalesce("high_gaps", F.lit(0))})
    said = [F.when(F.array_contains("kinds", k), F.lit(t)) for k, t in MISSING] + [F.when(F.size("inspection") == 0, F.lit(NO_INSPECTION)), F.when(F.size("maintenance") == 0, F.lit(NO_MAINTENANCE))]
    missing = F.filter(F.array(*said), lambda x: x.isNotNull())
    summary = F.format_string("%s is supported by %d evidence mention(s) across %d source document(s). The compliance engine detected %d open gap(s), %d at high severity, all backed by cited evidence.", "tag", "mentions", "documents", "gaps", "high_gaps")
    return out.select("tag", "mentions", "documents", "gaps", "high_gaps", "inspection", "maintenance", missing.alias("missing"), summary.alias("summary"))


def as_markdown(packages_: DataFrame, generated_at: str) -> DataFrame:
    """tag, file_name, markdown of each package."""
    bullets = lambda c, none: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit('- "'), x, F.lit('"'))), "\n")).otherwise(F.lit(none))
    parts = [
        F.concat(F.lit("# Evidence Package — "), "tag"), F.concat(F.lit("- **Generated at (UTC):** "), F.lit(generated_at)), F.lit("## 1. Asset Summary"), F.col("summary"), F.lit("## 2. Inspection Evidence"), bullets("inspection", "_No inspection evidence found._"),
        F.lit("## 3. Maintenance Evidence"), bullets("maintenance", "_No maintenance evidence found._"), F.lit("## 4. Missing Evidence"), bullets("missing", "_None._"),
    ]
    return packages_.select("tag", F.concat(facts.safe_component(F.col("tag")), F.lit(".md")).alias("file_name"), F.concat_ws("\n\n", *parts).alias("markdown"))


def failure_intelligence(mentions: DataFrame, most_actions: int = 8) -> DataFrame:
    """tag, failure_events, documents, modes ('name:count', most frequent first), repeated, coverage, actions (newest
    mentions of maintenance, counted), sufficient: of every tag, also those without failures. One pass, no explode."""
    haystack = F.concat_ws(" ", F.lower("filename"), F.lower("text"))
    flags = {name: contains_any(F.col("haystack"), keys) for name, keys in rules.FAILURE_MODES}
    m = mentions.withColumn("haystack", haystack).select("tag", "document_id", contains_any(F.col("haystack"), rules.MAINTENANCE).alias("maintenance"), *(f.alias(n) for n, f in flags.items()))
    failed = F.greatest(*(F.col(n) for n in flags))
    by = m.groupBy("tag").agg(F.count_if(failed).alias("failure_events"), F.countDistinct(F.when(failed, F.col("document_id"))).alias("documents"), F.least(F.count_if("maintenance"), F.lit(most_actions)).alias("actions"), *(F.count_if(F.col(n)).alias(n) for n in flags))
    counted = F.array_sort(F.filter(F.array(*(F.struct((-F.col(n)).alias("n"), F.lit(n).alias("mode")) for n in flags)), lambda x: x["n"] < 0))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x["mode"], F.lit(":"), (-x["n"]).cast("string"))), "|")
    return by.select("tag", "failure_events", "documents", said(counted).alias("modes"), said(F.filter(counted, lambda x: x["n"] <= -2)).alias("repeated"), rules.coverage(F.col("failure_events"), F.col("documents")).alias("coverage"), "actions", (F.col("failure_events") > 0).alias("sufficient"))
