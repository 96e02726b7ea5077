"""Hand-written cases of the library: what each rule says of a few rows."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millwright.functions import facts
from millwright.operators import causes, compliance, conversation, evaluation, graph, hybrid, layout, retrieval, work_orders
from millwright.sources import files
from millwright.streaming import events as stream


def one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_tags(spark):
    got = one(spark, facts.tags(F.col("t")), t="p-101 and P-101, P-204A, V-101, HX-302, MTR-07, COMP-301, T-301, B-12, C-220, OISD-137.")
    assert [x["tag"] for x in got] == ["P-101", "P-204A", "V-101", "HX-302", "MTR-07", "COMP-301", "T-301", "B-12", "C-220", "OISD-137"]
    assert [x["position"] for x in got[:3]] == [0, 17, 25]
    assert got[0]["asset_type"] == "pump" and got[8]["asset_type"] is None and (got[7]["confidence"], got[8]["confidence"]) == (0.95, 0.6)


@pytest.mark.parametrize(("text", "date"), [("expired (01-Feb-2025)", datetime.date(2025, 2, 1)), ("of September 2023.", datetime.date(2023, 9, 1)), ("none", None), ("31 Feb 2024", None), ("5 Foo 2024 in May 2024", None)])
def test_dates(spark, text, date):
    assert one(spark, facts.first_date(F.col("t")), t=text) == date


def test_facts(spark):
    said = "Seal failure: replace the  mechanical seal BRG-6309-A, 7.8 mm/s, SOP-001X, ISO 9001:2015; recheck required, overdue. [Page 12]"
    got = {k: one(spark, v, t=said) for k, v in facts.free_text_facts(F.col("t")).items()}
    assert got == {"inspection_reading": "7.8 mm/s", "sop_reference": "SOP-001X", "compliance_reference": "ISO 9001:2015", "spare_part": "BRG-6309-A", "failure_mode": "seal failure", "risk_phrase": "overdue", "open_action": "recheck required", "maintenance_action": "replace the mechanical seal BRG"}
    assert one(spark, facts.page_number(F.col("t")), t=said) == 12
    rows = spark.createDataFrame([("P-101", "nan", " Closed ")], ["Equipment ID", "Failure_Mode", "Status"])
    assert rows.select(*(v.alias(k) for k, v in facts.row_facts(rows).items())).first().asDict() == {"equipment_tag": "P-101", "failure_mode": None, "open_action": "Closed"}


@pytest.mark.parametrize(("question", "intent"), [("How to start P-101?", "procedure"), ("Why did it leak", "failure_rca"), ("past work orders", "maintenance_history"), ("latest readings", "inspection"), ("is the certificate valid", "compliance"), ("hello", "general")])
def test_intents(spark, question, intent):
    assert one(spark, facts.intent(F.col("q")), q=question) == intent


def test_boosts_and_scope(spark):
    assert one(spark, facts.file_boost(F.col("q"), F.col("f")), q="Which inspection findings are pending", f="Q3_report.pdf") == 0.12
    assert one(spark, facts.file_boost(F.col("q"), F.col("f")), q="hello", f="Q3_report.pdf") == 0
    assert one(spark, facts.scoped(F.col("q"), F.col("t")), q="Why?", t="P-101") == "Why? Asset tag: P-101."
    assert one(spark, facts.scoped(F.col("q"), F.col("t")), q="Why p-101?", t="P-101") == "Why p-101?"
    assert one(spark, facts.safe_component(F.col("t")), t="../a b/P-101..") == "a-b-P-101"
    assert one(spark, hybrid.confidence(F.col("t"), F.col("n")), t=0.5, n=7) == 0.65
    assert one(spark, causes.cause_confidence(F.col("n")), n=2) == 0.54 and one(spark, causes.cause_confidence(F.col("n")), n=9) == 0.75


CHUNK = "chunk_id long, file_name string, text string, summary string, questions string, tags array<string>, row_start int"


def test_keyword_scores_and_fusion(spark):
    chunks = spark.createDataFrame([(1, "a.txt", "Pump seal replaced", "seal work", "Which seal was replaced?", ["P-101"], 1), (2, "b.txt", "nothing here", "", None, [], 2), (3, "c.txt", "sealing", None, None, ["P-102"], 3)], CHUNK)
    q = spark.createDataFrame([(9, "Which seal was replaced on P-101?")], "item_id long, question string")
    got = {r.chunk_id: r.score for r in hybrid.keyword_topk(chunks, q, 10).collect()}
    # tokens: seal, was, replaced, p-101; seal 2+1+3, was 3, replaced 1+3, and the asset among the tags 8
    assert got == {1: 21.0, 3: 1.0}
    first = hybrid.ranked(chunks, q).orderBy("place").first()
    assert first.chunk_id == 1 and first.score == 1.0
    assert hybrid.answers(chunks, q).first().citations[0] == "a.txt"


def plain_mmr(raw, names, rows, tokens, k):
    """Every remaining candidate against every chosen one, each time."""
    left, chosen = list(range(len(raw))), []
    while left and len(chosen) < k:
        best, score = None, -9.0
        for i in left:
            if chosen and sum(names[j] == names[i] for j in chosen) >= 2:
                continue
            s = raw[i] if not chosen else 0.72 * raw[i] - (1 - 0.72) * max(hybrid.similarity(tokens[i], tokens[j], names[i] == names[j], rows[i], rows[j]) for j in chosen)
            if not chosen:
                best = left[0]
                break
            if s > score:
                best, score = i, s
        if best is None:
            break
        chosen.append(best)
        left.remove(best)
    return chosen + left[: k - len(chosen)]


def test_mmr():
    assert hybrid.select_diverse([1.0, 0.98, 0.93], ["a", "a", "b"], [1, 2, 9], [{"x", "y"}, {"x", "y"}, {"z"}], 2) == [0, 2]
    assert hybrid.select_diverse([1.0, 0.9, 0.8, 0.7], ["a"] * 4, [None] * 4, [{"x"}] * 4, 3) == [0, 1, 2]
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 25)
        raw = sorted((r.random() for _ in range(n)), reverse=True)
        names, rows = [r.choice("abcd") for _ in range(n)], [r.choice([None, r.randint(1, 9)]) for _ in range(n)]
        tokens = [set(r.sample("pqrstuv", r.randint(0, 5))) for _ in range(n)]
        assert hybrid.select_diverse(raw, names, rows, tokens, 6) == plain_mmr(raw, names, rows, tokens, 6)


def test_cosine(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in v.select(retrieval.cosine("a", "b")).collect()] == [0.7071, 0, 0]
    assert v.select(retrieval.fitted(F.col("b"), 3)).first()[0] == pytest.approx([2**-0.5, 2**-0.5, 0])


EVIDENCE = "tag string, document_id long, chunk_index int, created_at timestamp_ntz, text string"


def test_root_causes(spark):
    day = datetime.datetime(2025, 1, 1)
    evidence = spark.createDataFrame([("P-101", 1, 0, day, "P-101 seal replaced, bearing noise."), ("P-101", 2, 0, day, "P-101 coupling aligned."), ("P-101", 3, 0, day, "V-7 bearing")], EVIDENCE)
    symptoms = spark.createDataFrame([("P-101", "high vibration after seal replacement"), ("V-9", "leak")], "tag string, symptom string")
    got = {r.number: r for r in causes.root_causes(symptoms, evidence).collect()}
    assert set(got) == {1, 2} and got[1].support == 2 and got[1].confidence == 0.54 and got[2].evidence == ["1-0"]
    unknown = causes.root_causes(symptoms.replace("high vibration after seal replacement", "odd"), evidence).collect()
    assert [(r.number, r.confidence) for r in unknown] == [(0, 0.25)] and "P-101" in unknown[0].cause


@pytest.mark.parametrize(("text", "gap"), [
    ("P-101 certificate: EXPIRED (01-Feb-2025). Required by Factories Act.", "certificate_expired"),
    ("P-101 LT-101-01 - Calibration: OVERDUE by 45 days.", "calibration_overdue"),
    ("P-101 vibration NON-COMPLIANT, exceeds the limit.", "inspection_overdue"),
    ("BLR-118 certificate expired, P-101 vibration, TK-482 calibration overdue", None),
])
def test_gaps(spark, text, gap):
    rows = [("P-101", 1, 0, datetime.datetime(2025, 1, 1), text)]
    got = compliance.gap_records(spark.createDataFrame(rows, EVIDENCE)).collect()
    assert [r.gap_type for r in got] == ([gap] if gap else [])
    if gap == "certificate_expired":
        assert got[0].certified == datetime.date(2025, 2, 1) and got[0].standard == "Factories Act"
    closed = [*rows, ("P-101", 2, 0, datetime.datetime(2025, 1, 2), "P-101 NCR 7 closed")]
    if gap == "inspection_overdue":
        assert compliance.gaps(spark.createDataFrame(closed, EVIDENCE)).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([("P-1", "pump"), ("V-1", None)], "tag string, asset_type string")
    new = spark.createDataFrame([(" p-1", "valve", 1), ("x-2 ", "b", 2), ("X-2", "a", 1), (" ", "c", 1)], "tag string, asset_type string, seen_at int")
    assert sorted(((r.tag, r.asset_type) for r in graph.registered(old, new).collect()), key=str) == [("P-1", "pump"), ("V-1", None), ("X-2", "a")]
    assert {r.tag: r.asset_type for r in graph.registered(old, new, True).collect()}["P-1"] == "valve"
    edges = spark.createDataFrame([("a", None), ("b", 1)], "s string, c int")
    assert [tuple(r) for r in graph.new_edges(edges, spark.createDataFrame([("a", None), ("b", None), ("b", None)], "s string, c int"), ["s", "c"]).collect()] == [("b", None)]


def test_layout(spark):
    text = "# Startup\n- open valve\n- check seal\n\nRun the pump.\nWatch it.\nSAFETY FIRST\nText:\nmore"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.element_type, r.section, r.text) for r in layout.elements(docs).orderBy("element").collect()]
    assert got == [("heading", "Startup", "Startup"), ("list_item", "Startup", "- open valve\n- check seal"), ("paragraph", "Startup", "Run the pump.\nWatch it."), ("heading", "SAFETY FIRST", "SAFETY FIRST"), ("heading", "Text", "Text"), ("paragraph", "Text", "more")]
    assert [(r.section, r.elements) for r in layout.parents(layout.elements(docs)).orderBy("parent").collect()] == [("Startup", 3), ("SAFETY FIRST", 1), ("Text", 2)]
    r = random.Random(2)
    long = spark.createDataFrame([(7, i, "paragraph", "s", "x" * r.choice([10, 3000, 5000, 12000])) for i in range(30)], "doc_id long, element int, element_type string, section string, text string")
    size, group, want = 0, -1, []
    for e in long.orderBy("element").collect():
        for part in [e.text[i : i + 11000] for i in range(0, len(e.text), 11000)] if len(e.text) > 11000 else [e.text]:
            if group < 0 or size + len(part) > 9000:
                group, size = group + 1, 0
                want.append(0)
            size += len(part) + 2
            want[group] += 1
    assert [r.elements for r in layout.parents(long).orderBy("parent").collect()] == want


def test_conversations(spark):
    m = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f" q{i} ") for i in range(10)] + [(1, 10, "system", "x"), (2, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    s = conversation.summaries(m)
    assert [(r.conv_id, r.cursor, r.summary) for r in s.collect()] == [(1, 4, "user: q0\nassistant: q1\nuser: q2\nassistant: q3")]
    later = conversation.summaries(m, spark.createDataFrame([(1, 2, "before")], "conv_id long, cursor int, summary string")).first()
    assert (later.cursor, later.summary) == (4, "before\nuser: q2\nassistant: q3")
    entries = conversation.memory(m, s).first().entries
    assert len(entries) == 7 and entries[1].text == "q4" and entries[0].text.startswith("Conversation summary: user: q0")


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "c")], "item_id long, rank int, file_name string")
    expected = spark.createDataFrame([(1, "b"), (2, "gone"), (3, "a")], "item_id long, file_name string")
    corpus = spark.createDataFrame([("a",), ("b",), ("c",)], "file_name string")
    o = evaluation.outcomes(expected, hits, corpus)
    assert {r.item_id: (r.top1, r.top3, r.category) for r in o.collect()} == {1: (False, True, "pass"), 2: (False, False, "expected_source_absent_from_corpus"), 3: (False, False, "correct_document_not_retrieved")}
    values = spark.createDataFrame([("a", float(i)) for i in range(11)], "k string, v double")
    assert evaluation.nearest_rank(values, "k", "v").first().percentile == 10.0  # round(9.5) to even


def test_work_orders(spark):
    rows = [(" p-101 ", "ppdm", "x", "1"), ("P-101", "XX", "x", "2"), ("Z-1", "CM", "x", "3"), ("TK-5", "cm", "y", "4")]
    got = work_orders.cleaned(spark.createDataFrame(rows, ["Equipment_ID", "OrderType", "Other", "OrderStatus"]))
    assert got.columns == ["Equipment_ID", "OrderType", "OrderStatus"] and sorted((r[0], r[1]) for r in got.collect()) == [("P-101", "PDM"), ("TK-5", "CM")]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Equipment_ID;Action\nP-101;"Replaced; seal"\n;\n')
    rows = files.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert rows.columns == ["Equipment_ID", "Action"] and rows.count() == 2
    assert rows.select(files.labelled_row_text(rows, rows.columns)).first()[0] == "'Equipment_ID': P-101. 'Action': Replaced; seal."
    assert rows.select(files.row_text(rows, rows.columns, "S1")).first()[0] == "Sheet: S1\nEquipment_ID: P-101\nAction: Replaced; seal"
    (tmp_path / "s.jsonl").write_text('{"parent_chunk_id": "a", "summary_text": "x"}\n{"parent_chunk_id": "a", "summary_text": "y"}\n')
    with pytest.raises(Exception, match="repeated id"):
        files.manual_summaries(spark, f"file://{tmp_path}/s.jsonl").collect()
    (tmp_path / "t.txt").write_text("  hello \n")
    assert files.read_texts(spark, f"file://{tmp_path}/t.txt").select("text", "file_name").first() == ("hello", "t.txt")
    assert files.kind_of("x.MD") == "md" and files.kind_of("x", "text/csv; charset=x") == "csv"
    with pytest.raises(ValueError, match="unsupported"):
        files.kind_of("x.exe")
    table = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k long, v string")
    for _ in range(2):
        files.write_once(table, f"file://{tmp_path}/out", ["k"])
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    pages = causes.as_markdown(spark.createDataFrame([("P-1", ["i"], [], ["m"], "s")], "tag string, inspection array<string>, maintenance array<string>, missing array<string>, summary string"), "now")
    files.write_markdown(pages, f"file://{tmp_path}/md")
    assert '- "i"' in spark.read.text(f"file://{tmp_path}/md", wholetext=True).first()[0]


def test_streams(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(minutes=7 * i), i % 3, "view", 1.0) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(4).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        stream.ingest(stream.read_stream(spark, f"file://{tmp_path}/in", 1), f"file://{tmp_path}/table", f"file://{tmp_path}/points", ["event_id"])
    assert spark.read.parquet(f"file://{tmp_path}/table").count() == 40
    source = stream.read_stream(spark, f"file://{tmp_path}/in")
    totals = stream.running_totals(source).writeStream.format("memory").queryName("totals").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    totals.awaitTermination()
    assert spark.sql("select sum(events) from totals").first()[0] == 40
    whole = stream.windowed(spark.read.parquet(f"file://{tmp_path}/in"))
    streamed = stream.windowed(source).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start()
    streamed.awaitTermination()
    assert spark.sql("select sum(events) from windows").first()[0] == 40 and whole.agg(F.sum("events")).first()[0] == 40
