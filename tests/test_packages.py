"""Evidence packages: what is dealt, and the same as by the joins and gaps that each query has of its own."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwright.operators import causes, compliance, graph
from millwright.plans import catalog
from millwright.sources import star

SF = "/root/testdata/sf0.001"


@pytest.fixture
def by_exchange(spark):
    """No join by broadcast, as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt(df):
    """Exchanges of the plan that ran, those used again left out."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"[+:]- Exchange ", ran))


def test_mentions_are_dealt_once(spark, by_exchange):
    """Items by order, with the orders; by part, with the parts; by tag. 35 exchanges came before."""
    assert dealt(catalog.QUERIES["evidence_packages"](spark, SF)) <= 5


def test_same_mentions_as_by_joins(spark):
    left, findings = star.mentions_by_tag(spark, SF)
    want = graph.evidence(**star.gone(spark, SF)).select(left.columns)
    assert Counter(left.collect()) == Counter(want.collect()) and left.where("filename is null").count() and left.where("text is null").count()
    assert Counter(findings.collect()) == Counter(star.findings(spark, SF).select(findings.columns).collect())


def test_mentions_of_odd_rows(spark, tmp_path):
    """A line number twice, items that differ in one flag, a null supplier, a null status, other priorities."""
    item = {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 5, "l_suppkey": 3, "l_quantity": 1.0, "l_extendedprice": 2.0, "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": "A", "l_linestatus": "O", "l_shipdate": "1997-01-01"}
    changes = [{}, {"l_returnflag": "N"}, {"l_suppkey": None}, {"l_extendedprice": 1.5, "l_returnflag": "R"}, {"l_shipdate": "1996-01-01"}, {"l_orderkey": 2}, {"l_orderkey": 3, "l_partkey": 14}, {"l_orderkey": 4}, {"l_partkey": 99}]
    order = lambda k, status, priority: (k, 1, status, 1.0, "1997-01-01", priority)
    cast = lambda df, c: df.withColumn(c, F.to_timestamp(c))
    cast(spark.createDataFrame([item | c for c in changes], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"), "l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    cast(spark.createDataFrame([order(1, "O", "1-URGENT"), order(2, "P", "4-NOT"), order(3, None, None)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"), "o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, "PROMO TIN"), (14, "SMALL TIN")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(3, "s")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    left, findings = star.mentions_by_tag(spark, str(tmp_path))
    assert Counter(left.collect()) == Counter(graph.evidence(**star.gone(spark, str(tmp_path))).select(left.columns).collect())
    supplied = lambda df: Counter(df.where("document_id <> 1 or chunk_index > 0").select(findings.columns).collect())
    assert supplied(findings) == supplied(star.findings(spark, str(tmp_path)))
    assert left.count() == 7 and [r.chunk_index for r in findings.where("text is null").collect()] == [0]  # without a supplier


def test_kinds_are_those_of_the_open_gaps(spark):
    """Equal texts count once, the newest chunk says how long it is overdue, and any text closes a gap."""
    said = [
        ("P-1", 1, 0, "1997-01-01", "P-1 calibration overdue by 5 days."), ("P-1", 2, 0, "1997-02-01", "P-1 calibration overdue by 45 days."), ("P-1", 3, 0, "1997-01-15", "P-1 calibration overdue by 5 days."),
        ("P-2", 1, 0, "1997-01-01", "P-2 calibration overdue by 5 days."), ("P-2", 2, 1, "1997-01-01", "P-2 calibration overdue by 45 days.\nP-2 calibration overdue by 4 days."), ("P-2", 2, 0, "1997-01-01", "P-2 calibration overdue by 3 days."),
        ("P-3", 1, 0, "1997-01-01", "P-3 seal failure."), ("P-3", 1, 1, "1997-01-01", "P-3 seal failure."), ("P-4", 1, 0, None, "P-4 seal failure."), ("P-4", 2, 0, None, "P-4 breakdown."),
        ("P-5", 1, 0, None, "P-5 seal failure."), ("P-5", 2, 0, None, "P-5 breakdown."), ("P-5", 3, 0, None, "root cause recorded."), ("P-6", 1, 0, None, None), ("P-7", None, None, None, "P-7 certificate expired."),
    ]
    e = spark.createDataFrame(said, "tag string, document_id long, chunk_index int, created_at string, text string")
    got = {tuple(r) for r in compliance.open_kinds(e).collect()}
    assert got == {("P-1", "calibration_overdue", "high"), ("P-2", "calibration_overdue", "medium"), ("P-4", "repeated_failure_no_rca", "medium"), ("P-7", "certificate_expired", "high")}
    assert got == {tuple(r) for r in compliance.open_gaps(e).select("tag", "gap_type", "severity").collect()}
    f = star.findings(spark, SF)
    assert Counter(compliance.open_kinds(f).collect()) == Counter(compliance.open_gaps(f).select("tag", "gap_type", "severity").collect())


def test_package_counts(spark):
    """A document counts once, and only with a file; equal beginnings in a chunk are one finding, the newest by date."""
    rows = [(i, "P-1", "inspection", f"p{i:02}", f"1997-01-{i:02}", 1, "f", i) for i in range(1, 15)] + [(20, "P-1", "procedure", "q", "1997-01-01", 2, None, 0), (21, "P-1", "procedure", "q", "1997-01-02", 2, None, 0), (22, "P-1", "evidence_mention", None, None, 3, "g", None), (23, "P-1", "inspection", None, None, None, "h", None), (24, "P-2", "failure", "x", None, 1, "f", 0)]
    events = spark.createDataFrame(rows, "mention_id long, tag string, event_type string, preview string, date string, document_id long, filename string, chunk_index int")
    gaps = spark.createDataFrame([("P-1", "inspection_overdue", "high"), ("P-1", "sop_review_overdue", "medium"), ("P-3", "x", "high")], "tag string, gap_type string, severity string")
    got = {r.tag: r for r in causes.packages(events, gaps).collect()}
    p = got["P-1"]
    assert got.keys() == {"P-1", "P-2"} and (p.mentions, p.documents, p.gaps, p.high_gaps) == (18, 2, 2, 1)
    assert p.inspection == [f"p{i:02}" for i in range(14, 2, -1)] and p.maintenance == ["q"] and p.missing == [causes.MISSING[0][1]]
    assert (got["P-2"].documents, got["P-2"].gaps, got["P-2"].inspection, got["P-2"].maintenance) == (1, 0, ["x"], []) and got["P-2"].missing == [causes.NO_MAINTENANCE]
