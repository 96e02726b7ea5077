"""Ingest that is killed, repeated and changed under way."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millwright.sources import snapshots

DOCS, LINES = "path string, digest string, chars long", "path string, digest string, line int, text string"


def extract(files):
    text = F.decode("content", "UTF-8")
    docs = files.select("path", "digest", F.length(text).cast("long").alias("chars"))
    return {"documents": docs, "lines": files.select("path", "digest", F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("int"))}


OBSERVED = {"documents": {"chars": "sum(chars)"}, "lines": {"blank": "count_if(text = '')"}}


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    for i in range(7):
        (d / ("sub" if i % 2 else ".") / f"f{i}.txt").write_text("\n".join(["line", "", f"of {i}"][: i % 4]))
    return d


def rows(spark, root, table, schema):
    s = snapshots.Snapshot.latest(spark, root)
    return sorted((os.path.basename(r.path), *tuple(r)[2:]) for r in snapshots.current(s, table, schema).collect())


def test_ingest_and_again(spark, folder, tmp_path):
    root = f"{tmp_path}/out"
    counts = snapshots.ingest(spark, str(folder), root, extract, OBSERVED, files_a_commit=3)
    assert [c["manifest.rows"] for c in counts] == [3, 2]  # f0 and f4 are empty
    lines = rows(spark, root, "lines", LINES)
    assert sum(c["lines.rows"] for c in counts) == len(lines) == sum(i % 4 for i in range(7))
    assert sum(c["lines.blank"] for c in counts) == sum(x[2] == "" for x in lines) and sum(c["documents.chars"] for c in counts) == sum(x[1] for x in rows(spark, root, "documents", DOCS))
    assert snapshots.ingest(spark, str(folder), root, extract, OBSERVED) == []


def test_kill_between_tables(spark, folder, tmp_path, monkeypatch):
    """Neither table shows a run that died after the first was written; the next run does it all, once."""
    root = f"{tmp_path}/out"
    snapshots.ingest(spark, str(folder), root, extract, files_a_commit=4)
    before = rows(spark, root, "lines", LINES)
    (folder / "new.txt").write_text("a\nb")

    def dying(files):
        tables = extract(files)
        return {"documents": tables["documents"], "lines": tables["lines"].withColumn("text", F.raise_error(F.lit("killed")).cast("string"))}

    with pytest.raises(Exception, match="killed"):
        snapshots.ingest(spark, str(folder), root, dying)
    assert len(os.listdir(f"{root}/data/documents")) == 3  # two commits' folders and that of the dead run
    assert rows(spark, root, "lines", LINES) == before and len(rows(spark, root, "documents", DOCS)) == 5
    assert snapshots.ingest(spark, str(folder), root, extract)[0]["documents.rows"] == 1
    assert rows(spark, root, "lines", LINES) == sorted([*before, ("new.txt", 0, "a"), ("new.txt", 1, "b")])


def test_changed_files(spark, folder, tmp_path):
    """New contents replace the old rows; a new time alone brings nothing; an old snapshot stays as it was."""
    root = f"{tmp_path}/out"
    snapshots.ingest(spark, str(folder), root, extract)
    old = snapshots.Snapshot.latest(spark, root)
    (folder / "f2.txt").write_text("other\ncontents\nnow")
    os.utime(folder / "f6.txt", (1, 1))
    counts = snapshots.ingest(spark, str(folder), root, extract)
    assert counts[0]["manifest.rows"] == 2 and counts[0]["documents.rows"] == 1
    lines = rows(spark, root, "lines", LINES)
    assert [x[1:] for x in lines if x[0] == "f2.txt"] == [(0, "other"), (1, "contents"), (2, "now")]
    assert len([r for r in snapshots.current(old, "lines", LINES).collect() if r.path.endswith("f2.txt")]) == 2
    assert snapshots.ingest(spark, str(folder), root, extract, force=True)[0]["documents.rows"] == 0
    s = snapshots.compacted(snapshots.Snapshot.latest(spark, root), {"documents": DOCS, "lines": LINES})
    assert len(s.folders["lines"]) == len(s.folders["manifest"]) == 1 and rows(spark, root, "lines", LINES) == lines
    assert snapshots.ingest(spark, str(folder), root, extract) == []


def test_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert snapshots.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", extract) == []
    s = snapshots.Snapshot.latest(spark, f"{tmp_path}/out")
    assert s.number == -1 and s.read("lines", LINES).count() == 0
