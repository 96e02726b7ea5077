"""A folder of mixed tables, in ranges of any size, against the csv module over whole files."""

from __future__ import annotations

import csv
import io
import random

import pytest

from millwright.sources import delimited

R = random.Random(2)
CELLS = ["a b", "x,y", "q;r", 'say "no"', "two\nlines", "", "ä|ö", "5", "tab\there", "line one\n\nline three"]


def written(delimiter, header, n):
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    rows = ([["Equipment", "Reading", "Remark"]] if header else []) + [[f"P-{i}", str(i * 1.5), R.choice(CELLS)] for i in range(n)]
    w.writerows(rows)
    return out.getvalue().encode(), rows


@pytest.mark.parametrize("range_bytes", [64 << 20, 700, 97])
def test_mixed_folder(spark, tmp_path, range_bytes):
    want = {}
    (tmp_path / "sub").mkdir()
    for k, (name, delimiter, header) in enumerate([("a.csv", ",", True), ("sub/b.csv", ";", True), ("c.tsv", "\t", False), ("d.txt", "|", True)]):
        data, rows = written(delimiter, header, 150)
        (tmp_path / name).write_bytes((b"\xef\xbb\xbf" if k == 0 else b"") + data)
        want[name.rsplit("/")[-1]] = (rows[0] if header else None, sorted(rows[header:]))
    got = {}
    for r in delimited.read_delimited(spark, str(tmp_path), range_bytes=range_bytes).collect():
        got.setdefault(r.file_name, (r.columns, []))[1].append(list(r.cells))
    assert {k: (c, sorted(v)) for k, (c, v) in got.items()} == want


def test_no_line_end_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Tag,Note\n\nP-1,"open\nquote"\n,\nP-2,done')
    (tmp_path / "empty.csv").write_text("")
    got = delimited.labelled(delimited.read_delimited(spark, str(tmp_path), range_bytes=11)).select("text").collect()
    assert sorted(r.text for r in got) == ["'Tag': P-1. 'Note': open\nquote.", "'Tag': P-2. 'Note': done."]


def test_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("P-1,7.5,ok\nP-2,,\nP-3,8.0,Leak!\n")
    assert sorted(r.text for r in delimited.labelled(delimited.read_delimited(spark, str(tmp_path))).collect()) == ["P-1 | 7.5 | ok", "P-2", "P-3 | 8.0 | Leak!"]
    first = delimited.labelled(delimited.read_delimited(spark, str(tmp_path), header="first")).collect()
    assert sorted(r.text for r in first) == ["'P-1': P-2.", "'P-1': P-3. '7.5': 8.0. 'ok': Leak!"]


@pytest.mark.parametrize(("rows", "want"), [([["a", "b"], ["1", "2"]], True), ([["1", "b"], ["1", "2"]], False), ([["a", ""], ["x", "y"]], False), ([["P-1", "x"], ["P-1", "y"]], False), ([["name", "note"]], True), ([], False)])
def test_header(rows, want):
    assert delimited.has_header(rows) == want
