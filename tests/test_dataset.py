"""A folder through the whole ingest, twice, and after changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.sources import dataset, snapshots

SOP = "# SOP-1 Startup\nCheck P-101 and HX-2.\n- open valve V-3\n\nSCOPE:\nAll pumps."


def tables(spark, root):
    s = snapshots.Snapshot.latest(spark, root)
    return {"chunks": snapshots.current(s, "chunks", dataset.CHUNK), "elements": snapshots.current(s, "elements", dataset.ELEMENT), "mentions": snapshots.current(s, "mentions", "path string, digest string, chunk_id string, tag string, asset_type string")}


def test_ingest(spark, tmp_path):
    src, root = tmp_path / "in", f"{tmp_path}/out"
    src.mkdir()
    (src / "sop.md").write_text(SOP)
    (src / "orders.csv").write_text('Equipment;Note\nP-101;"seal\nleak"\n;\nTK-9;ok!\n')
    (src / "blank.txt").write_text(" \n\n")
    (src / "photo.xyz").write_bytes(b"\x00\xff")
    (src / "odd.txt").write_bytes(b"caf\xe9 P-7")
    counts = dataset.ingest(spark, str(src), root)
    assert len(counts) == 1
    c = counts[0]
    assert (c["documents.rows"], c["documents.skipped"], c["manifest.rows"]) == (5, 2, 5)
    t = tables(spark, root)
    assert c["elements.rows"] == c["documents.elements"] == t["elements"].count() and c["chunks.rows"] == c["chunks.passthrough"] == t["chunks"].count() == c["embeddings.rows"]
    assert c["mentions.rows"] == t["mentions"].count() and c["mentions.known"] == t["mentions"].where("asset_type is not null").count()
    got = {(r.file_name, r.chunk_index): r for r in t["chunks"].collect()}
    assert got["orders.csv", 0].text == "Row 1: 'Equipment': P-101. 'Note': seal\nleak." and got["orders.csv", 1].text == "Row 3: 'Equipment': TK-9. 'Note': ok!"
    assert got["sop.md", 0].section_title == "SOP-1 Startup" and got["sop.md", 0].asset_tags == ["HX-2", "P-101", "SOP-1", "V-3"] and got["sop.md", 1].text == "SCOPE\nAll pumps."
    assert got["odd.txt", 0].text == "caf\ufffd P-7" and {r.tag for r in t["mentions"].where(F.col("path").endswith("odd.txt")).collect()} == {"P-7"}
    assert got["sop.md", 0].summary.startswith("sop.md section SOP-1 Startup. Asset tags: HX-2, P-101, SOP-1, V-3. Parent evidence summary input: SOP-1 Startup\nCheck")
    assert dataset.ingest(spark, str(src), root) == []
    (src / "orders.csv").write_text("Equipment;Note\nP-102;replaced\n")
    assert dataset.ingest(spark, str(src), root)[0]["chunks.rows"] == 1
    texts = [r.text for r in tables(spark, root)["chunks"].where("source_type = 'csv'").collect()]
    assert texts == ["Row 1: 'Equipment': P-102. 'Note': replaced."]
