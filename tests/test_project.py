"""Folders of files kept as a corpus: cold, unchanged and edited refreshes, identities, dates, skips."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.operators import search
from corvane.plans.engine import ProjectConfig
from corvane.plans.project import Project
from corvane.sources import convert

MAIL = (
    b"Microsoft Mail Internet Headers Version 2.0\r\nFrom: =?utf-8?q?Ada_L=C3=B6we?= <a@x.invalid>\r\nTo: B\r\nSubject: Gate\r\nReceived: from x; Tue, 11 May 2004 01:00:00 +0000\r\n"
    b"Received: from y; Mon, 10 May 2004 22:53:33 -0500\r\n%s\r\nThe gate is shut.\r\n\r\n> old words\r\nIt stays shut.\r\n\r\n-----Original Message-----\r\nFrom: B\r\nolder words\r\n"
)


def test_mails_keep_their_own_text_and_date():
    ps, title, meta, reason = convert.convert_one("eml@2", MAIL % b"Date: Mon, 10 May 2004 23:53:33 -0500\r\n")
    assert ps == ["From: Ada Löwe <a@x.invalid>\nTo: B\nDate: Mon, 10 May 2004 23:53:33 -0500\nSubject: Gate", "The gate is shut.", "It stays shut."]
    assert title == "Gate" and reason is None and meta == {"date_iso": "2004-05-10", "date_confidence": "exact", "date_text": "Mon, 10 May 2004 23:53:33 -0500"}
    meta = convert.convert_one("eml@2", MAIL % b"Date: soon\r\n")[2]  # the earlier moment, by the clock of its own zone
    assert meta["date_iso"] == "2004-05-11" and meta["date_confidence"] == "inferred" and meta["date_text"] == "Received Tue, 11 May 2004 01:00:00 +0000"
    assert convert.own_text("a\n*****\nEDRM Enron Email Data Set has been produced by\nx\n*****\nb\nFrom: me\nnot sent\n>q") == "a\n\nb\nFrom: me\nnot sent"
    assert convert.own_text("a\nFrom: me\nSent: now\nb") == "a" and convert.own_text("") == ""
    ps, title, *_ = convert.convert_one("eml@2", b"From: x\r\n\r\nFirst words here. More.\r\n")
    assert title == "First words here." and ps[0] == "From: x\nTo: \nSubject: "


def test_properties_of_documents():
    pdf = lambda maker, body: b"/Creator (%s) /CreationDate (D:20040510120000Z) stream\n%s\nendstream" % (maker, body)
    assert convert.pdf_created(pdf(b"Writer", zlib.compress(b"BT (x) Tj ET"))) == {"created_iso": "2004-05-10", "created_text": "pdf CreationDate 2004-05-10"}
    assert convert.pdf_created(pdf(b"ScanWorks", zlib.compress(b"BT (x) Tj ET"))) == {} and convert.pdf_created(pdf(b"Writer", b"image")) == {}
    b = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Before.</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:d="http://purl.org/dc/terms/"><d:created>2013-11-04T21:15:03Z</d:created></c>')
    ps, title, meta, _ = convert.convert_one("docx@1", b.getvalue())
    assert ps == ["Before.", "Head"] and title == "Head" and meta == {"created_iso": "2013-11-04", "created_text": "docx created 2013-11-04"}


def test_a_project_follows_its_files(spark, tmp_path):
    src, notes, script = tmp_path / "src", tmp_path / "notes", tmp_path / "script"
    for d in (src / "2003/June", notes / "person", script):
        d.mkdir(parents=True)
    (src / "a.txt").write_text("May 3, 2001\n\nThe lock is shut.\n\nThe end.")
    (src / "2003/June/b.md").write_text("# Tolls\n\nNo day here.")
    (src / "c.eml").write_bytes(MAIL % b"Date: Mon, 10 May 2004 23:53:33 -0500\r\n")
    (src / "copy.txt").write_bytes((src / "a.txt").read_bytes())
    (src / "bin.txt").write_bytes(b"\0\1\2")
    (src / "x.xls").write_bytes(b"x")
    (src / ".hidden.txt").write_text("h")
    (notes / "person/ada.md").write_text("---\naliases: [Ada]\n---\n# Ada Lock\n\nSee SRC-000002 p1.")
    (script / "ch.md").write_text("# One\n\ntext\n\n## Two\n\nmore")
    p = Project(spark, f"file://{tmp_path}/store", [str(src), str(src)], str(notes), str(script), embed=lambda ts: [search.hashing_embedder(t) for t in ts])
    got = p.refresh()
    assert (got.revision, got.changed, got.skipped) == (4, 4, 2)
    r = {x["ref"]: x for x in p.corpus.table("records").collect()}
    assert set(r) == {f"SRC-00000{k}" for k in (1, 2, 3, 4)} | {"notes/person/ada.md", "manuscript/ch.md", "manuscript/ch.md # One", "manuscript/ch.md # Two"}
    assert [(x["path_key"], x["reason"]) for x in p.skips().orderBy("path_key").collect()] == [("001/bin.txt", "binary content"), ("001/x.xls", "no converter for its suffix")]
    day = {ref: (x["record_date"]["iso"], x["record_date"]["confidence"], x["record_date"]["granularity"]) for ref, x in r.items()}
    ids = {x["path_key"]: x["id"] for x in p.corpus.table("units").collect()}
    assert ids == {"001/2003/June/b.md": "SRC-000001", "001/a.txt": "SRC-000002", "001/c.eml": "SRC-000003", "001/copy.txt": "SRC-000004"}
    assert day["SRC-000001"] == ("2003-06-01", "inferred", "month") and day["SRC-000002"] == ("2001-05-03", "exact", "day") and day["SRC-000003"] == ("2004-05-10", "exact", "day")
    assert day["notes/person/ada.md"][1] == "unknown" and r["SRC-000001"]["title"] == "Tolls"
    assert p.refresh() == p.report()  # nothing changed: the same snapshot
    # an edit, a new file, a vanished one
    (src / "a.txt").write_text("May 3, 2001\n\nThe lock is open.\n\nThe end.")
    (src / "aa.txt").write_text("new")
    (src / "copy.txt").unlink()
    (notes / "person/ada.md").write_text("# Ada Lock")
    got = p.refresh()
    assert (got.revision, got.changed) == (7, 3)
    ids = {x["path_key"]: (x["id"], x["deleted"]) for x in p.corpus.table("units").collect()}
    assert ids["001/aa.txt"] == ("SRC-000005", False) and ids["001/copy.txt"] == ("SRC-000004", True)
    assert p.corpus.read("SRC-000002 p4")[0] == "The lock is open." and "The lock is shut." in p.corpus.read("SRC-000002 p2")[0]
    assert {x["unit_id"]: x["line"] for x in p.drift().collect()}["SRC-000002"] == "SRC-000002: 2 kept, 1 retired, 1 added"
    # the path comes back: its old number again; what was converted before is not converted again
    (src / "copy.txt").write_text("May 3, 2001\n\nThe lock is shut.\n\nThe end.")
    before = p._cache().count()
    assert p.refresh().revision == 8 and p._cache().count() == before
    assert p.corpus.read("SRC-000004")[0].startswith("May 3") and "SRC-000004" in {h["citation"][:10] for h in p.corpus.search("lock shut", kind="source", config=ProjectConfig()).hits}
    n = p.corpus.table("vectors")
    assert n.count() == p.corpus.table("paragraphs").count() and n.where(F.size("embedding") != 96).count() == 0
    with pytest.raises(OSError):
        Project(spark, f"file://{tmp_path}/store", [str(tmp_path / "none")]).refresh()
    assert p.report().revision == 8


def test_an_empty_project(spark, tmp_path):
    (tmp_path / "src").mkdir()
    p = Project(spark, f"file://{tmp_path}/store", [str(tmp_path / "src")])
    assert p.refresh().records == 0 and p.corpus.search().header["records"] == 0
    (tmp_path / "src/a ü%20b.txt").write_text("one")
    assert p.refresh().records == 1
    again = Project(spark, f"file://{tmp_path}/store", [f"file://{tmp_path}/src/", f"{tmp_path}/src"])
    assert again.refresh() == p.report() and len(again.sources) == 1
    assert [x["rel_path"] for x in again._files({again.sources[0]: 1}).collect()] == ["a ü%20b.txt"]


def test_embedders_are_checked(spark):
    p = spark.createDataFrame([("a", 0, "x"), ("b", 0, "x"), ("b", 1, "y")], "ref string, idx int, text string")
    known = spark.createDataFrame([], "text_hash string, embedding array<float>")
    assert search.embedded(p, known, lambda t: [[1.0, 2.0] for _ in t]).count() == 3
    with pytest.raises(Exception, match="one vector of one length"):
        search.embedded(p, None, lambda t: [[1.0]] * (len(t) + 1)).collect()
