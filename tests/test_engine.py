"""Converters, notes, manuscripts, ledger, plans, pages, engine and stream, on invented content."""

import io
import json
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from corvane.functions import dates, refs
from corvane.functions import text as T
from corvane.operators import ledger, plan, read, records, search
from corvane.operators.validate import validate_records
from corvane.plans.engine import Corpus, ProjectConfig, decode_cursor
from corvane.sources import convert, notes
from corvane.streaming import refresh


def mail() -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = "Ada Löwe <a@x.invalid>", "B", "Tölle für Schleuse", "Mon, 10 May 2004 11:53:33 -0500"
    m.set_content("Hello,\n\nthe gate is shut.\n")
    m.add_attachment(b"x", maintype="application", subtype="octet-stream", filename="x.bin")
    return m.as_bytes()


def docx() -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two.</w:t></w:r></w:p><w:p/></w:body></w:document>')
    return b.getvalue()


def test_converters(spark):
    ps, title, meta, reason = convert.convert_one("eml@2", mail())
    assert ps[0].startswith("From: Ada Löwe") and ps[1:] == ["Hello,", "the gate is shut."] and title == "Tölle für Schleuse" and reason is None
    assert convert.convert_one("docx@1", docx())[0] == ["One two."]
    assert convert.convert_one("docx@1", b"no zip")[3] == "unreadable docx"
    assert convert.convert_one("text@1", b"caf\xe9\n\nzwei")[0] == ["café", "zwei"]
    assert convert.convert_one("text@1", b"\0\1")[3] == "binary content" and convert.convert_one("text@1", b"")[3] == "empty"
    assert convert.convert_one(None, b"x")[3] == "no converter"
    index = __import__("base64").b64encode(bytes(range(27))).decode()
    assert convert.thread_metadata(index)["thread_parent_index"] == bytes(range(22)).hex()


def test_scan_converts_each_content_once(spark, tmp_path):
    (tmp_path / "a/cache").mkdir(parents=True)
    for name, raw in {"a/x.txt": b"same", "a/y.md": b"same", "b.eml": mail(), ".hidden.txt": b"h", "a/cache/z.txt": b"c", "n.bin": b"b"}.items():
        (tmp_path / name).write_bytes(raw)
    files = convert.scan_files(spark, str(tmp_path))
    done = {r["path_key"]: r for r in convert.convert_files(files).collect()}
    assert set(done) == {"001/a/x.txt", "001/a/y.md", "001/b.eml"}
    cache = convert.convert_files(files).drop("path_key").dropDuplicates(["sha256", "converter"])
    assert convert.convert_files(files, cache).count() == 3


NOTE = b"---\naliases: [Ada, 'A. L.']\nwindow:\n  from: 2001-01-01\n  to: 2001-06-30\ncorpus_revision: \"7\"\ncoverage_complete: true\nodd: 1\n---\n# Title\n\ntext SRC-000001 p2\n"


def test_notes_and_manuscripts(spark):
    d = notes.note_fields("digest/one.md", NOTE)
    assert d["note_window"] == ("2001-01-01", "2001-06-30") and d["aliases"] == ["Ada", "A. L."] and d["coverage_complete"] is True and d["corpus_revision"] == "7"
    assert d["warnings"] == ["notes/digest/one.md: unknown field odd; ignored"] and d["title"] == "Title"
    p = notes.note_fields("person/two.md", NOTE)
    assert p["corpus_revision"] is None and len(p["warnings"]) == 3
    bad = notes.note_fields("x.md", b"---\naliases: 3\nwindow: {from: 2002-01-01, to: 2001-01-01}\n---\nbody")
    assert bad["aliases"] == [] and bad["note_window"] is None and len(bad["warnings"]) == 2 and bad["title"] == "x"
    f = spark.createDataFrame([("digest/one.md", bytearray(NOTE)), ("raw.txt", bytearray(b"x"))], "rel_path string, content binary")
    assert notes.read_notes(f).first()["note_window"]["day_to"] == "2001-06-30"
    m = spark.createDataFrame([("ch1.md", bytearray(b"# A\n\none\n\n## B\n\ntwo\n\n### C\n\nthree\n\n## B\n\nfour"))], "rel_path string, content binary")
    got = {r["ref"]: r["paragraphs"] for r in notes.read_manuscripts(m).collect()}
    assert got["manuscript/ch1.md # B"] == ["## B", "two", "### C", "three"] and got["manuscript/ch1.md # B (2)"] == ["## B", "four"] and len(got) == 4


def test_alignment_pairs_repeats_in_order(spark):
    old = spark.createDataFrame([("u", k + 1, t, k) for k, t in enumerate(["keep", "edit", "twice", "twice", "gone", "moved", "café"])], "unit_id string, p int, text string, pos int")
    new = spark.createDataFrame([("u", k, t) for k, t in enumerate(["moved", "keep", "edit!", "twice", "added", "twice", "cafe" + chr(0x301)])], "unit_id string, idx int, text string")
    got = {(r["idx"], r["change"]): r["p"] for r in ledger.align(old, new).collect()}
    assert [got[k, c] for k, c in enumerate(["kept", "kept", "added", "kept", "added", "kept", "added"])] == [6, 1, 8, 3, 9, 4, 10]
    assert ledger.drift(ledger.align(old, new)).first()["line"] == "u: 4 kept, 3 retired, 3 added"
    assert ledger.align(old.limit(0), new).where("change = 'added'").count() == 7


def test_registration_never_reuses_numbers(spark):
    known = spark.createDataFrame([("001/b", "SRC-000007")], "path_key string, id string")
    got = {r["path_key"]: r["id"] for r in ledger.register(known, spark.createDataFrame([("001/c",), ("001/a",), ("001/b",), (None,), ("001/c",)], "path_key string")).collect()}
    assert got == {"001/a": "SRC-000008", "001/c": "SRC-000009"}


def plan_rows(spark, rows):
    return spark.createDataFrame([(False, d, r, t) if d else (True, "", r, t) for d, r, t in rows], "unknown boolean, iso string, ref string, tokens bigint")


def test_chunk_plan(spark):
    rows = [("2001-01-01", "a", 40), ("2001-01-01", "b", 40), ("2001-01-02", "c", 30), ("2001-01-03", "d", 250), ("2001-01-03", "e", 10), ("2001-01-04", "f", 60), ("2001-01-04", "g", 60), (None, "h", 5)]
    got = [tuple(r) for r in plan.chunk_plan(plan_rows(spark, rows), 100).orderBy("chunk", "ref", "segment").collect()]
    assert got == [
        (0, "a", 1, 1, 40), (0, "b", 1, 1, 40), (1, "c", 1, 1, 30), (2, "d", 1, 3, 100), (3, "d", 2, 3, 100), (4, "d", 3, 3, 50), (5, "e", 1, 1, 10), (6, "f", 1, 1, 60), (7, "g", 1, 1, 60), (7, "h", 1, 1, 5),
    ]
    assert plan.chunk_plan(plan_rows(spark, []), 100).count() == 0


@pytest.mark.parametrize("budget", [60, 200, 10_000])
def test_pages_join_to_the_text(budget):
    units = [("SRC-000001 p1", "short"), ("SRC-000001 p2", "ä́" * 120 + "\r\n" * 30), ("SRC-000001 p3", "")]
    pages = read.paginate(units, budget)
    assert "".join(t + s for p in pages for _, t, s in p) == "\n\n".join(t for _, t in units)
    assert all(sum(len(n.encode()) + 1 + len(t.encode()) + len(s) for n, t, s in p) <= budget for p in pages)


def test_refs():
    for text in ("SRC-000001", "SRC-000001 p3", "SRC-000001 p3-9", "SRC-1234567 p3-", "notes/a/b.md", "manuscript/x.md # Head (2)"):
        assert refs.parse(text).render() == text
    for text in ("/abs.md", "../up.md", "a\\b.md", "C:/x.md", "", "SRC-1", "x.txt"):
        with pytest.raises(ValueError):
            refs.parse(text)


def test_queries_and_tokens(spark):
    assert T.query_phrases('a "b-c d" e"f g') == [["a"], ["b", "c", "d"], ["e"], ["f", "g"]]
    assert T.query_phrases('  "" ') == [] and T.query_phrases("(") == [[]]
    docs = spark.createDataFrame([(1, "Café e-mail, e mail"), (2, None), (3, ""), (4, "x x x")], "doc_id int, text string")
    assert [r[0] for r in search.matches(docs, ["doc_id"], T.query_phrases("cafe e-mail")).collect()] == [1]
    assert search.matches(docs, ["doc_id"], [["x", "x"]]).first()["tf0"] == 2
    assert search.matches(docs, ["doc_id"], [[], ["x"]]).count() == 0 and search.bm25(docs, ["doc_id"], [[]]).count() == 0
    assert search.any_phrase(docs, ["doc_id"], [[], ["x"]]).count() == 1


def test_date_specs_and_shapes(spark):
    assert dates.spec_bounds("2004-02") == ("2004-02-01", "2004-02-29")
    for bad in ("04", "2004-13", "2004-1-1", ""):
        with pytest.raises(ValueError):
            dates.spec_bounds(bad)
    rows = ["at 3 May 2001", "May 3rd, 01", "31/12/1999", "5/6/1999", "Sept 2001", "30 Feb 2001", "", None, "12345-01-02"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = {r["k"]: (r["s"]["shape"], r["s"]["iso"]) if r["s"] else None for r in df.select("k", dates.date_shape(F.col("t")).alias("s")).collect()}
    assert [got[k] for k in range(len(rows))] == [("month_name", "2001-05-03"), ("month_name", "2001-05-03"), ("numeric", "1999-12-31"), ("ambiguous", "1999-01-01"), ("month_year", "2001-09-01"), ("month_year", "2001-02-01"), None, None, None]


RAW = (
    "ref string, kind string, note_type string, record_date struct<iso:string,confidence:string,granularity:string,text:string>, title string, paragraphs array<string>, aliases array<string>, "
    "note_window struct<day_from:string,day_to:string>, corpus_revision string, coverage_complete boolean, warnings array<string>, ingested_at timestamp_ntz"
)


def raw(spark):
    import datetime as dt

    now = dt.datetime(2013, 1, 1)
    rows = [(f"SRC-{k:06d}", "source", None, (f"2001-01-{k % 28 + 1:02d}", "exact", "day", ""), f"Record {k}", [f"The lock number {k} is shut.", "Ada wrote it." if k % 3 else "Nobody did."], [], None, None, None, [], now) for k in range(1, 61)]
    rows += [rows[0][:-1] + (dt.datetime(2014, 1, 1),), ("SRC-000900", "source", None, None, "Odd", None, None, None, None, None, None, None)]
    rows += [("notes/person/ada.md", "note", "person", ("", "unknown", "day", ""), "Ada Lock", ["# Ada"], ["Ada"], None, None, None, [], now)]
    rows += [("notes/digest/d.md", "note", "digest", ("", "unknown", "day", ""), "D", ["# D"], [], ("2001-01-02", "2001-01-05"), "7", True, [], now)]
    return spark.createDataFrame(rows, RAW)


def test_validation(spark):
    good, bad = validate_records(raw(spark))
    assert bad.count() == 0
    odd = raw(spark).limit(1).withColumn("title", F.lit(" ")).withColumn("coverage_complete", F.lit(True))
    assert set(validate_records(odd)[1].first()["reasons"]) == {"no title", "note field"}


def test_search_and_read_over_a_snapshot(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/corpus")
    with pytest.raises((LookupError, Exception)):
        c.current()
    c.commit(raw(spark), revision="7")
    all_of = c.search()
    assert all_of.header["records"] == 63 and len(all_of.hits) == 63 and all_of.continuation is None
    assert c.search("lock shut", kind="source").header["lexical_records"] == 60
    assert c.search(who="ada", kind="source").header["records"] == 40
    ranged = c.search("lock", from_="2001-01-02", to="2001-01-10")
    assert [x["ref"] for x in ranged.covered] == ["notes/digest/d.md"]
    small = ProjectConfig.from_dict({"reply_tokens": 2000})
    seen, reply = [], c.search(config=small)
    while True:
        seen += [h["citation"] for h in reply.hits]
        assert reply.tokens() <= 2000
        if not reply.continuation:
            break
        reply = c.search(cursor=reply.continuation, config=small)
    assert len(seen) == len(set(seen)) == 63
    with pytest.raises(ValueError):
        c.search("x", cursor=all_of.continuation or "e30")
    text, pages = c.read("SRC-000003")
    assert text == "The lock number 3 is shut.\n\nNobody did." and pages == 1
    assert c.read("SRC-000003 p2-")[0] == "Nobody did."
    with pytest.raises(LookupError):
        c.read("SRC-009999")
    with pytest.raises(ValueError):
        decode_cursor("%%%")
    with pytest.raises(ValueError):
        ProjectConfig.from_dict({"odd": 1})


def test_citations_keep_naming_their_text_across_versions(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/corpus")
    note = ("notes/person/ada.md", "note", "person", ("", "unknown", "day", ""), "Ada", ["# Ada", "gate"], [], None, None, None, [], None)

    def commit(*paragraphs):
        row = ("SRC-000001", "source", None, ("2001-01-01", "exact", "day", ""), "R", list(paragraphs), [], None, None, None, [], None)
        c.commit(spark.createDataFrame([row, note] if paragraphs else [note], RAW))

    commit("one", "two gate", "three", "last")
    assert {h["citation"] for h in c.search("gate").hits} == {"SRC-000001 p2", "notes/person/ada.md"}
    commit("new", "two gate", "three", "one")
    assert c.read("SRC-000001 p2")[0] == "two gate" and c.read("SRC-000001 p1")[0] == "one" and c.read("SRC-000001 p5")[0] == "new"
    assert c.search("gate", kind="source").hits[0]["citation"] == "SRC-000001 p2"
    assert c.read("SRC-000001 p5-3")[0] == "new\n\ntwo gate\n\nthree" and c.read("SRC-000001 p3-")[0] == "three\n\none"
    assert c.read("SRC-000001 p4")[0].split("\n")[1] == "last" and " retired " in c.read("SRC-000001 p4")[0]
    for bad in ("SRC-000001 p2-4", "SRC-000001 p4-", "SRC-000001 p6"):
        with pytest.raises(LookupError):
            c.read(bad)
    with pytest.raises(ValueError):
        c.read("SRC-000001 p1-2")
    commit()
    with pytest.raises(LookupError):
        c.read("SRC-000001")
    commit("last", "one")
    assert [c.read(f"SRC-000001 p{k}")[0].split("\n")[-2:][0] for k in (6, 7)] == ["last", "one"]
    assert c.read("SRC-000001 p4")[0].split("\n")[1] == "last" and c.read("SRC-000001 p2")[0].split("\n")[1] == "two gate"


def test_reads_continue_by_cursor_and_warn(spark, tmp_path):
    c = Corpus(spark, f"file://{tmp_path}/corpus")
    long = ["word " * 900, "ä" * 4000, "end"]
    rows = [("SRC-000001", "source", None, ("2001-01-01", "exact", "day", ""), "R", long, [], None, None, None, [], None)]
    note = "See SRC-000001 p2, SRC-000001 p9, SRC-000007 and SRC-000001 p1-3."
    rows.append(("notes/x.md", "note", None, ("", "unknown", "day", ""), "N", [note], [], None, None, None, ["notes/x.md: odd"] * 300, None))
    c.commit(spark.createDataFrame(rows, RAW))
    small, got, reply = ProjectConfig(reply_tokens=2000), [], None
    while reply is None or reply.continuation:
        reply = c.read_reply(cursor=reply.continuation, config=small) if reply else c.read_reply("SRC-000001", config=small)
        assert len(reply.text().encode()) <= 8000
        got.append(reply.payload())
    assert "".join(got) == "\n\n".join(long) and len(got) > 1
    told, texts, reply = [], [], None
    while reply is None or reply.continuation:
        reply = c.read_reply(cursor=reply.continuation, config=small) if reply else c.read_reply("notes/x.md", config=small)
        told += reply.warnings
        texts.append(reply.payload())
    assert told == ["notes/x.md: odd"] * 300 + ["SRC-000001 p9: SRC-000001 never had p9", "SRC-000007: no such record"] and "".join(texts) == note
    first = c.read_reply("SRC-000001", config=small).continuation
    c.commit(spark.createDataFrame(rows[:1], RAW))
    for bad in ({}, {"ref": "a.md", "cursor": first}, {"cursor": first}, {"cursor": c.search().continuation or "e30"}):
        with pytest.raises(ValueError):
            c.read_reply(**bad)
    with pytest.raises(LookupError):
        c.read_reply("notes/x.md")


def test_every_list_of_a_search_is_paged_to_its_end(spark, tmp_path):
    import datetime as dt

    now = dt.datetime(2013, 1, 1)
    rows = [(f"SRC-{k:06d}", "source", None, (f"{1900 + k // 12}-{k % 12 + 1:02d}-15", "exact", "day", ""), f"R{k}", ["gate " * 8], [], None, None, None, [], now) for k in range(520)]
    rows += [(f"notes/digest/{k:03d}.md", "note", "digest", ("", "unknown", "day", ""), "D", ["# D"], [], ("1800-01-01", f"1800-01-{k % 28 + 1:02d}"), "7", True, [], now) for k in range(510)]
    c = Corpus(spark, f"file://{tmp_path}/corpus")
    c.commit(spark.createDataFrame(rows, RAW), revision="7")
    config = ProjectConfig(chunk_tokens=10, reply_tokens=8000)
    got, cursor = {k: [] for k in ("citation", "month", "ref", "chunk")}, None
    for _ in range(40):
        reply = c.search(cursor=cursor, config=config) if cursor else c.search("gate", from_="1800", to="2000", config=config)
        assert reply.tokens() <= 8000
        for key, part in zip(got, (reply.hits, reply.months, reply.covered, reply.chunks)):
            got[key] += [x[key] for x in part]
        cursor = reply.continuation
        if not cursor:
            break
    assert cursor is None and len(set(got["citation"])) == len(got["citation"]) == 520
    assert got["month"] == sorted({f"{1900 + k // 12}-{k % 12 + 1:02d}" for k in range(520)})
    assert len(set(got["ref"])) == len(got["ref"]) == 510 and got["chunk"] == list(range(520))


def test_records_and_plans_of_empty_tables(spark):
    r = records.records_of(raw(spark).limit(0))
    assert r.count() == 0 and records.by_month(r).count() == 0 and plan.plan_candidates(r, plan.coverage(r, "7", "2001", None)).count() == 0


def test_stream_of_files(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_bytes(b"one")
    (inbox / "b.txt").write_bytes(b"one")
    for _ in range(2):
        refresh.stream_conversions(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        (inbox / "c.eml").write_bytes(mail())
    got = refresh.conversions(spark, str(tmp_path / "out")).collect()
    assert {r["converter"] for r in got} == {"text@1", "eml@2"} and len(got) == 2
    assert json.dumps(sorted(r["paragraphs"][0][:4] for r in got)) == '["From", "one"]'
