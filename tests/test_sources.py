"""Readers over containers that the tests make, and streams."""

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from corpusloom.sources import files, office
from corpusloom.sources.html import html_text, visible_text
from corpusloom.streaming import ledgers


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("DOT", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DOCX = {"word__documentDOTxml": f"<w:document {W}><w:body><w:p><w:r><w:t>First</w:t><w:tab/><w:t>one.</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second.</w:t></w:r></w:p></w:body></w:document>"}


def test_docx():
    assert office.docx_text(package(**DOCX)) == "First\tone.\n\nSecond."


def test_xlsx():
    box = package(
        xl__workbookDOTxml=f'<workbook {S}><sheets><sheet name="Ledger" r:id="a"/></sheets></workbook>', xl___rels__workbookDOTxmlDOTrels='<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>',
        xl__sharedStringsDOTxml=f"<sst {S}><si><t>Item</t></si></sst>",
        xl__worksheets__sDOTxml=f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>1500.0</v></c><c r="C3" t="b"><v>1</v></c><c r="D4" t="e"><v>#DIV/0!</v></c></row></sheetData></worksheet>',
    )
    # zip names can't be keywords with a leading underscore, so the relationships' name is put right here
    src, out = zipfile.ZipFile(io.BytesIO(box)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in src.namelist():
            z.writestr("xl/_rels/workbook.xml.rels" if "rels" in n else n, src.read(n))
    assert office.xlsx_cells(out.getvalue()) == [("Ledger", 1, 1, "Item"), ("Ledger", 2, 28, "1500"), ("Ledger", 3, 3, "TRUE"), ("Ledger", 4, 4, "#DIV/0!")]


def test_mail_prefers_plain_text():
    raw = b'From: a@b\nTo: c@d\nSubject: Pipes | more\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="x"\n\n--x\nContent-Type: text/html\n\n<p>Hi</p>\n--x\nContent-Type: text/plain\n\nHello\n--x--\n'
    assert "Pipes \\| more" in office.mail_text(raw) and "Hello" in office.mail_text(raw)
    assert office.mail_parts(b"Subject: s\nContent-Type: text/html\n\n<p>Hi</p>")[1:3] == ("Hi", True)


def test_html_cases():
    assert visible_text("<head><style>x</style><title>t</title></head><p>First &amp; second</p><script>no</script><div>Third<br>Fourth</div>") == "First & second\n\nThird\nFourth"
    assert visible_text(None) is None and visible_text("") == ""


def test_bad_files_are_rows(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 4, 3)
    rows = [(1, package(**DOCX), "docx"), (2, b"junk", "docx"), (3, None, "docx"), (4, png, "image"), (5, b"", "nope"), (6, package(word__documentDOTxml="<!DOCTYPE a><a/>"), "docx")]
    got = {r.i: r.r for r in spark.createDataFrame(rows, "i int, content binary, kind string").select("i", office.read_text(F.col("content"), F.col("kind")).alias("r")).collect()}
    assert got[1].text == "First\tone.\n\nSecond." and got[4].text == "4 x 3"
    assert [got[i].code for i in (2, 3, 5, 6)] == ["not-a-package", "unsupported", "unsupported", "doctype"]


def test_mirror_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a: b\n---\nbody\n\n",)], "body string").withColumn("header", F.create_map(F.lit("mirror_of"), F.lit("x.txt"), F.lit("byte_size"), F.lit("3")))
    files.write_mirrors(df.select(files.render(F.col("header"), F.col("body")).alias("text")), str(tmp_path / "m"))
    got = files.read_mirrors(spark, str(tmp_path / "m")).select(files.parse(F.col("text")).alias("p")).first().p
    assert got.header["mirror_of"] == "x.txt" and got.body == "a: b\n---\nbody\n" and "missing:content_hash" in got.problems


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x")
    df = files.scan(spark, str(tmp_path)).select("path", "length")
    assert df.first().length == 1 and "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_streams(spark, tmp_path):
    rows = [{"park_id": "p", "event": "open", "at": "2024-01-01T00:00:00Z", "value": 1.0}, {"park_id": "p", "event": "close", "at": "2024-01-01T01:00:00Z", "value": 2.0}, {"park_id": "q", "event": "open", "at": "2024-01-01T02:00:00Z", "value": 4.0}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = ledgers.events(spark, str(tmp_path / "in"), "park_id string, event string, at timestamp, value double")
    ledgers.append(ledgers.parks(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.park_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["p"]
    ledgers.append(ledgers.first_seen(stream, "park_id", "at"), str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 2


def test_fields_of_binary_word_text():
    assert office.word97_plain("Memo\rA\x07B\x07n \x13 REF \x13x\x14y\x15 \x14 42\x15 due\r") == "Memo\nA\tB\tn  42 due\n"
    for bad in ("\x13a", "\x15", "a\x14b", "\x13a\x14b\x14c\x15"):
        try:
            office.word97_plain(bad)
        except office.Refused:
            continue
        raise AssertionError(bad)


def test_html_columns_are_the_plain_reader(spark):
    cases = [
        None, "", "plain", "<p>a&amp;b &copy &#x41; &#150;&nbsp;&notin; &bogus; & &#0; &#1114112;</p>", "<head>x</head><body>y<br/>z</BODY>", "<script>if (a<b) { }</script>text", "<style>never ended", "a <!-- <p>gone</p> --> b",
        '<a title="x > y">in</a> <img alt=\'>\'> out', "<title>t</title>q<h2>r</h2>s", "<ul><li>1<li>2</ul>\n\n\n\n<p>\t 3  4 </p>", "1 < 2 and 3 > 2", "<pre>no block</pre><precious>x</precious>", "é&eacute;&ampere;&amp", "<!DOCTYPE html><p>d</p>",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, html string")
    got = {r.i: r.t for r in df.select("i", html_text(F.col("html")).alias("t")).collect()}
    assert got == {i: visible_text(x) for i, x in enumerate(cases)}
    assert got[3] == "a&b © A – ∉ &bogus; & � �" and got[6] == "" and got[7] == "a b" and got[8] == "in out" and got[9] == "q\nr\ns" and got[10] == "1\n2\n\n3 4"


def test_word_marks_boxes_and_fields():
    box = f"<w:document {W}><w:body><w:p><w:r><w:t>a</w:t><w:br/><w:t>b</w:t></w:r><w:p><w:r><w:t>box</w:t></w:r></w:p></w:p><w:p><w:r><w:t> </w:t></w:r></w:p></w:body></w:document>"
    assert list(office.docx_paragraphs(package(word__documentDOTxml=box))) == ["a\nbbox", "box", " "] and office.docx_text(package(word__documentDOTxml=box)) == "a\nbbox\n\nbox"
    assert office.word97_plain("A\x13 GO \x13 IN \x14x\x15\x14res\x13 q\x15ult\x15 b\x07c\r") == "Aresult b\tc\n"
    for bad in ("\x13 a", "a\x15", "a\x14b", "\x13a\x14b\x14c\x15"):
        try:
            office.word97_plain(bad)
        except office.Refused as fault:
            assert str(fault) == "unbalanced-field"
        else:
            raise AssertionError(bad)


def test_mail_layout():
    raw = b'From: a@b\nTo: c@d\nSubject: Pipes | more\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="x"\n\n--x\nContent-Type: text/plain\n\nHello\r\n--x\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="q|r.pdf"\n\n%PDF\n--x--\n'
    assert office.mail_text(raw) == "| Header | Value |\n|---|---|\n| From | a@b |\n| To | c@d |\n| Subject | Pipes \\| more |\n\nAttachments (not converted here): q\\|r.pdf\n\n## Body\n\nHello"
    assert office.mail_text(b"Subject: s\nContent-Type: text/html\n\n<p></p>").endswith("## Body\n\n[no text on this page]")


def test_limits_are_a_parameter_and_have_a_code(spark):
    df = spark.createDataFrame([(package(**DOCX),)], "content binary")
    got = [df.select(office.read_text(F.col("content"), F.lit("docx"), limits)["code"]).first()[0] for limits in (office.LIMITS, (10, 1 << 20), (1 << 20, 10))]
    assert got == [None, "too-large", "too-large"]


def compound(*names, storage="Pool"):
    """A compound file of one table sector and one directory sector, chained to a second one."""
    entry = lambda name, kind: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind)).ljust(128, b"\0")
    entries = [entry("Root Entry", 5), entry(storage, 1), *(entry(n, 2) for n in names)]
    entries += [b"\0" * 128] * (8 - len(entries))
    head = bytearray(512)
    head[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<H", head, 30, 9)
    struct.pack_into("<I", head, 48, 1)
    struct.pack_into("<II", head, 68, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)
    table = struct.pack("<128I", 0xFFFFFFFD, 2, 0xFFFFFFFE, *[0xFFFFFFFF] * 125)
    return bytes(head) + table + b"".join(entries)


def test_packages_and_compound_files_are_told_apart(spark):
    from corpusloom.operators import identify

    assert office.compound_streams(compound("WordDocument", "1Table", "a", "b", "Workbook")) == ["WordDocument", "1Table", "a", "b", "Workbook"]
    rows = [
        (1, package(**DOCX, **{"[Content_Types]DOTxml": "<a/>"})), (2, package(**DOCX)), (3, package(**{"[Content_Types]DOTxml": "<a/>", "xl__workbookDOTxml": "", "ppt__presentationDOTxml": ""})),
        (4, compound("Book")), (5, compound("Other")), (6, compound("Workbook", "WordDocument")), (7, b"PK\x03\x04junk"), (8, None), (9, b""), (10, compound("Book")[:700]), (11, b"From: a\nTo: b\nSubject: c\n\nx"),
    ]
    df = spark.createDataFrame(rows, "i int, content binary")
    kind = identify.sniffed(F.col("content"))["media_type"]
    got = {r.i: r.t for r in df.select("i", identify.refined(kind, F.col("content").cast("string"), office.member_names(F.col("content"))).alias("t")).collect()}
    short = lambda x: x.rpartition(".")[2]
    assert [short(got[i]) for i in (1, 3)] == ["document", "sheet"] and got[2] == got[7] == "application/zip"
    assert got[4] == "application/vnd.ms-excel" and got[5] == got[10] == "application/x-ole-storage" and got[6] == "application/msword" and got[11] == "message/rfc822"


def parts(**texts):
    """A package from exact part names."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in texts.items():
            z.writestr(name, text)
    return out.getvalue()


P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def text_shape(*lines):
    return "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:txBody></p:sp>"


def a_deck(**more):
    row = lambda *cells: "<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in cells) + "</a:tr>"
    first = f'<p:sld {P} show="0"><p:cSld><p:spTree>{text_shape("Title", "")}<p:grpSp>{text_shape("in group")}<p:grpSp>{text_shape("deeper")}</p:grpSp></p:grpSp><p:pic/><p:graphicFrame><a:graphic><a:graphicData><a:tbl>{row("a", "b")}{row("c", "")}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>{text_shape("last")}</p:spTree></p:cSld></p:sld>'
    files = {
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="300" r:id="r2"/><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships><Relationship Id="r1" Type="{REL}/slide" Target="slides/s1.xml"/><Relationship Id="r2" Type="{REL}/slide" Target="/ppt/slides/s2.xml"/></Relationships>',
        "ppt/slides/s1.xml": first,
        "ppt/slides/s2.xml": f"<p:sld {P}><p:cSld><p:spTree/></p:cSld></p:sld>",
        "ppt/slides/_rels/s1.xml.rels": f'<Relationships><Relationship Id="n" Type="{REL}/notesSlide" Target="../notes/n1.xml"/><Relationship Id="w" Type="{REL}/hyperlink" Target="https://x" TargetMode="External"/></Relationships>',
        "ppt/notes/n1.xml": f"<p:notes {P}><p:cSld><p:spTree>{text_shape('say this')}</p:spTree></p:cSld></p:notes>",
    }
    return parts(**(files | more))


def test_decks_with_groups_tables_notes_and_order(spark):
    slides = office.pptx_deck(a_deck())
    assert [(x["number"], x["slide_id"], x["part"], x["hidden"]) for x in slides] == [(1, 300, "ppt/slides/s2.xml", False), (2, 256, "ppt/slides/s1.xml", True)]
    assert slides[1]["text"] == "Title\nin group\ndeeper\na\tb\nc\t\nlast" and slides[1]["notes"] == "say this" and slides[1]["features"] == ["group", "picture", "table"]
    assert slides[0]["text"] == "" and slides[0]["notes"] is None
    for broken, code in (({"ppt/slides/_rels/s1.xml.rels": f'<Relationships><Relationship Id="n" Type="{REL}/notesSlide" Target="../notes/lost.xml"/></Relationships>'}, "missing-internal-target"), ({"ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="300" r:id="r9"/></p:sldIdLst></p:presentation>'}, "dangling-slide"), ({"ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="5" r:id="r1"/></p:sldIdLst></p:presentation>'}, "invalid-slide-id")):
        try:
            office.pptx_deck(a_deck(**broken))
        except office.Refused as fault:
            assert str(fault) == code
        else:
            raise AssertionError(code)
    df = spark.createDataFrame([(1, a_deck()), (2, b"junk"), (3, None), (4, b"")], "i int, content binary")
    got = {r.i: r.d for r in df.select("i", office.deck(F.col("content")).alias("d")).collect()}
    assert [x.text for x in got[1]] == [x["text"] for x in slides] and got[2] is got[3] is got[4] is None


def test_deck_to_mirror_and_back(spark):
    from corpusloom.operators import packages

    df = spark.createDataFrame([(7, a_deck())], "deck int, content binary").withColumn("s", F.explode(office.deck(F.col("content")))).select("deck", "s.*").withColumn("digest", F.lit("0" * 64)).withColumn("title", F.lit("T"))
    mapped = packages.slide_map(df.withColumn("notes_policy", F.lit("include")).withColumn("notes_included", F.lit(True)), "deck", "title")
    body = "# T" + "".join(r.section for r in mapped.orderBy("number").collect())
    for r in mapped.collect():
        assert body[r.content_start : r.content_end] == r.text and body[: r.end_].endswith("```")
    assert packages.slide_problems(mapped.withColumn("body", F.lit(body)), "deck", "body").count() == 0
    changed = body.replace("deeper", "deepest")
    assert packages.slide_problems(mapped.withColumn("body", F.lit(changed)), "deck", "body").where("problems LIKE '%framing%'").count() == 1


def test_sheets_with_dates_and_merges():
    styles = f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="&quot;day&quot; 0.0"/><numFmt numFmtId="165" formatCode="[h]:mm"/><numFmt numFmtId="166" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>'
    cells = '<c r="A1" s="1"><v>46024</v></c><c r="B1" s="1"><v>46056.25</v></c><c r="C1" s="2"><v>46024</v></c><c r="D1" s="3"><v>0.5</v></c><c r="E1" s="4"><v>59</v></c><c r="F1"><v>12.5</v></c><c r="G1" t="e"><v>#DIV/0!</v></c><c r="H1"/>'
    book = lambda extra="": parts(**{"xl/workbook.xml": f'<workbook {S}>{extra}<sheets><sheet name="L" r:id="a"/><sheet name="lost" r:id="b"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>', "xl/styles.xml": styles, "xl/worksheets/s.xml": f'<worksheet {S}><sheetData><row>{cells}</row></sheetData><mergeCells><mergeCell ref="A7:C7"/><mergeCell ref="B9"/></mergeCells></worksheet>'})
    assert [v for *_, v in office.xlsx_cells(book())] == ["2026-01-02T00:00:00", "2026-02-03T06:00:00", "46024", "12:00:00", "1900-02-28T00:00:00", "12.5", "#DIV/0!"]
    assert office.xlsx_cells(book('<workbookPr date1904="1"/>'))[0][3] == "2030-01-03T00:00:00"
    assert office.xlsx_merges(book()) == [("L", 7, 1, 7, 3), ("L", 9, 2, 9, 2)]
