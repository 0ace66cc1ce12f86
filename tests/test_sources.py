"""Readers over literal bytes: text, CSV, JSON, mail, HTML and Office containers."""

import io
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from quireflow.sources import files, html, ooxml, text


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

DOCX = package({
    "word/document.xml": f"""<w:document {W}><w:body>
      <w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
      <w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> plain</w:t></w:r></w:p>
      <w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr>
        <w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
    </w:body></w:document>""",
    "docProps/core.xml": '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A title</dc:title></cp:coreProperties>',
    "word/media/image1.png": b"\x89PNG",
})
XLSX = package({
    "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="rId1" Type="{DOC}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si><si><t>x</t></si></sst>",
    "xl/worksheets/sheet1.xml": f"""<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row>
      <row r="5"><c r="A5"><f>B2+1</f></c></row></sheetData><mergeCells count="1"><mergeCell ref="A1:B1"/></mergeCells></worksheet>""",
})


def one(spark, content, name="content", kind="BINARY"):
    return spark.createDataFrame([(1, content)], f"doc_id LONG, {name} {kind}")


def test_routes(spark):
    rows = [("a.xlsx", XLSX), ("b.pdf", XLSX), ("c.docx", DOCX), ("d.txt", b"plain"), ("e.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("f.bin", b"%PDF-1.7"), ("g.png", b"PK\x03\x04 no zip"), ("h", None)]
    got = {r.path: (r.resolved, r.mismatch) for r in files.routed(spark.createDataFrame(rows, "path STRING, content BINARY")).collect()}
    assert got["a.xlsx"] == ("xlsx", False) and got["b.pdf"] == ("xlsx", True) and got["c.docx"] == ("docx", False) and got["d.txt"] == ("text", False)
    assert got["e.doc"] == ("legacy_office", False) and got["f.bin"] == ("pdf", False) and got["g.png"] == ("image", False) and got["h"][0] == "unknown"


def test_encodings(spark):
    rows = [(1, "zwölf".encode()), (2, "﻿bom".encode()), (3, "姓名,城市\n王小明,台北".encode("big5")), (4, "编号,姓名,城市\n1,张三,北京".encode("gb18030")), (5, None)]
    got = {r.doc_id: r for r in files.decoded(spark.createDataFrame(rows, "doc_id LONG, content BINARY")).collect()}
    assert (got[1].text, got[1].encoding, got[1].ambiguous) == ("zwölf", "utf-8", False) and (got[2].text, got[2].encoding) == ("bom", "utf-8-sig")
    assert got[3].text.startswith("姓名") and got[3].encoding == "big5" and got[3].ambiguous and [c.encoding for c in got[3].candidates][:2] == ["big5", "cp950"]
    assert got[4].text.startswith("编号") and got[4].encoding == "gb18030" and got[5].text is None
    stated = files.decoded(one(spark, "é".encode("latin-1")), "latin-1").first()
    assert (stated.text, stated.encoding, stated.ambiguous) == ("é", "latin-1", False)
    assert files.decoded(one(spark, b"\xff"), "ascii").first().decode_error


def test_ragged_csv(spark):
    r = text.csv_cells(one(spark, 'a,b\r\n"1\r\n2",3,4\r\nx,y\r\n', "text", "STRING")).orderBy("row", "column").collect()
    assert [(x.row, x.column, x.value) for x in r] == [(0, 0, "a"), (0, 1, "b"), (0, 2, "__extra_1"), (1, 0, "1\r\n2"), (1, 1, "3"), (1, 2, "4"), (2, 0, "x"), (2, 1, "y"), (2, 2, "")]
    assert r[0].width == 3 and r[0].n_widths == 2
    semi = text.csv_cells(one(spark, "a;b\n1;2\n3;4\n", "text", "STRING"))
    assert semi.count() == 6 and semi.first().delimiter == ";"
    assert text.csv_cells(one(spark, None, "text", "STRING")).count() == 0


def test_json(spark):
    rows = [(1, '{"姓": [1, {"b": "}{"}]}'), (2, "{broken"), (3, "[" * 1100 + "]" * 1100), (4, None)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: r for r in text.json_blocks(df).collect()}
    assert got[1].content.startswith('```json\n{\n  "姓": [\n    1,') and got[1].json_valid and got[1].depth == 4
    assert got[2].content == "```json\n{broken\n```" and not got[2].json_valid and 3 not in got
    checked = {r.doc_id: r for r in text.json_checked(df).collect()}
    assert checked[3].failure == "JSON_NESTING_LIMIT_EXCEEDED" and checked[1].source_depth == 3


def test_mail(spark):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Hello", "a@example.org", "b@example.org"
    m.set_content("body text\n")
    m.add_attachment(b"one", maintype="application", subtype="octet-stream", filename="../../etc/pass wd.txt")
    m.add_attachment(b"two", maintype="application", subtype="octet-stream", filename="x/pass wd.txt")
    got = text.mails(one(spark, m.as_bytes()))
    r = got.first()
    assert (r.subject, r.sender, r.cc, r.body, r.body_kind) == ("Hello", "a@example.org", None, "body text", "text/plain") and [bytes(a.content) for a in r.attachments] == [b"one", b"two"]
    names = got.select("doc_id", F.posexplode("attachments").alias("no", "a")).select("doc_id", "no", F.col("a.name").alias("name"))
    assert [x.safe for x in text.attachment_names(names).orderBy("no").collect()] == ["pass_wd.txt", "pass_wd_1.txt"]
    assert text.mails(one(spark, b"")).first().body == ""


def pages(spark, markup, url=None):
    return spark.createDataFrame([(1, url, markup)], "doc_id LONG, url STRING, html STRING")


def test_html_tree(spark):
    page = """<body><nav><a href="/x">menu</a></nav><main><h1>One</h1><p>para <a href="/rel">link</a></p><ul><li><p>item</p><ul><li>inner</li></ul></li></ul>
      <table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table><h2>Two</h2><p>end<br>line</main><footer>foot</footer></body>"""
    p = pages(spark, page, "https://e.org/dir/page")
    es = html.elements(p).orderBy("ordinal").collect()
    text_ = "\n".join(e.content or "" for e in es)
    assert "menu" not in text_ and "foot" not in text_ and text_.count("item") == 1 and text_.count("inner") == 1 and "https://e.org/rel" in text_
    assert [e.content.lstrip("# ") for e in es if e.type == "heading"] == ["One", "Two"]
    cells = {(c.row, c.column): (c.value, c.rowspan, c.colspan) for c in html.cells(p).collect()}
    assert cells == {(0, 0): ("a", 2, 1), (0, 1): ("b", 1, 2), (1, 1): ("c", 1, 1), (1, 2): ("d", 1, 1)}
    m = html.metrics(p).first()
    assert (m.main_strategy, m.main_confidence, m.table_count, m.merged_anchor_count) == ("main_element", "high", 1, 2)
    assert html.fidelity(html.metrics(p)).first().status == "passed"


def test_html_without_base_or_markup(spark):
    m = html.metrics(pages(spark, '<p><a href="x/y">z</a></p>')).first()
    assert m.main_confidence == "low" and m.unresolved_links == 1
    for odd in (None, "", "<p", "<table><tr><td rowspan=x>", "</div></div>"):
        assert html.metrics(pages(spark, odd)).count() == 1
        html.elements(pages(spark, odd)).collect()


def test_docx(spark):
    f = one(spark, DOCX)
    es = ooxml.docx_elements(f).orderBy("ordinal").collect()
    assert [e.type for e in es] == ["heading", "paragraph", "table"] and es[1].content == "**bold** plain" and es[1].parent_id == es[0].id
    assert {(c.row, c.column): (c.value, c.colspan) for c in ooxml.docx_cells(f).collect()} == {(0, 0): ("wide", 2), (1, 0): ("a", 1), (1, 1): ("b", 1)}
    assert ooxml.metadata(f).first().title == "A title" and ooxml.media(f).first().safe == "image1.png"


def test_xlsx(spark):
    f = one(spark, XLSX)
    cells = {(c.row, c.column): c for c in ooxml.xlsx_cells(f).collect()}
    assert "head" in {c.value for c in cells.values()} and max(c.colspan for c in cells.values()) == 2
    s = ooxml.xlsx_sheets(f).first()
    assert (s.sheet, s.merged_ranges, s.formulas, s.formulas_missing) == ("Data", 1, 1, 1)


@pytest.mark.parametrize("bad", [None, b"", b"PK\x03\x04 not a zip"])
def test_damaged_containers_give_no_rows(spark, bad):
    f = one(spark, bad)
    for read in (ooxml.docx_elements, ooxml.xlsx_cells, ooxml.pptx_elements, ooxml.media):
        assert read(f).count() == 0


def test_office_state(spark):
    broken = bytearray(XLSX)
    at = broken.find(b"<workbook")
    broken[at : at + 4] = b"<wor"[::-1]
    rows = [(1, "xlsx", XLSX), (2, "docx", XLSX), (3, "docx", b"\xd0\xcf\x11\xe0"), (4, "xlsx", bytes(broken)), (5, "text", b"x")]
    got = {r.doc_id: r.encryption for r in files.office_state(spark.createDataFrame(rows, "doc_id LONG, resolved STRING, content BINARY")).collect()}
    assert got == {1: "not_encrypted", 2: "corrupt", 3: "unknown", 4: "corrupt", 5: None}


def test_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    (r,) = files.scan(spark, str(tmp_path), "*.txt", max_bytes=50).collect()
    assert r.sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
