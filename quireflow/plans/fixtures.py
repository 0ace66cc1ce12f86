"""Small files made in code, the same bytes each time: containers have one fixed time stamp."""

from __future__ import annotations

import io
import zipfile
from email.message import EmailMessage

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_R = f'xmlns:r="{_OFFICE}"'


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def rels(*rows: tuple[str, str, str]) -> str:
    """id, last word of the type, target; targets with :// are external."""
    each = "".join(f'<Relationship Id="{i}" Type="{_OFFICE}/{t}" Target="{x}"{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in x else ""}/>' for i, t, x in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{each}</Relationships>'


def core(title: str, creator: str) -> str:
    return (
        '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f"<dc:title>{title}</dc:title><dc:creator>{creator}</dc:creator></cp:coreProperties>"
    )


def _para(text: str, style: str = "", run: str = "") -> str:
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}<w:r>{f'<w:rPr>{run}</w:rPr>' if run else ''}<w:t>{text}</w:t></w:r></w:p>"


def docx() -> bytes:
    """Headings of two levels, marked runs, a link, a list, a table merged both ways with one inside, a picture, a note and a header."""
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{_para(text) if text is not None else ''}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell('in')}</w:tr></w:tbl>"
    picture = f'<w:p><w:r><w:drawing><docPr xmlns="x" name="pic"/><a:blip {_A} {_R} r:embed="rId2"/></w:drawing></w:r></w:p>'
    body = (
        _para("Top", "Heading1") + f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> plain </w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t>it</w:t></w:r>"
        f'<w:hyperlink {_R} r:id="rId1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>' + _para("Sub", "Heading2") + _para("one", "ListBullet") + _para("two", "ListNumber")
        + f"<w:tbl><w:tr>{cell('wide', '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}</w:tr><w:tr>{cell('tall', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell('b')}</w:tr>"
        f"<w:tr>{cell('', '<w:vMerge/>')}<w:tc>{inner}{_para('c')}</w:tc></w:tr></w:tbl>" + picture + '<w:p><w:r><w:t>end</w:t><w:footnoteReference w:id="1"/></w:r></w:p>'
    )
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("Heading1", "heading 1"), ("Heading2", "heading 2"), ("ListBullet", "List Bullet"), ("ListNumber", "List Number")))
    return package({
        "word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {_W}>{styles}</w:styles>",
        "word/footnotes.xml": f'<w:footnotes {_W}><w:footnote w:id="1">{_para("a note")}</w:footnote></w:footnotes>', "word/header1.xml": f"<w:hdr {_W}>{_para('head')}</w:hdr>",
        "word/_rels/document.xml.rels": rels(("rId1", "hyperlink", "https://e.org/a"), ("rId2", "image", "media/p.png")), "word/media/p.png": b"\x89PNG", "docProps/core.xml": core("A title", "An author"),
    })


def xlsx() -> bytes:
    """Two sheets, one hidden: strings, numbers, a flag, a date, formulas with and without a value, a merge, a link, a comment and a chart."""
    shared = "".join(f"<si><t>{x}</t></si>" for x in ("head", "x", "text"))
    one = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c><c r="C2" t="b"><v>1</v></c></row>'
        '<row r="3"><c r="A3" s="1"><v>45292</v></c><c r="B3"><f>B2+1</f><v>6</v></c><c r="C3"><f>B2+2</f></c></row><row r="4"><c r="A4" t="inlineStr"><is><t>in</t></is></c></row>'
    )
    return package({
        "xl/workbook.xml": f'<workbook {_S} {_R}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Off" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("rId1", "worksheet", "worksheets/sheet1.xml"), ("rId2", "worksheet", "worksheets/sheet2.xml")), "xl/sharedStrings.xml": f"<sst {_S}>{shared}</sst>",
        "xl/styles.xml": f'<styleSheet {_S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {_S} {_R}><sheetData>{one}</sheetData><mergeCells count="1"><mergeCell ref="A1:C1"/></mergeCells><hyperlinks><hyperlink ref="A2" r:id="rId1"/></hyperlinks></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("rId1", "hyperlink", "https://e.org/x"), ("rId2", "comments", "../comments1.xml"), ("rId3", "drawing", "../drawings/drawing1.xml")),
        "xl/comments1.xml": f'<comments {_S}><commentList><comment ref="B2"><text><r><t>why</t></r></text></comment></commentList></comments>',
        "xl/drawings/drawing1.xml": "<x/>", "xl/drawings/_rels/drawing1.xml.rels": rels(("rId1", "chart", "../charts/chart1.xml")), "xl/charts/chart1.xml": "<x/>",
        "xl/worksheets/sheet2.xml": f'<worksheet {_S}><sheetData><row r="2"><c r="B2" t="s"><v>2</v></c></row></sheetData></worksheet>',
    })


def _shape(n: int, role: str | None, *paras: str, style: str = "") -> str:
    ph = f'<p:ph type="{role}" idx="{n}"/>' if role else ""
    lines = "".join(p if p.startswith("<a:p>") else f"<a:p><a:r><a:t>{p}</a:t></a:r></a:p>" for p in paras)
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="s"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:lstStyle>{style}</a:lstStyle>{lines}</p:txBody></p:sp>'


def pptx() -> bytes:
    """A slide with a title, bullets of its own, of its list style, of the layout and of the master, prose, a group with a table that merges, a picture, a chart, a diagram and notes."""
    number = "<a:p><a:pPr><a:buAutoNum/></a:pPr><a:r><a:t>first</a:t></a:r></a:p>"
    none = "<a:p><a:pPr><a:buNone/></a:pPr><a:r><a:t>bare</a:t></a:r></a:p>"
    deep = '<a:p><a:pPr lvl="1"/><a:r><a:t>deep</a:t></a:r></a:p>'
    table = '<a:tbl><a:tr><a:tc gridSpan="2"><a:txBody><a:p><a:r><a:t>wide</a:t></a:r></a:p></a:txBody></a:tc><a:tc hMerge="1"/></a:tr><a:tr><a:tc><a:txBody><a:p><a:r><a:t>a</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>b</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl>'
    frame = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="8" name="t"/></p:nvGraphicFramePr><a:graphic><a:graphicData>{table}</a:graphicData></a:graphic></p:graphicFrame>'
    chart = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="9" name="c"/></p:nvGraphicFramePr><c:chart xmlns:c="c" {_R} r:id="rId3"/></p:graphicFrame>'
    picture = f'<p:pic><p:nvPicPr><p:cNvPr id="10" name="p"/></p:nvPicPr><a:blip {_R} r:embed="rId4"/></p:pic>'
    tree = (
        _shape(2, "title", "Hello") + _shape(3, "body", number, none, "plain", deep) + _shape(4, "body", "styled", style="<a:lvl1pPr><a:buAutoNum/></a:lvl1pPr>") + _shape(5, "body", "laid out") + _shape(6, None, "prose")
        + f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="7" name="g"/></p:nvGrpSpPr>{frame}</p:grpSp>' + chart + picture + _shape(11, "ftr", "foot")
    )
    slide = lambda inside, tag="sld": f"<p:{tag} {_P} {_A} {_R}><p:cSld><p:spTree>{inside}</p:spTree></p:cSld></p:{tag}>"
    series = "<ser><tx><v>S</v></tx><cat><v>q1</v><v>q2</v></cat><val><v>1</v><v>2</v></val></ser>"
    return package({
        "ppt/presentation.xml": f'<p:presentation {_P} {_R}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": slide(tree),
        "ppt/slides/_rels/slide1.xml.rels": rels(("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "notesSlide", "../notesSlides/notesSlide1.xml"), ("rId3", "chart", "../charts/chart1.xml"), ("rId4", "image", "../media/p.png"), ("rId5", "diagramData", "../diagrams/data1.xml"), ("rId6", "oleObject", "../embeddings/o.bin")),
        "ppt/slideLayouts/slideLayout1.xml": slide(_shape(5, "body", style="<a:lvl1pPr><a:buNone/></a:lvl1pPr>"), "sldLayout"), "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rels(("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/slideMasters/slideMaster1.xml": f'<p:sldMaster {_P} {_A}><p:txStyles><p:bodyStyle><a:lvl1pPr><a:buChar char="x"/></a:lvl1pPr><a:lvl2pPr><a:buNone/></a:lvl2pPr></p:bodyStyle></p:txStyles></p:sldMaster>',
        "ppt/notesSlides/notesSlide1.xml": slide(_shape(3, "body", "say this"), "notes"), "ppt/charts/chart1.xml": f"<chart {_A}><title><a:t>Sales</a:t></title>{series}</chart>", "ppt/media/p.png": b"\x89PNG",
    })


def mail(kind: int) -> bytes:
    """0: plain text, 1: HTML alone, 2: text with two attachments of one name."""
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = f"Mail {kind}", "a@example.org", "b@example.org", "Mon, 01 Jan 2024 00:00:00 +0000"
    if kind == 1:
        m.set_content("<p>Dear <b>all</b></p>\n", subtype="html")
    else:
        m.set_content("body text\n")
    if kind == 2:
        m["Cc"] = "c@example.org"
        for content in (b"one", b"three"):
            m.add_attachment(content, maintype="application", subtype="octet-stream", filename="../x y.txt")
    return m.as_bytes()


def picked(of: Column, *values: bytes | str) -> Column:
    """The of-th of literal values, by the remainder of their number."""
    binary = isinstance(values[0], bytes)
    each = [F.unhex(F.lit(v.hex().upper())) if binary else F.lit(v) for v in values]
    return F.element_at(F.array(*each), (F.pmod(of, F.lit(len(values))) + 1).cast("int"))
