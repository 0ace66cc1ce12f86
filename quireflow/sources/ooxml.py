"""Office containers as elements and cells, with their media and properties: zip and XML, no Office library.

A file is a unit of work in a Python worker; what follows is DataFrames. A damaged part gives fewer rows, and a damaged file none.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.sources.slices import slices

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DC = {"title": "{http://purl.org/dc/elements/1.1/}title", "creator": "{http://purl.org/dc/elements/1.1/}creator", "last_modified_by": "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}lastModifiedBy", "created": "{http://purl.org/dc/terms/}created", "modified": "{http://purl.org/dc/terms/}modified"}

ELEMENT = "id string, ordinal int, type string, content string, parent_id string, heading_path array<string>, table_id string, place string, shape_id string"
CELL = "table_id string, sheet string, row int, column int, value string, rowspan int, colspan int, is_header boolean, formula string, number_format string, link string"


class Package:
    def __init__(self, data: bytes | None):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data or b""))
            self.names = self.zip.namelist()
        except (zipfile.BadZipFile, OSError, ValueError):
            self.zip, self.names = None, []

    def bytes(self, name: str) -> bytes:
        try:
            return self.zip.read(name) if self.zip else b""
        except (KeyError, zipfile.BadZipFile, OSError, RuntimeError):
            return b""

    def xml(self, name: str) -> ET.Element | None:
        data = self.bytes(name)
        try:
            return ET.fromstring(data) if data else None
        except ET.ParseError:
            return None

    def rels(self, name: str) -> dict[str, tuple[str, str]]:
        """id -> (type's last word, target within the package or URL)."""
        base, leaf = posixpath.split(name)
        root = self.xml(f"{base}/_rels/{leaf}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
        return out


def merged_marks(text: str, bold: bool, italic: bool) -> str:
    mark = "***" if bold and italic else "**" if bold else "*" if italic else ""
    return f"{mark}{text}{mark}" if text.strip() else text


class Docx(Package):
    """The body in order: headings with a stack of parents, list items, paragraphs, tables, and notes at the end."""

    def __init__(self, data: bytes | None):
        super().__init__(data)
        self.elements: list[dict] = []
        self.cells: list[dict] = []
        self.stack: list[tuple[int, str, str]] = []
        self.tables = self.nested = 0
        self.links = self.rels("word/document.xml")
        styles = self.xml("word/styles.xml")
        self.styles = {s.get(W + "styleId"): (s.find(W + "name").get(W + "val") if s.find(W + "name") is not None else s.get(W + "styleId")) for s in (styles.iter(W + "style") if styles is not None else ())}
        root = self.xml("word/document.xml")
        body = root.find(W + "body") if root is not None else None
        for node in body if body is not None else ():
            if node.tag == W + "p":
                self.paragraph(node)
            elif node.tag == W + "tbl":
                self.table(node)
        for kind in ("footnotes", "endnotes"):
            notes = self.xml(f"word/{kind}.xml")
            for note in notes if notes is not None else ():
                if note.get(W + "type") is None and (text := " ".join(filter(None, (self.inline(p) for p in note.iter(W + "p"))))):
                    self.add("note", f"[^{kind[:-1]}-{note.get(W + 'id')}]: {text}", None)
        for name in sorted(n for n in self.names if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n)):
            part = self.xml(name)
            text = " ".join(filter(None, (self.inline(p) for p in part.iter(W + "p")))) if part is not None else ""
            if text:
                self.add("header" if "header" in name else "footer", text, None)

    def add(self, kind: str, content: str, parent: str | None, table_id: str | None = None) -> str:
        n = len(self.elements) + 1
        self.elements.append({"id": f"docx-{kind}-{n:04d}", "ordinal": n, "type": kind, "content": content, "parent_id": parent, "heading_path": [t for _, _, t in self.stack], "table_id": table_id, "place": None, "shape_id": None})
        return self.elements[-1]["id"]

    def run(self, r: ET.Element) -> str:
        on = lambda p, t: p is not None and p.find(W + t) is not None and p.find(W + t).get(W + "val", "1") not in ("0", "false")
        props, out = r.find(W + "rPr"), []
        for k in r:
            if k.tag == W + "t":
                out.append(k.text or "")
            elif k.tag == W + "tab":
                out.append("\t")
            elif k.tag == W + "br":
                out.append("\n")
            elif k.tag in (W + "footnoteReference", W + "endnoteReference"):
                out.append(f"[^{k.tag[len(W):-9]}-{k.get(W + 'id')}]")
            elif k.tag == W + "drawing":
                out += [f"![{b.get('name', '')}]({posixpath.basename(self.links.get(e, ('', ''))[1])})" for b, e in zip(_docpr(k), _embeds(k), strict=False)]
        return merged_marks("".join(out), on(props, "b"), on(props, "i"))

    def inline(self, p: ET.Element) -> str:
        out = []
        for k in p:
            if k.tag == W + "r":
                out.append(self.run(k))
            elif k.tag == W + "hyperlink":
                label, url = "".join(self.run(r) for r in k.iter(W + "r")), self.links.get(k.get(R + "id", ""), ("", ""))[1]
                out.append(f"[{label}]({url})" if url else label)
        return "".join(out)

    def paragraph(self, p: ET.Element) -> None:
        text, props = self.inline(p).strip(), p.find(W + "pPr")
        if not text:
            return
        style = props.find(W + "pStyle") if props is not None else None
        name = (self.styles.get(style.get(W + "val"), style.get(W + "val")) if style is not None else "").lower()
        level = 1 if name == "title" else min(6, max(1, int(m[1]))) if (m := re.match(r"heading\s*(\d+)", name)) else 0
        number = props.find(W + "numPr") if props is not None else None
        if level:
            self.stack = [s for s in self.stack if s[0] < level]
            self.stack.append((level, self.add("heading", "#" * level + " " + text, self.stack[-1][1] if self.stack else None), text))
        elif number is not None or name.startswith("list"):
            depth = int(number.find(W + "ilvl").get(W + "val", "0")) if number is not None and number.find(W + "ilvl") is not None else 0
            self.add("list_item", "  " * depth + ("1. " if "number" in name else "- ") + text, self.stack[-1][1] if self.stack else None)
        else:
            self.add("paragraph", text, self.stack[-1][1] if self.stack else None)

    def table(self, tbl: ET.Element) -> None:
        self.tables += 1
        name, open_, rows = f"table-{self.tables:04d}", {}, []
        cells: list[dict] = []
        for r, tr in enumerate(tbl.findall(W + "tr")):
            c, row = 0, []
            for tc in tr.findall(W + "tc"):
                props = tc.find(W + "tcPr")
                get = lambda t, d: props.find(W + t).get(W + "val", d) if props is not None and props.find(W + t) is not None else None  # noqa: B023, E731
                columns, merge = int(get("gridSpan", "1") or 1), get("vMerge", "continue")
                self.nested += len(tc.findall(W + "tbl"))
                text = "\n".join(filter(None, (self.inline(p).strip() for p in tc.iter(W + "p"))))
                if merge == "continue" and c in open_:
                    open_[c]["rowspan"] += 1
                    text = open_[c]["value"]
                else:
                    cell = {"table_id": name, "sheet": None, "row": r, "column": c, "value": text, "rowspan": 1, "colspan": columns, "is_header": r == 0, "formula": None, "number_format": None, "link": None}
                    cells.append(cell)
                    open_[c] = cell
                row += [text] * columns
                c += columns
            rows.append(row)
        self.cells += cells
        self.add("table", pipe(rows), self.stack[-1][1] if self.stack else None, name)


def _embeds(node: ET.Element) -> list[str]:
    return [b.get(R + "embed", "") for b in node.iter(A + "blip")]


def _docpr(node: ET.Element) -> list[ET.Element]:
    return [d for d in node.iter() if d.tag.endswith("}docPr")]


def pipe(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    cell = lambda v: (v or "").replace("|", "\\|").replace("\n", "<br>")
    out = ["| " + " | ".join(cell(v) for v in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([out[0], "| " + " | ".join(["---"] * width) + " |", *out[1:]])


DATES = frozenset([*range(14, 23), *range(45, 48)])


class Xlsx(Package):
    """Cells of every sheet with formulas, cached values, merges, links, and what cannot be shown."""

    def __init__(self, data: bytes | None):
        super().__init__(data)
        self.cells: list[dict] = []
        self.sheets: list[dict] = []
        shared = self.xml("xl/sharedStrings.xml")
        self.shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in (shared.findall(S + "si") if shared is not None else ())]
        styles = self.xml("xl/styles.xml")
        formats = {int(n.get("numFmtId")): n.get("formatCode", "") for n in (styles.iter(S + "numFmt") if styles is not None else ())}
        xfs = styles.find(S + "cellXfs") if styles is not None else None
        self.formats = [(int(x.get("numFmtId", 0)), formats.get(int(x.get("numFmtId", 0)), "")) for x in (xfs if xfs is not None else ())]
        book, rels = self.xml("xl/workbook.xml"), self.rels("xl/workbook.xml")
        for k, s in enumerate(book.iter(S + "sheet") if book is not None else (), 1):
            self.sheet(k, s.get("name", ""), s.get("state", "visible"), rels.get(s.get(R + "id", ""), ("", ""))[1])
        names = book.find(S + "definedNames") if book is not None else None
        self.defined = {n.get("name"): n.text for n in (names if names is not None else ())}

    def value(self, c: ET.Element) -> tuple[str | None, str]:
        v, kind = c.find(S + "v"), c.get("t", "n")
        style = int(c.get("s", 0))
        number, code = self.formats[style] if style < len(self.formats) else (0, "")
        text = v.text if v is not None else None
        if kind == "s" and text is not None:
            at = int(text)
            return (self.shared[at] if at < len(self.shared) else None), code
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(S + "t")), code
        if kind == "b" and text is not None:
            return ("True" if text == "1" else "False"), code
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]', "", code.lower())
        if text is not None and kind == "n" and (number in DATES or re.search("[ymdh]", bare)):
            day = datetime(1899, 12, 30) + timedelta(days=float(text))
            timed = number in (18, 19, 20, 21, 22, 45, 46, 47) or "h" in bare or ":" in bare
            return day.isoformat(sep=" " if timed else "T"), code
        return text, code

    def sheet(self, k: int, name: str, state: str, path: str) -> None:
        root, rels = self.xml(path), self.rels(path)
        if root is None:
            return
        spans = {}
        for m in root.iter(S + "mergeCell"):
            if b := re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", m.get("ref", "")):
                spans[column(b[1]), int(b[2])] = (int(b[4]) - int(b[2]) + 1, column(b[3]) - column(b[1]) + 1)
        links = {h.get("ref"): rels.get(h.get(R + "id", ""), ("", ""))[1] for h in root.iter(S + "hyperlink")}
        n = missing = 0
        for c in root.iter(S + "c"):
            b = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
            if not b:
                continue
            f, (value, code) = c.find(S + "f"), self.value(c)
            formula = "=" + (f.text or "") if f is not None else None
            if value is None and formula is None:
                continue
            at = (column(b[1]), int(b[2]))
            n += formula is not None
            missing += formula is not None and value is None
            text = value if value is not None else f"{formula} <!-- formula result unavailable -->"
            if url := links.get(c.get("r")):
                text = f"[{text or url}]({url})"
            rows, columns = spans.get(at, (1, 1))
            self.cells.append({"table_id": f"sheet-{k:03d}", "sheet": name, "row": at[1], "column": at[0], "value": text, "rowspan": rows, "colspan": columns, "is_header": False, "formula": formula, "number_format": code, "link": url})
        charts = sum(1 for t, target in rels.values() if t == "drawing" for kind, _ in self.rels(target).values() if kind == "chart")
        comments = [(c.get("ref"), "".join(t.text or "" for t in c.iter(S + "t")).strip()) for t, target in rels.values() if t == "comments" for c in (self.xml(target).iter(S + "comment") if self.xml(target) is not None else ())]
        self.sheets.append({"sheet": name, "hidden": state != "visible", "merged_ranges": len(spans), "formulas": n, "formulas_missing": missing, "charts": charts, "comments": [f"{r}: {t}" for r, t in comments]})


def column(letters: str) -> int:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n


class Pptx(Package):
    """Slides and their shapes, groups opened; placeholders by role; tables with merges; charts; pictures; notes."""

    def __init__(self, data: bytes | None):
        super().__init__(data)
        self.elements: list[dict] = []
        self.cells: list[dict] = []
        self.tables = self.smartart = self.ole = 0
        deck, rels = self.xml("ppt/presentation.xml"), self.rels("ppt/presentation.xml")
        ids = [s.get(R + "id", "") for s in (deck.iter(P + "sldId") if deck is not None else ())]
        for n, rid in enumerate(ids, 1):
            path = rels.get(rid, ("", ""))[1]
            root = self.xml(path)
            if root is None:
                continue
            self.links, self.n = self.rels(path), n
            self.smartart += sum(t == "diagramData" for t, _ in self.links.values())
            self.ole += sum(t in ("oleObject", "package") for t, _ in self.links.values())
            slide = self.add("slide", "", None, None)
            tree = root.find(f"{P}cSld/{P}spTree")
            for shape in tree if tree is not None else ():
                self.shape(shape, slide)
            for t, target in self.links.values():
                notes = self.xml(target) if t == "notesSlide" else None
                text = "\n".join(filter(None, (self.lines(s, True) for s in notes.iter(P + "sp") if self.role(s) == "body"))) if notes is not None else ""
                if text:
                    self.add("note", text, slide, None)

    def add(self, kind: str, content: str, parent: str | None, shape: str | None, table_id: str | None = None) -> str:
        k = len(self.elements) + 1
        self.elements.append({"id": f"pptx-{kind}-{k:04d}", "ordinal": k, "type": kind, "content": content, "parent_id": parent, "heading_path": [], "table_id": table_id, "place": str(self.n), "shape_id": shape})
        return self.elements[-1]["id"]

    def role(self, shape: ET.Element) -> str | None:
        ph = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
        return None if ph is None else ph.get("type", "body")

    def inherited(self, shape: ET.Element, level: int) -> ET.Element | None:
        """What first says something of bullets at a level: the shape's list style, its placeholder in the layout, the master's body style."""
        tag = f"{A}lvl{min(max(level, 0), 8) + 1}pPr"
        ph = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
        layout = next((target for t, target in self.links.values() if t == "slideLayout"), "")
        page = self.xml(layout)
        styles = [shape.find(f"{P}txBody/{A}lstStyle")]
        for s in page.iter(P + "sp") if page is not None and ph is not None else ():
            other = s.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            if other is not None and other.get("idx", "0") == ph.get("idx", "0"):
                styles.append(s.find(f"{P}txBody/{A}lstStyle"))
                break
        master = self.xml(next((target for t, target in self.rels(layout).values() if t == "slideMaster"), "")) if layout else None
        styles.append(master.find(f"{P}txStyles/{P}bodyStyle") if master is not None else None)
        found = (s.find(tag) for s in styles if s is not None)
        return next((p for p in found if p is not None and bullet(p) is not None), None)

    def lines(self, shape: ET.Element, title: bool) -> str:
        out, body = [], self.role(shape) in ("body", "obj", "vert")
        for p in shape.iter(A + "p"):
            text = "".join((t.text or "") if t.tag == A + "t" else "\n" for t in p.iter() if t.tag in (A + "t", A + "br")).strip()
            if not text:
                continue
            props = p.find(A + "pPr")
            level = int(props.get("lvl", 0)) if props is not None else 0
            mark = bullet(props)
            if mark is None and body:
                mark = bullet(self.inherited(shape, level))
            mark = mark or ""
            out.append(text if title else "  " * level * bool(mark) + mark + text)
        return "\n".join(out)

    def shape(self, s: ET.Element, parent: str) -> None:
        own = next((e.get("id") for e in s.iter(P + "cNvPr")), None)
        if s.tag == P + "grpSp":
            group = self.add("group", "", parent, own)
            for k in s:
                self.shape(k, group)
        elif s.tag == P + "sp":
            title = self.role(s) in ("title", "ctrTitle")
            if text := self.lines(s, title):
                self.add("heading" if title else "footer" if self.role(s) in ("ftr", "dt", "sldNum") else "paragraph", ("# " if title else "") + text, parent, own)
        elif s.tag == P + "pic":
            for e in _embeds(s):
                self.add("image", f"![]({posixpath.basename(self.links.get(e, ('', ''))[1])})", parent, own)
        elif s.tag == P + "graphicFrame":
            for tbl in s.iter(A + "tbl"):
                self.table(tbl, parent, own)
            for c in s.iter():
                if c.tag.endswith("}chart") and c.get(R + "id"):
                    chart = self.xml(self.links.get(c.get(R + "id"), ("", ""))[1])
                    if chart is not None:
                        self.add("chart", chart_text(chart), parent, own)

    def table(self, tbl: ET.Element, parent: str, own: str | None) -> None:
        self.tables += 1
        name, rows = f"table-{self.tables:04d}", []
        for r, tr in enumerate(tbl.findall(A + "tr")):
            row = []
            for c, tc in enumerate(tr.findall(A + "tc")):
                text = "\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in tc.iter(A + "p")).strip()
                if tc.get("hMerge") or tc.get("vMerge"):
                    row.append("")
                    continue
                self.cells.append({"table_id": name, "sheet": None, "row": r, "column": c, "value": text, "rowspan": int(tc.get("rowSpan", 1)), "colspan": int(tc.get("gridSpan", 1)), "is_header": r == 0, "formula": None, "number_format": None, "link": None})
                row.append(text)
            rows.append(row)
        self.add("table", pipe(rows), parent, own, name)


def bullet(props: ET.Element | None) -> str | None:
    """The mark that paragraph properties ask for: none, a number or a dash; null if they say nothing."""
    if props is None:
        return None
    return next((mark for tag, mark in (("buNone", ""), ("buAutoNum", "1. "), ("buChar", "- ")) if props.find(A + tag) is not None), None)


def chart_text(chart: ET.Element) -> str:
    """The chart's title, and each series with its categories and values."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    title = next(("".join(t.text or "" for t in e.iter(A + "t")) for e in chart.iter() if tag(e) == "title"), "")
    out = [f"Chart: {title}".rstrip(": ")]
    for ser in (e for e in chart.iter() if tag(e) == "ser"):
        values = {k: [v.text or "" for e in ser if tag(e) == k for v in e.iter() if tag(v) == "v"] for k in ("tx", "cat", "val")}
        out.append(f"{' '.join(values['tx'])}: " + ", ".join(f"{c}: {v}" for c, v in zip(values["cat"], values["val"], strict=False)))
    return "\n".join(out)


def _mapped(files: DataFrame, schema: str, rows: Callable[[bytes], list[dict]]) -> DataFrame:
    names = ["doc_id", *re.findall(r"(\w+) (?:array<string>|struct<[^>]*>|\w+)(?:, |$)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, once in slices(b):
                each = lambda data: [tuple(r[n] for n in names[1:]) for r in rows(data)]
                yield pd.DataFrame([(doc, *r) for doc, data in zip(part["doc_id"], part["content"], strict=True) for r in once(data, each)], columns=names)

    d = files.select("doc_id", "content")
    return d.mapInPandas(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {schema}")


def docx_elements(files: DataFrame) -> DataFrame:
    return _mapped(files, ELEMENT, lambda b: Docx(b).elements)


def docx_cells(files: DataFrame) -> DataFrame:
    return _mapped(files, CELL, lambda b: Docx(b).cells)


def xlsx_cells(files: DataFrame) -> DataFrame:
    return _mapped(files, CELL, lambda b: Xlsx(b).cells)


def xlsx_sheets(files: DataFrame) -> DataFrame:
    return _mapped(files, "sheet string, hidden boolean, merged_ranges int, formulas int, formulas_missing int, charts int, comments array<string>", lambda b: Xlsx(b).sheets)


def pptx_elements(files: DataFrame) -> DataFrame:
    return _mapped(files, ELEMENT, lambda b: Pptx(b).elements)


def pptx_cells(files: DataFrame) -> DataFrame:
    return _mapped(files, CELL, lambda b: Pptx(b).cells)


def pptx_counts(files: DataFrame) -> DataFrame:
    return _mapped(files, "smartart_parts int, ole_objects int", lambda b: [{"smartart_parts": p.smartart, "ole_objects": p.ole} for p in [Pptx(b)]])


def metadata(files: DataFrame) -> DataFrame:
    def rows(b: bytes) -> list[dict]:
        core = Package(b).xml("docProps/core.xml")
        return [{k: core.findtext(t) if core is not None else None for k, t in DC.items()}]

    return _mapped(files, ", ".join(f"{k} string" for k in DC), rows)


def media(files: DataFrame) -> DataFrame:
    """doc_id, name, safe, sha256, content of media parts; equal base names get _n in the order of their paths."""
    from pyspark.sql import Window

    def rows(b: bytes) -> list[dict]:
        p = Package(b)
        return [{"name": n, "content": p.bytes(n)} for n in p.names if re.match(r"(?:word|xl|ppt)/media/.", n)]

    m = _mapped(files, "name string, content binary", rows).withColumn("__b", F.regexp_extract("name", r"([^/]*)\z", 1))
    m = m.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__b").orderBy("name")))
    stem, ext = F.regexp_extract("__b", r"\A(.+?)(\.[^.]*)?\z", 1), F.regexp_extract("__b", r"\A(.+?)(\.[^.]*)?\z", 2)
    return m.select("doc_id", "name", F.when(F.col("__n") == 1, F.col("__b")).otherwise(F.concat(stem, F.lit("_"), (F.col("__n") - 1).cast("string"), ext)).alias("safe"), F.sha2("content", 256).alias("sha256"), "content")
