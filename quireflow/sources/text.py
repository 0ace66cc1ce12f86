"""Plain text, Markdown, CSV, JSON and e-mail as elements, cells and fields."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.scalars import attachment_base, blank, json_depth
from quireflow.sources.slices import slices

MAX_DEPTH = 1000


def binary_like(content: Column) -> Column:
    """Whether over a twentieth of the first 4 KiB are NUL bytes."""
    head = F.substring(content, 1, 4096)
    nul = F.size(F.filter(F.split(F.hex(head), "(?<=\\G..)"), lambda x: x == "00"))
    return nul > F.octet_length(head) * 0.05


def text_elements(docs: DataFrame, kind: str = "paragraph") -> DataFrame:
    """One element per document with text (doc_id, text): line ends as LF; kind is paragraph, or markdown_block for Markdown, which is not parsed."""
    body = F.regexp_replace("text", "\r\n?", "\n")
    return docs.filter(~blank(F.col("text"))).select("doc_id", F.lit(f"{kind}-0001").alias("id"), F.lit(1).alias("ordinal"), F.lit(kind).alias("type"), body.alias("content"))


CELLS = "row int, column int, value string, delimiter string, width int, n_widths int, extra int"


def csv_cells(files: DataFrame) -> DataFrame:
    """doc_id with the cells of each file's text: the delimiter is sniffed among , tab ; and |, the first row is the header, ragged
    rows are padded, surplus columns are named __extra_N. width is the widest row, n_widths how many widths there are.

    A file is one unit of work, as quotes may run across any line end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                try:
                    delimiter = csv.Sniffer().sniff((text or "")[:4096], delimiters=",\t;|").delimiter
                except csv.Error:
                    delimiter = ","
                rows = list(csv.reader(io.StringIO(text or "", newline=""), delimiter=delimiter))
                width = max((len(r) for r in rows), default=0)
                kinds, extra = len({len(r) for r in rows}), width - len(rows[0]) if rows else 0
                for k, r in enumerate(rows):
                    full = r + ([f"__extra_{n}" for n in range(1, extra + 1)] if k == 0 else [""] * (width - len(r)))
                    out += [(doc, k, c, v, delimiter, width, kinds, extra) for c, v in enumerate(full)]
            yield pd.DataFrame(out, columns=["doc_id", *(x.split()[0] for x in CELLS.split(", "))])

    d = files.select("doc_id", "text")
    return d.mapInPandas(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {CELLS}")


def json_checked(docs: DataFrame) -> DataFrame:
    """doc_id, source_depth, json_valid, failure: text deeper than the limit fails before it is parsed; invalid text is kept with a mark."""

    @F.pandas_udf("boolean")
    def parses(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool | None:
            if t is None:
                return None
            try:
                json.loads(t)
            except (ValueError, RecursionError):
                return False
            return True

        return texts.map(one)

    shallow = F.col("source_depth") <= MAX_DEPTH
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("source_depth", json_depth(F.col("text")))
    # try_parse_json() lets pass what follows a value, so that text goes to Python, and deep text does not.
    return d.select("doc_id", "text", "source_depth", F.when(shallow, parses(F.when(shallow, F.col("text")))).alias("json_valid"), F.when(F.col("source_depth") > MAX_DEPTH, F.lit("JSON_NESTING_LIMIT_EXCEEDED")).alias("failure"))


def json_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, content, json_valid, depth: a fenced block of the text, indented by two where it parses, as it is where not. Too deep ones are left out."""

    @F.pandas_udf("struct<pretty: string, depth: int>")
    def pretty(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple:
            try:
                value = json.loads(t or "")
            except (ValueError, RecursionError):
                return None, None
            most, todo = 0, [(value, 1)]
            while todo:
                x, d = todo.pop()
                most = max(most, d)
                todo += [(y, d + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
            return json.dumps(value, indent=2, ensure_ascii=False), most

        return pd.DataFrame([one(t) for t in texts], columns=["pretty", "depth"])

    d = json_checked(docs).filter("failure IS NULL").withColumn("__p", pretty("text"))
    body = F.coalesce(F.col("__p.pretty"), F.col("text"))
    return d.select("doc_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("content"), F.col("__p.pretty").isNotNull().alias("json_valid"), F.col("__p.depth").alias("depth"))


def mails(files: DataFrame) -> DataFrame:
    """doc_id, subject, sender, recipients, cc, date, body, body_kind, attachments (name, bytes) of messages (doc_id, content)."""
    import re
    from email import policy
    from email.parser import BytesParser

    def read(raw: bytes | None) -> tuple:
        m = BytesParser(policy=policy.default).parsebytes(raw or b"")
        body, kind = "", None
        parts = list(m.walk())
        for wanted in ("text/plain", "text/html"):
            part = next((p for p in parts if p.get_content_type() == wanted and p.get_content_disposition() != "attachment"), None)
            if part is not None:
                try:
                    body = part.get_content()
                except (LookupError, UnicodeDecodeError, KeyError):
                    body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
                kind = wanted
                break
        if kind == "text/html":
            body = re.sub(r"<[^>]+>", "", body)
        files_ = [(p.get_filename() or "attachment.bin", p.get_payload(decode=True) or b"") for p in parts if p.get_content_disposition() == "attachment"]
        head = [str(m[h]) if m[h] is not None else None for h in ("Subject", "From", "To", "Cc", "Date")]
        return (*head, body.strip(), kind, [{"name": n, "content": c} for n, c in files_])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, once in slices(b):
                out = [(doc, *once(raw, read)) for doc, raw in zip(part["doc_id"], part["content"], strict=True)]
                yield pd.DataFrame(out, columns=["doc_id", "subject", "sender", "recipients", "cc", "date", "body", "body_kind", "attachments"])

    d = files.select("doc_id", "content")
    return d.mapInPandas(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, subject string, sender string, recipients string, cc string, date string, body string, body_kind string, attachments array<struct<name: string, content: binary>>")


def attachment_names(attachments: DataFrame) -> DataFrame:
    """(doc_id, no, name) with safe: a clean base name, and _n before the extension of later ones of equal name."""
    from pyspark.sql import Window

    a = attachments.withColumn("__b", attachment_base(F.col("name")))
    a = a.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__b").orderBy("no")))
    dot = F.regexp_extract("__b", r"\A(.+?)(\.[^.]*)?\z", 1), F.regexp_extract("__b", r"\A(.+?)(\.[^.]*)?\z", 2)
    return a.select("doc_id", "no", "name", F.when(F.col("__n") == 1, F.col("__b")).otherwise(F.concat(dot[0], F.lit("_"), (F.col("__n") - 1).cast("string"), dot[1])).alias("safe"))
