"""Queries that cover whole tables and whole texts, against brute force."""

import re

from quireflow.plans import catalog
from tests.conftest import DATA

TOKEN = r"https?://[^\s)\]>]+|\b\d{4}-\d{2}-\d{2}\b|\b\d{2,3}年\d{1,2}月\d{1,2}日|\btable-[A-Za-z0-9._-]+\b|\$[\d,]+(?:\.\d+)?|\b\d+(?:\.\d+)?%|\b\d+(?:\.\d+)?\b"


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_tokens_of_all_documents(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in catalog.queries()["token_preservation"](spark, DATA).collect()}
    assert set(got) == set(docs) and any(i % 2 for i in got)
    for i, d in docs.items():
        a, b = (re.findall(TOKEN, x, re.A) for x in (d.text, re.sub("[0-9]", "", d.text)))
        assert (got[i].n_tokens, got[i].n_lost) == (len(set(a)), len(set(a) - set(b)))


def test_context_of_all_chunks(spark):
    docs = documents(spark)
    chunks = {(r.doc_id, r.chunk_index): r.text for r in catalog.queries()["doc_chunks"](spark, DATA).collect()}
    rows = catalog.queries()["context_prefixes"](spark, DATA).collect()
    assert {(r.doc_id, r.chunk_index) for r in rows} == set(chunks) and len(rows) == len(chunks) > len(docs)
    for r in rows:
        d, text, kept = docs[r.doc_id], chunks[r.doc_id, r.chunk_index], []
        lines = [f"[heading_path: {d.lang} > {d.source}]", f"[section_element_id: doc-{d.doc_id}]"]
        for line in lines:
            if len("\n".join([*kept, line])) + 2 + len(text) <= 2000:
                kept.append(line)
        prefix = "\n".join(kept) + "\n\n" if kept else ""
        assert (r.context_prefix, r.context_truncated, r.embedding_char_count) == (prefix, kept != lines, len(prefix + text))


def test_escapes_of_whole_texts(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in catalog.queries()["text_flags"](spark, DATA).collect()}
    assert set(got) == set(docs) and max(len(d.text) for d in docs.values()) > 200
    for i, d in docs.items():
        assert got[i].html == d.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        assert got[i].pipe == re.sub("\r\n|\r|\n", "<br>", d.text.replace("|", "\\|"))


def test_shared_folder(spark):
    """What is stored is below the shared folder, as a URI, and can be cleaned away."""
    from pathlib import Path

    from quireflow import lineage

    df = lineage.stored(spark.range(3).toDF("x"))
    at = lineage.session_dir(spark)
    assert df.count() == 3 and at.startswith("file:") and all(f.startswith("file:") for f in df.inputFiles())
    lineage.clean(spark)
    assert not Path(at.removeprefix("file://").removeprefix("file:")).exists()
