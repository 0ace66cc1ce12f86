"""Splitting, coalescing and context of chunks."""

import pytest
from pyspark.sql import functions as F

from quireflow.operators import chunk, score

LENGTHS = (1, 50, 499, 999, 1500, 1900, 1999, 2000, 2001, 4200)


def parts(spark, *texts, limit=chunk.LIMIT):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    out = {i: [] for i in range(len(texts))}
    for r in chunk.text_chunks(df, limit).orderBy("doc_id", "chunk_index").collect():
        out[r.doc_id].append(r.text)
    return list(out.values())


def test_boundary_lengths(spark):
    for n, got in zip(LENGTHS, parts(spark, *("x" * n for n in LENGTHS)), strict=True):
        assert "".join(got) == "x" * n and all(len(p) <= 2000 for p in got) and len(got) == -(-n // 2000)


def test_context_leaves_room(spark):
    df = spark.createDataFrame([(1, f"chunk-{n}", ["A heading", "B"], "x" * min(n, 2000), "section-1") for n in LENGTHS], "doc_id LONG, chunk_id STRING, heading_path ARRAY<STRING>, text STRING, section_element_id STRING")
    for r in chunk.with_context(df).collect():
        assert len(r.embedding_text) <= 2000 and r.embedding_text.endswith(r.text) and r.embedding_text == r.context_prefix + r.text
        if len(r.text) < 1900:
            assert r.context_prefix.startswith("[heading_path: A heading > B]\n[section_element_id: section-1]") and not r.context_truncated
        elif len(r.text) == 2000:
            assert r.context_prefix == "" and r.context_truncated


def test_words_lines_and_paragraphs(spark):
    words, lines, blocks, null, blank = parts(spark, "ab " * 40, "aaaa\nbbbb\n" * 3, "a" * 8 + "\n\n" + "b" * 8 + "\n \n" + "c" * 30, None, " \n", limit=20)
    assert all(len(p) <= 20 for p in words + lines + blocks) and null == [] and blank == []
    assert " ".join(words).split() == ["ab"] * 40
    assert lines == ["aaaa\n\nbbbb\n\naaaa", "bbbb\n\naaaa\n\nbbbb"]
    assert blocks[0] == "aaaaaaaa\n\nbbbbbbbb" and "".join(blocks[1:]) == "c" * 30


def test_pipe_table_repeats_its_header(spark):
    table = "| h |\n| --- |\n" + "\n".join(f"| row {k} |" for k in range(9))
    (got,) = parts(spark, table, limit=50)
    assert len(got) > 1 and all(p.startswith("| h |\n| --- |\n") and len(p) <= 50 for p in got)
    assert [x for p in got for x in p.split("\n")[2:]] == table.split("\n")[2:]


ELEMENT = "doc_id LONG, id STRING, parent_id STRING, ordinal INT, type STRING, content STRING, heading_path ARRAY<STRING>"


def test_coalescing(spark):
    rows = [
        (1, "h", "root", 1, "heading", "# Top", []), (1, "a", "h", 2, "paragraph", "one", ["Top"]), (1, "b", "h", 3, "paragraph", "two", ["Top"]),
        (1, "c", "x", 4, "paragraph", "other parent", ["Top"]), (1, "d", "x", 5, "paragraph", "y" * 4100, ["Top"]), (1, "e", "x", 6, "paragraph", "last", ["Top"]), (2, "z", "root", 1, "paragraph", "alone", None),
    ]
    got = chunk.coalesced(spark.createDataFrame(rows, ELEMENT)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.element_ids, r.part_index, r.part_count) for r in got] == [(1, ["h"], 1, 1), (1, ["a", "b"], 1, 1), (1, ["c"], 1, 1), (1, ["d"], 1, 3), (1, ["d"], 2, 3), (1, ["d"], 3, 3), (1, ["e"], 1, 1), (2, ["z"], 1, 1)]
    assert got[0].heading_path == ["Top"] and got[1].text == "one\n\ntwo" and got[0].chunk_id == "chunk-00001"


def test_leaves(spark):
    rows = [(1, "root", None, 0, "document", "", []), (1, "h", "root", 1, "heading", "H", []), (1, "p", "h", 2, "paragraph", "text", []), (1, "q", "h", 3, "paragraph", "  ", [])]
    assert [r.id for r in chunk.leaves(spark.createDataFrame(rows, ELEMENT)).collect()] == ["p"]


def test_scorecard(spark):
    c = spark.createDataFrame([("a", "Same  text"), ("a", "same text"), ("a", "x" * 30), ("b", "straße"), ("b", "STRASSE")], "g STRING, text STRING")
    got = {r.g: r for r in score.scorecard(c, "g").collect()}
    assert (got["a"].chunk_count, got["a"].duplicate_chunks, got["a"].text_p95, got["b"].duplicate_chunks) == (3, 1, 30, 1)
    none = score.scorecard(c.limit(0)).collect()
    assert len(none) == 1 and none[0].chunk_count == 0 and none[0].locator_coverage is None


@pytest.mark.parametrize("limit", [7, 64])
def test_cut_lines_lose_nothing_but_blanks(spark, limit):
    text = "alpha beta gamma " * 5 + "w" * 150 + " omega"
    (got,) = spark.createDataFrame([(text,)], "t STRING").select(chunk.cut_line(F.col("t"), limit)).first()
    assert "".join(got).replace(" ", "") == text.replace(" ", "") and all(0 < len(p) <= limit for p in got)
