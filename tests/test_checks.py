"""Validation by mutation, layout, tables, review, diff, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from quireflow.functions import scalars
from quireflow.operators import chunk, diff, layout, model, quality, review, tables, validate
from quireflow.sources import sinks
from quireflow.streaming import ingest

ROOT = model.ROOT
ELEMENT = "doc_id LONG, id STRING, parent_id STRING, ordinal INT, type STRING, content STRING, place STRING"
CLEAN = [(1, ROOT, None, 0, "document", "", None), (1, "h", ROOT, 1, "heading", "# Top", None), (1, "s", "h", 2, "heading", "Sub", "7"), (1, "p", "s", 3, "paragraph", "text", None)]
CHUNK = "doc_id LONG, chunk_id STRING, chunk_index INT, part_index INT, part_count INT, text STRING, char_count INT, element_ids ARRAY<STRING>"
CHUNKS = [(1, "chunk-00001", 1, 1, 1, "ab", 2, ["h"]), (1, "chunk-00002", 2, 1, 1, "abc", 3, ["p"])]


def codes(issues):
    return sorted({r.code for r in issues.collect()})


def test_clean_corpus(spark):
    e = spark.createDataFrame(CLEAN, ELEMENT)
    assert codes(validate.element_issues(e)) == [] and codes(validate.child_issues(model.with_children(e))) == []
    assert codes(validate.chunk_issues(spark.createDataFrame(CHUNKS, CHUNK), e)) == []


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([*CLEAN, CLEAN[3]], ["ELEMENT_ID_DUPLICATE"]),
        (CLEAN[1:], ["ELEMENT_UNREACHABLE", "PARENT_UNKNOWN", "ROOT_MISSING"]),
        ([*CLEAN, (1, "q", "nobody", 4, "paragraph", "x", None)], ["ELEMENT_UNREACHABLE", "PARENT_UNKNOWN"]),
        ([*CLEAN, (1, "x", "y", 4, "paragraph", "x", None), (1, "y", "x", 5, "paragraph", "y", None)], ["ELEMENT_CYCLE", "ELEMENT_UNREACHABLE"]),
        ([(1, ROOT, None, 0, "page", "", None), *CLEAN[1:]], ["ROOT_INVALID"]),
    ],
)
def test_mutated_elements(spark, rows, expected):
    assert codes(validate.element_issues(spark.createDataFrame(rows, ELEMENT))) == expected


@pytest.mark.parametrize(
    ("field", "value", "expected"),
    [(6, 9, "CHUNK_CHAR_COUNT"), (1, "chunk-00001", "CHUNK_ID_DUPLICATE"), (2, 5, "CHUNK_INDEX_GAP"), (3, 2, "CHUNK_PART_INVALID"), (7, ["p", "p"], "CHUNK_REFERENCE_DUPLICATE"), (7, ["ghost"], "CHUNK_REFERENCE_UNKNOWN")],
)
def test_mutated_chunks(spark, field, value, expected):
    bad = list(CHUNKS[1])
    bad[field] = value
    got = codes(validate.chunk_issues(spark.createDataFrame([CHUNKS[0], tuple(bad)], CHUNK), spark.createDataFrame(CLEAN, ELEMENT)))
    assert got == [expected]


def test_context_is_derived_anew(spark):
    c = chunk.with_context(spark.createDataFrame([(1, "chunk-00001", ["Top"], "text")], "doc_id LONG, chunk_id STRING, heading_path ARRAY<STRING>, text STRING"))
    assert codes(validate.context_issues(c)) == []
    forged = c.withColumn("context_prefix", F.lit("[heading_path: Other]\n\n")).withColumn("embedding_text", F.concat("context_prefix", "text"))
    assert codes(validate.context_issues(forged)) == ["CONTEXT_PREFIX_INCONSISTENT"]
    assert codes(validate.context_issues(c.withColumn("embedding_text", F.lit("else")))) == ["EMBEDDING_TEXT_INCONSISTENT"]


def test_edges_assets_and_artifacts(spark):
    e = spark.createDataFrame(CLEAN, ELEMENT)
    edge = "doc_id LONG, src STRING, relation STRING, dst STRING"
    assert codes(validate.edge_issues(spark.createDataFrame([(1, "h", "caption_of", "p"), (1, "p", "captioned_by", "h")], edge), e)) == []
    assert codes(validate.edge_issues(spark.createDataFrame([(1, "h", "caption_of", "p")], edge), e)) == ["ASSOCIATION_RECIPROCAL_MISSING"]
    assert codes(validate.edge_issues(spark.createDataFrame([(1, "h", "caption_of", "h")], edge), e)) == ["ASSOCIATION_SELF_REFERENCE"]
    refs = spark.createDataFrame([(1, "assets/a.png"), (1, "../a.png"), (1, "/etc/a"), (1, "assets/x/../b.png")], "doc_id LONG, target STRING")
    got = sorted((r.code, r.subject) for r in validate.asset_issues(refs, spark.createDataFrame([(1, "assets/a.png")], "doc_id LONG, path STRING")).collect())
    assert got == [("ASSET_MISSING", "assets/x/../b.png"), ("ASSET_PATH_ESCAPE", "../a.png"), ("ASSET_PATH_ESCAPE", "/etc/a")]
    have = [(1, n) for n in ("document.md", "document.json", "chunks.jsonl", "manifest.json")]
    assert [r.subject for r in validate.artifact_issues(spark.createDataFrame(have, "doc_id LONG, name STRING")).collect()] == ["conversion-report.json"]


def test_paths_and_inheritance(spark):
    e = spark.createDataFrame(CLEAN, ELEMENT)
    paths = {r.id: r.heading_path for r in model.heading_paths(e).collect()}
    assert paths == {ROOT: [], "h": [], "s": ["Top"], "p": ["Top", "Sub"]}
    assert {r.id: r.place for r in model.inherited(e, "place").collect()} == {ROOT: None, "h": None, "s": "7", "p": "7"}
    assert {r.id: r.nearest_id for r in model.nearest(e, ("heading",)).collect()}["p"] == "s"


def chain(n, doc=1):
    return [(doc, ROOT, None, 0, "document", "", None)] + [(doc, f"e{k}", ROOT if k == 0 else f"e{k - 1}", k + 1, "paragraph", "x", None) for k in range(n)]


def test_deep_trees(spark):
    deep = spark.createDataFrame(chain(150), ELEMENT)
    far = model.closure(deep).filter("id = 'e149'").agg(F.max("distance"), F.count("*")).first()
    assert tuple(far) == (150, 150) and codes(validate.element_issues(deep)) == []


def test_very_deep_trees(spark):
    """5000 levels: no cycle as a chain, all on one as a ring."""
    ring = [r if r[1] != "e0" else (2, "e0", "e4999", 1, "paragraph", "x", None) for r in chain(5000, 2)]
    got = model.on_cycles(spark.createDataFrame(chain(5000) + ring, ELEMENT)).groupBy("doc_id").count().collect()
    assert [tuple(r) for r in got] == [(2, 5000)]


@pytest.mark.parametrize("n", [1, 3])
def test_cycles_with_tails(spark, n):
    """Only the elements of a cycle are on it; all that lead to it are unreachable, and their ancestors end where it begins."""
    ring = [(2, f"r{k}", f"r{(k + 1) % n}", k, "paragraph", "x", None) for k in range(n)]
    tail = [(2, f"t{k}", "r0" if k == 0 else f"t{k - 1}", 100 + k, "paragraph", "x", None) for k in range(9)]
    e = spark.createDataFrame(chain(20) + [(2, ROOT, None, 0, "document", "", None), *ring, *tail], ELEMENT)
    assert {(r.doc_id, r.id) for r in model.on_cycles(e).collect()} == {(2, f"r{k}") for k in range(n)}
    assert {r.id for r in model.unreachable(e).collect()} == {r[1] for r in ring + tail}
    up = model.closure(e).filter("doc_id = 2").collect()
    assert {(r.id, r.ancestor_id, r.distance) for r in up} == {(f"t{k}", f"t{j}", k - j) for k in range(9) for j in range(k)} | {(f"t{k}", "r0", k + 1) for k in range(9)}


CELL = "doc_id LONG, table_id STRING, row INT, column INT, value STRING, rowspan INT, colspan INT, is_header BOOLEAN"


def test_tables(spark):
    c = spark.createDataFrame([(1, "table-1", 0, 0, "a|b", 1, 2, True), (1, "table-1", 1, 0, 'c"\n,', 1, 1, False), (1, "table-1", 1, 1, "<d>", 1, 1, False)], CELL)
    rows = tables.expanded(c)
    names = rows.columns
    rows = rows if "row" in names else rows.withColumnRenamed("r", "row")
    assert tables.pipe_tables(rows).first().text == '| a\\|b | a\\|b |\n| --- | --- |\n| c"<br>, | <d> |'
    assert tables.csv_tables(rows).first().text == 'a|b,a|b\r\n"c""\n,",<d>\r\n'
    assert '<td colspan="2">a|b</td>' in tables.html_tables(c).first().text and "&lt;d&gt;" in tables.html_tables(c).first().text
    t = spark.createDataFrame([(1, "table-1", 2, 2)], "doc_id LONG, table_id STRING, n_rows INT, n_columns INT")
    assert codes(validate.table_issues(t, c)) == []
    assert codes(validate.table_issues(t, c.withColumn("rowspan", F.lit(2)))) == ["TABLE_CELL_OUT_OF_BOUNDS", "TABLE_SPAN_OVERLAP"]


def test_two_columns(spark):
    boxes = [(1, 1, k, 40.0 if k % 2 == 0 else 330.0, 100.0 + 50 * (k // 2), 270.0 if k % 2 == 0 else 560.0, 140.0 + 50 * (k // 2), f"b{k}") for k in range(8)]
    boxes.append((1, 1, 8, 40.0, 20.0, 560.0, 50.0, "title"))
    blocks = spark.createDataFrame(boxes, "doc_id LONG, page INT, idx INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, text STRING")
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id LONG, page INT, page_width DOUBLE, page_height DOUBLE")
    assert layout.column_layout(blocks, pages).first().two_columns
    assert [r.idx for r in layout.reading_order(blocks, pages).orderBy("reading_order").collect()] == [8, 0, 2, 4, 6, 1, 3, 5, 7]
    single = blocks.filter("idx % 2 = 0")
    assert [r.idx for r in layout.reading_order(single, pages).orderBy("reading_order").collect()] == [8, 0, 2, 4, 6]


def boxes(spark, words):
    rows = [(1, 1, k, float(x), float(y), t, 0.9) for k, (x, y, t) in enumerate(words)]
    return spark.createDataFrame(rows, "doc_id LONG, page INT, idx INT, x DOUBLE, y DOUBLE, text STRING, conf DOUBLE")


def test_table_gate(spark):
    grid = boxes(spark, [(x, 20 * r, f"{r}{c}") for r in range(5) for c, x in enumerate((10, 110, 210))])
    r = layout.table_gate(grid).first()
    assert (r.decision, r.columns, r.rows, r.reason_codes) == ("accepted", 3, 5, ["OCR_TABLE_CANDIDATE_ACCEPTED"])
    pairs = layout.table_gate(boxes(spark, [(10, 20 * k, f"Name {k}: value") for k in range(5)])).first()
    assert pairs.decision == "fallback_to_text" and "OCR_TABLE_KEY_VALUE_PATTERN" in pairs.reason_codes
    assert layout.page_text(grid).first().text.split("\n")[0] == "00 01 02"


def test_quality(spark):
    rows = [(1, "text", "fine", None), (2, "text", " ", None), (3, "json", "bad � byte", None), (4, "pdf", "x", "password_protected")]
    report = spark.createDataFrame(rows, "doc_id LONG, file_type STRING, markdown STRING, failure STRING")
    assert {r.doc_id: (r.status, r.reason) for r in quality.statuses(report).collect()} == {1: ("passed", None), 2: ("failed", "empty_output"), 3: ("passed_with_warnings", None), 4: ("failed", "password_protected")}


def test_tokens_and_predicates(spark):
    df = spark.createDataFrame([("See https://e.org/a 2024-01-31, table-2, $1,200.50 and 12%", "ok"), ("a javascript: link", "bad")], "t STRING, k STRING")
    r = {x.k: x for x in df.select("k", scalars.protected_tokens(F.col("t")).alias("tokens"), scalars.unsafe(F.col("t")).alias("unsafe")).collect()}
    assert r["ok"].tokens == ["https://e.org/a", "2024-01-31", "table-2", "$1,200.50", "12%"] and not r["ok"].unsafe and r["bad"].unsafe
    lost = spark.createDataFrame([("12% of 7", "12% of")], "a STRING, b STRING").select(review.lost_tokens(F.col("a"), F.col("b"))).first()[0]
    assert lost == ["7"]


@pytest.mark.parametrize(("label", "bounds"), [("A1:C3", (1, 1, 3, 3)), ("AA10", (27, 10, 27, 10)), ("$B$2:XFD9", (2, 2, 16384, 9)), ("1A", None)])
def test_a1(spark, label, bounds):
    got = spark.createDataFrame([(label,)], "c STRING").select(scalars.a1_bounds(F.col("c"))).first()[0]
    assert (tuple(got) if got else None) == bounds


def test_changes(spark):
    kind = "doc_id LONG, code STRING"
    got = diff.warning_changes(spark.createDataFrame([(1, "A"), (1, "B")], kind), spark.createDataFrame([(1, "B"), (1, "C")], kind))
    assert sorted((r.category, r.code) for r in got.collect()) == [("warning_added", "C"), ("warning_removed", "A")]
    prints = lambda *x: spark.createDataFrame(list(x), "case_id STRING, fingerprint STRING")
    verdicts = diff.against_baseline(prints(("a", "1"), ("b", "2"), ("c", "3")), prints(("a", "1"), ("b", "9"), ("d", "4")), ["case_id"])
    assert {r.case_id: r.verdict for r in verdicts.collect()} == {"a": "same", "b": "changed", "c": "new", "d": "gone"}


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame(CHUNKS, CHUNK)
    sinks.write_bundle({"chunks": c}, str(tmp_path / "out"), partition="doc_id")
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 2
    sinks.write_chunks(c.withColumn("heading", F.lit(None).cast("string")), str(tmp_path / "jsonl"))
    assert all('"heading":null' in r.value for r in spark.read.text(str(tmp_path / "jsonl")).collect())
    with pytest.raises(ValueError):
        sinks.write_bundle({"chunks": c}, str(tmp_path), source=str(tmp_path / "in/a.txt"))


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 2500, "en", "s", 2500), (2, "short", "en", "s", 5)], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"))
    ingest.convert_stream(stream, chunk.text_chunks, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == chunk.text_chunks(docs).count() == 3


def test_paragraphs(spark):
    at = [(40, 100, 300, 112), (40, 116, 280, 128), (40, 132, 290, 144), (40, 200, 300, 212), (330, 104, 560, 116), (330, 120, 560, 132), (290, 136, 330, 148)]
    lines = spark.createDataFrame([(1, 1, k, *map(float, b), "x") for k, b in enumerate(at)], "doc_id LONG, page INT, idx INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, text STRING")
    got = {r.idx: r.paragraph for r in layout.paragraphs(lines).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 4: 2, 5: 2, 6: 3, 3: 4}  # too far below, too little aligned: a paragraph of its own
