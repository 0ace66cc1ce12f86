"""What the findings of round 2 were about: odd rows against the queries' SQL, and plans that stay bounded."""

import json
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quireflow.functions import scalars
from quireflow.operators import diff, parts, provenance, review, slides, tables, validate
from quireflow.plans import catalog
from quireflow.sources.slices import slices
from tests.conftest import DATA
from tests.test_queries import TABLES, rows

#: Two boxes from one corner line, and the width they share: a fifth of the smaller, which dividing and multiplying by the larger misses.
SHARE = (10, 35, 15, 15, 3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_ids_are_neither_multiplied_nor_broadcast(spark):
    p = plan(catalog.queries()["broken_refs"](spark, DATA))
    assert "Generate" not in p and "BroadcastHashJoin" not in p


def sql_agrees(spark, tmp_path, name, **given):
    """A query over small tables, given as SQL, against its SQL; the other tables are the smallest corpus's."""
    for t in TABLES:
        target = tmp_path / f"{t}.parquet"
        if t in given:
            duckdb.execute(f"COPY ({given[t]}) TO '{target}' (FORMAT parquet)")
        else:
            target.symlink_to(f"{DATA}/{t}.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = rows(catalog.queries()[name](spark, str(tmp_path)).toArrow())
    assert got == rows(con.sql(catalog.oracle_sql()[name]).to_arrow_table())
    return got[1]


def test_merged_locators_keep_their_file(spark):
    at = lambda k, f: provenance._locator(format=F.lit("docx"), source_file=F.lit(f), element_start=F.lit(k), element_end=F.lit(k))
    for second, file in (("f", "f"), ("g", None)):
        (m,) = spark.range(1).select(provenance.merged(F.array(at(1, "f"), at(2, second))).alias("m")).first().m.locators
        assert (m.element_start, m.element_end, m.source_file) == (1, 2, file)


def test_records_of_two_neighbours(spark, tmp_path):
    customers = "SELECT k::BIGINT AS c_custkey, 'name' AS c_name, k // 100 AS c_nationkey FROM (VALUES (1), (101), (102), (201), (203)) AS v(k)"
    assert len(sql_agrees(spark, tmp_path, "chunk_records", customer=customers)) == 2


def test_long_turns_stay_whole(spark, tmp_path):
    turns = "SELECT c::BIGINT AS conv_id, t::BIGINT AS turn, 'user' AS role, repeat('word ', n) || 'end' AS text FROM (VALUES (1, 1, 3), (1, 2, 900), (1, 3, 4), (1, 4, 5), (2, 1, 399), (2, 2, 400)) AS v(c, t, n)"
    assert len(sql_agrees(spark, tmp_path, "conversation_chunks", conversations=turns)) == 5


def test_a_share_of_exactly_a_fifth_overlaps(spark):
    w, h, width, height, shared = SHARE
    shapes = spark.createDataFrame([(1, 1, 1, "body", True, 0.0, 0.0, float(w), float(h)), (1, 1, 2, "body", True, float(w - shared), 0.0, float(w - shared + width), float(height))], "doc_id long, slide int, idx int, role string, material boolean, x0 double, y0 double, x1 double, y1 double")
    page = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id long, slide int, width double, height double")
    assert slides.flows(shapes, page).first().overlapping_pairs == 1
    assert {r.order_confidence for r in slides.plan(shapes, page).collect()} == {0.6}


def test_folding_is_by_text_not_by_character(spark):
    texts = [*scalars.FOLDS, "Straße GROß", "ﬁn ſtraße ΐ", "plain", "  a \t b\n", ""]
    d = spark.createDataFrame([(x,) for x in texts], "t string").select("t", scalars.comparable(F.col("t")).alias("c"))
    assert "transform(" not in plan(d)
    for r in d.collect():
        assert r.c == " ".join(r.t.split()).casefold()


#: Texts that are blank, begin or end with blanks, hold what Unicode has as a line end or white space, or have to be cut.
ODD = """SELECT row_number() OVER ()::BIGINT AS doc_id, t AS text, 'en' AS lang, 's' AS source, length(t)::BIGINT AS n_chars FROM (VALUES (' '), (chr(10)), (''), ('  a b  '), ('x' || chr(11) || 'y' || chr(28)), (chr(160) || 'n'), ('| a | b |' || chr(10) || '| --- | --- |'),
  (repeat('word ', 700)), ('  ' || repeat('word ', 700) || chr(10) || '   ' || chr(10) || chr(10) || ' tail '), (repeat('x', 4500)), (repeat('a' || chr(11) || 'b' || chr(133) || 'c' || chr(160) || 'd ', 400)), (repeat(' ', 2500) || 'z'),
  ('| a | b |' || chr(10) || '| --- | --- |' || chr(10) || repeat('| cell | cell |' || chr(10), 300)), (repeat('é' || chr(8232), 1500)), (repeat(chr(10), 2100)), (repeat('y', 1999) || ' z'), (repeat('y', 2000) || ' z'), (repeat('y', 999) || ' ' || repeat('z', 1500))) AS v(t)"""


@pytest.mark.parametrize("name", ["doc_chunks", "context_prefixes", "scorecard_rollup", "chunk_scorecard", "quality_status", "text_blocks"])
def test_odd_texts(spark, tmp_path, name):
    assert sql_agrees(spark, tmp_path, name, documents=ODD)


def test_warnings_are_compared_in_one_aggregation(spark):
    w = lambda *r: spark.createDataFrame(list(r), "doc_id long, code string")
    d = diff.warning_changes(w((1, "A"), (1, "B"), (1, "B"), (2, None)), w((1, "A"), (1, "A"), (1, "C"), (2, None), (3, "A")))
    assert "replicaterows" not in plan(d) and "Join" not in plan(d)
    assert sorted(map(tuple, d.collect())) == [(1, "B", "warning_removed"), (1, "C", "warning_added"), (3, "A", "warning_added")]


def test_slices_bound_results_and_read_equal_files_once():
    read = []
    batch = pd.DataFrame({"doc_id": range(450), "content": [b"a", b"b", None] * 150})
    sizes = []
    for part, once in slices(batch):
        assert [once(x, lambda k: read.append(k) or k) for x in part["content"]] == list(part["content"])
        sizes.append(len(part))
    assert sizes == [200, 200, 50] and len(read) == 9


@pytest.mark.parametrize("name", ["html_counts", "xlsx_blocks", "sheet_blocks"])
def test_files_are_read_in_one_pass(spark, name):
    p = plan(catalog.queries()[name](spark, DATA))
    assert "Join" not in p and p.count("MapInPandas") == (name != "sheet_blocks")


def test_blocks_of_sheets_with_gaps_and_copies(spark):
    cells = [(1, 1, 1), (1, 1, 1), (1, 2, 3), (1, 5, 1), (1, 5, 2), (2, 9, None), (2, 3, 3)]
    got = tables.sheet_blocks(spark.createDataFrame(cells, "sheet int, row int, column int"), "sheet")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 1, 1, 2), (1, 1, 2, 3, 3, 1), (1, 5, 5, 1, 2, 2), (2, 3, 3, 3, 3, 1)]


def part_origins(df):
    """What each shuffle of a plan is there for, and into how many parts."""
    return set(re.findall(r"hashpartitioning\([^)]*, (\d+)\), (\w+)", plan(df)))


@pytest.mark.parametrize("name", ["table_checks", "span_overlaps"])
def test_parts_of_tables_are_not_joined(spark, name):
    """Parts that Spark may join grow with the input; each shuffle has the number of parts it was given, and nothing is aggregated before it."""
    df = catalog.queries()[name](spark, DATA)
    assert {o for _, o in part_origins(df)} == {"REPARTITION_BY_NUM"}
    assert plan(df).count("SortMergeJoin") == (name == "table_checks") and "BroadcastHashJoin" not in plan(df)


def test_parts_follow_the_estimate_of_bytes(spark, monkeypatch):
    d = spark.read.parquet(f"{DATA}/orders.parquet")
    assert parts.parts(d) == 4 == parts.parts(spark.createDataFrame([(1,)], "a int"))
    monkeypatch.setattr(parts, "PART_BYTES", 1000)
    assert 10 < parts.parts(d) < parts.parts(d, d) <= 2 * parts.parts(d)
    assert parts.dealt(d, "o_orderkey").rdd.getNumPartitions() == parts.parts(d)


def test_tables_with_copies_gaps_and_nulls(spark):
    """Cells of tables stated twice count once a statement, cells of none are unknown, and null is no reference."""
    t = spark.createDataFrame([(1, "a", 2, 2), (1, "a", 1, 2), (1, "a", 2, 2), (2, "a", 2, 2), (2, None, 2, 2), (2, None, 2, 2), (None, "a", 2, 2), (3, "../b", 1, None)], "doc_id long, table_id string, n_rows int, n_columns int")
    at = [(1, "a", 1, 0, 1, 1), (1, "a", 0, 0, 3, 1), (2, "a", -1, 0, 1, 1), (2, "a", 0, 0, 2, 2), (2, "a", 0, 1, 1, 1), (2, None, 9, 9, 1, 1), (None, "a", 0, 0, 1, 1), (3, "../b", 1, 0, 1, 1), (3, "../b", 0, 9, 1, 1), (3, "c", 0, 0, 1, 1), (3, "c", 0, 0, 1, 1), (1, "a", None, 0, 1, 1)]
    cells = spark.createDataFrame([(*x, "v") for x in at], "doc_id long, table_id string, row int, column int, rowspan int, colspan int, value string")
    out = [(d, "TABLE_CELL_OUT_OF_BOUNDS", x) for d, x, n in ((1, "a", 4), (2, "a", 1), (3, "../b", 1)) for _ in range(n)]
    unknown = [(None, "TABLE_REFERENCE_UNKNOWN", "a"), (3, "TABLE_REFERENCE_UNKNOWN", "c"), (3, "TABLE_REFERENCE_UNKNOWN", "c")]
    other = [(1, "TABLE_ID_DUPLICATE", "a"), (2, "TABLE_ID_DUPLICATE", None), (3, "TABLE_ID_UNSAFE", "../b"), (1, "TABLE_SPAN_OVERLAP", "a"), (2, "TABLE_SPAN_OVERLAP", "a"), (3, "TABLE_SPAN_OVERLAP", "c")]
    assert sorted(map(repr, map(tuple, validate.table_issues(t, cells).collect()))) == sorted(map(repr, out + unknown + other))


def cut(grid, text, tid, limit):
    """The rounds of bounded(), one after the other, over the JSON itself."""
    rows, cuts = grid or [], []
    size = lambda: len(json.dumps({"canonical": {"grid": rows}, "faithful_markdown": text, "target_id": tid}, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    while size() > limit:
        if len(rows) > 1:
            rows = rows[: len(rows) // 2]
            cuts.append("grid_rows_reduced")
        elif len(text or "") > 200:
            text = text[:200]
            cuts.append("markdown_context_truncated")
        else:
            cuts.append("too_large")
            break
    return tid, size(), len(rows), text, cuts


#: Cells and texts that JSON writes longer than they are, or that have more bytes than characters.
CELLS = ["abc", "", None, 'a"b', "back\\slash", "\n\r\t\b\f", "\x00\x01\x1f", "\x7f\x85", "é漢字😀", "\u2028\u2029", "</script>&'/", " " * 9]


def test_targets_are_cut_as_the_rounds_would(spark):
    grids = [[], None, [[]], [[None]], [["x" * 500]], [["x" * 500], ["y"]], [[c] for c in CELLS], [CELLS] * 7, [CELLS[k % 12 :] for k in range(33)], [["a"]] * 64, [["a" * 90]] * 5]
    texts = ["", None, "m" * 200, "m" * 201, "😀" * 199 + '""', '"' * 201, "".join(c or "" for c in CELLS) * 8]
    given = [(k, tid, g, x) for k, (tid, g, x) in enumerate((tid, g, x) for tid in ("t", None, 'é"') for g in grids for x in texts)]
    d = spark.createDataFrame(given, "doc_id long, target_id string, grid array<array<string>>, faithful_markdown string")
    for limit in (60, 251, 252, 400, 655, 1200, 12000):
        got = {r.doc_id: tuple(r)[1:] for r in review.bounded(d, limit).collect()}
        assert got == {k: cut(g, x, tid, limit) for k, tid, g, x in given}


def test_targets_are_cut_without_python(spark):
    assert "InPandas" not in plan(catalog.queries()["bounded_targets"](spark, DATA))
