"""Queries over bundle validation, quality rules, reviews and regression contracts, with faults planted by the keys of orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import chunk, diff, pages, quality, review, shapes, validate
from quireflow.operators.provenance import _locator
from quireflow.plans import fixtures
from quireflow.plans.registry import query, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "doc_id")


def _list(*items: str):
    return F.array(*map(F.lit, items)) if items else F.expr("cast(array() AS array<string>)")


@query("SELECT o_orderkey AS doc_id, 'ARTIFACT_MISSING' AS code, ['document.json', 'chunks.jsonl', 'manifest.json'][1 + o_orderkey % 3] AS subject FROM orders WHERE o_orderkey % 2 = 0")
def artifact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other bundle lacks a required artifact."""
    lost = fixtures.picked(F.col("doc_id"), "document.json", "chunks.jsonl", "manifest.json")
    have = _list("document.md", "document.json", "chunks.jsonl", "manifest.json", "conversion-report.json", "extra")
    o = _orders(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array_remove(have, lost)).otherwise(have).alias("names"))
    return validate.artifact_issues(o.select("doc_id", F.explode("names").alias("name")))


@query("""SELECT doc_id, 'SHA256_MISMATCH' AS code, CASE WHEN doc_id % 3 = 1 THEN 'short' ELSE sha256(text) END AS subject FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'SHA256_INVALID', 'short' FROM documents WHERE doc_id % 3 = 1""")
def hash_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("text", 256)
    d = table(spark, sf_dir, "documents")
    stated = d.select("doc_id", F.when(F.col("doc_id") % 3 == 1, "short").otherwise(h).alias("sha256"))
    return validate.hash_issues(stated, d.select("doc_id", F.when(F.col("doc_id") % 3 == 2, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(h).alias("sha256")))


@query("""WITH n AS (SELECT l_orderkey AS doc_id, count(*) AS n, count(*) FILTER (l_partkey % 4 <> 0) AS m FROM lineitem GROUP BY ALL)
  SELECT doc_id, 'ELEMENT_COUNT' AS code, (n + 1)::VARCHAR AS subject FROM n WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'CONTENT_ELEMENT_COUNT', (m + 1)::VARCHAR FROM n WHERE doc_id % 5 = 0""")
def count_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("paragraph").alias("type"), F.when(F.col("l_partkey") % 4 == 0, " ").otherwise("x").alias("content"))
    n = i.groupBy("doc_id").agg(F.count("*").alias("element_count"), F.sum((F.col("content") != " ").cast("long")).alias("content_element_count"))
    wrong = lambda c, k: (F.col(c) + F.when(F.col("doc_id") % k == 0, 1).otherwise(0)).alias(c)
    return validate.count_issues(n.select("doc_id", wrong("element_count", 3), wrong("content_element_count", 5)), i)


@query("""SELECT o_orderkey AS doc_id, ['', 'ASSET_MISSING', 'ASSET_PATH_ESCAPE', 'ASSET_PATH_ESCAPE'][1 + o_orderkey % 4] AS code, ['assets/./a.png', 'assets/b.png', '../a.png', '/a.png'][1 + o_orderkey % 4] AS subject FROM orders WHERE o_orderkey % 4 > 0""")
def asset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    refs = o.select("doc_id", fixtures.picked(F.col("doc_id"), "assets/./a.png", "assets/b.png", "../a.png", "/a.png").alias("target"))
    return validate.asset_issues(refs, o.select("doc_id", F.lit("assets/a.png").alias("path")))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 8 AS k FROM orders)
  SELECT doc_id, 'LOCATOR_PRECISION_INVALID' AS code, 'e' AS subject FROM o WHERE k IN (1, 2, 3) UNION ALL SELECT doc_id, 'LOCATOR_PRECISION_MISSING', 'e' FROM o WHERE k = 4 UNION ALL SELECT doc_id, 'LOCATOR_FIELD_INVALID', 'e' FROM o WHERE k IN (5, 6, 7)""")
def locator_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated precision against evidence, and fields: exact without cells, an unknown word, boxes of a page said to have none, no locator; pages and rows the wrong way round, a range that is none."""
    k = F.col("doc_id") % 8
    fmt = F.when(k.isin(3, 5), "pdf").when(k == 6, "csv").otherwise("xlsx")
    at = _locator(
        format=fmt, sheet_name=F.when(k.isin(0, 2, 7), "S"), cell_range=F.when(k.isin(0, 2), "A1:B2").when(k == 7, "1A"), page_start=F.when(k == 3, 1).when(k == 5, 3), page_end=F.when(k.isin(3, 5), 1), bboxes=F.when(k == 3, F.expr("array(array(0D, 0D, 1D, 1D))")),
        row_start=F.when(k == 6, 4), row_end=F.when(k == 6, 2),
    )
    stated = F.when(k == 2, "certain").when(k == 3, "page_only").when(k.isin(5, 6, 7), "range").otherwise("exact")
    e = _orders(spark, sf_dir).select("doc_id", F.lit("e").alias("id"), F.when(k != 4, at).alias("source_locator"), stated.alias("locator_precision"))
    return validate.precision_issues(e).unionByName(validate.locator_issues(e))


@query("""WITH i AS (SELECT l_orderkey AS doc_id, 'e' || l_linenumber AS id, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_linenumber - l_partkey % 2 + 1 END AS r FROM lineitem)
  SELECT doc_id, 'LAYOUT_READING_ORDER_INVALID' AS code, id AS subject FROM i WHERE r < 1 UNION ALL SELECT doc_id, 'LAYOUT_READING_ORDER_DUPLICATE', min(id) FROM i GROUP BY doc_id, r HAVING count(*) > 1""")
def layout_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("p").alias("parent_id"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("id"), F.when(p % 9 == 0, 0).otherwise(F.col("l_linenumber") - p % 2 + 1).alias("reading_order"))
    return validate.layout_issues(i)


@query("""SELECT doc_id, ['', 'CONTEXT_PREFIX_INCONSISTENT', 'EMBEDDING_TEXT_INCONSISTENT', 'EMBEDDING_TOO_LONG'][1 + doc_id % 4] AS code, 'c' AS subject FROM documents WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, 'EMBEDDING_TEXT_INCONSISTENT', 'c' FROM documents WHERE doc_id % 4 = 3""")
def embedding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes and embedding texts, a quarter each forged, cut off from their text, and too long."""
    k = F.col("doc_id") % 4
    c = chunk.with_context(table(spark, sf_dir, "documents").select("doc_id", F.lit("c").alias("chunk_id"), F.array("lang").alias("heading_path"), F.lit("short").alias("text")))
    c = c.withColumn("context_prefix", F.when(k == 1, "[forged]\n\n").otherwise(F.col("context_prefix")))
    text = F.when(k == 2, "else").when(k == 3, F.repeat(F.lit("x"), 2001)).otherwise(F.concat("context_prefix", "text"))
    return validate.context_issues(c.withColumn("embedding_text", text))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS k FROM orders)
  SELECT doc_id, 'TABLE_ID_UNSAFE' AS code, '../t' AS subject FROM o WHERE k = 1 UNION ALL SELECT doc_id, 'TABLE_CELL_OUT_OF_BOUNDS', 't' FROM o WHERE k = 2 UNION ALL SELECT doc_id, 'TABLE_SPAN_OVERLAP', 't' FROM o WHERE k = 3 UNION ALL SELECT doc_id, 'TABLE_REFERENCE_UNKNOWN', 'ghost' FROM o WHERE k = 4
  UNION ALL SELECT doc_id, 'TABLE_REFERENCE_UNKNOWN', 'ghost' FROM o WHERE k = 4""")
def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    o = _orders(spark, sf_dir)
    name = F.when(k == 1, "../t").otherwise("t")
    t = o.select("doc_id", name.alias("table_id"), F.lit(2).alias("n_rows"), F.lit(2).alias("n_columns"))
    own = F.when(k == 4, "ghost").otherwise(name)
    first = o.select("doc_id", own.alias("table_id"), F.lit(0).alias("row"), F.lit(0).alias("column"), F.lit(1).alias("rowspan"), F.when(k == 2, 3).when(k == 3, 2).otherwise(1).alias("colspan"), F.lit("v").alias("value"))
    second = o.select("doc_id", own.alias("table_id"), F.when(k == 3, 0).otherwise(1).alias("row"), F.lit(1).alias("column"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit("w").alias("value"))
    return validate.table_issues(t, first.unionByName(second))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS k FROM orders) SELECT doc_id, 'CHUNK_SCHEMA_INVALID' AS code, 'c:' || f AS subject FROM o, (VALUES (1, 'schema_version'), (2, 'chunk_index'), (3, 'char_count'), (4, 'element_ids'), (5, 'relation_types'), (5, 'locator_precision')) AS v(m, f) WHERE k = m
  UNION ALL SELECT doc_id, 'ELEMENT_SCHEMA_INVALID', 'e:' || f FROM o, (VALUES (1, 'type'), (2, 'confidence'), (3, 'content'), (4, 'ordinal')) AS v(m, f) WHERE k = m
  UNION ALL SELECT doc_id, 'DOCUMENT_SCHEMA_INVALID', doc_id || ':' || f FROM o, (VALUES (1, 'source_sha256'), (2, 'element_count')) AS v(m, f) WHERE k = m""")
def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of chunks, elements and documents that are not as they must be."""
    k = F.col("doc_id") % 6
    o = _orders(spark, sf_dir)
    v = lambda bad, wrong, right: F.when(k == bad, wrong).otherwise(right)
    one = _list("a")
    c = o.select(
        "doc_id", F.lit("c").alias("chunk_id"), v(1, F.lit("2.0"), F.lit("1.0")).alias("schema_version"), v(2, F.lit(0), F.lit(1)).alias("chunk_index"), v(3, F.lit(2001), F.lit(1)).alias("char_count"), v(4, F.lit(None).cast("array<string>"), one).alias("element_ids"), one.alias("heading_path"), F.lit("x").alias("text"),
        F.lit(1).alias("part_index"), F.lit(1).alias("part_count"), v(5, _list("likes"), _list("caption_of")).alias("relation_types"), v(5, F.lit("sure"), F.lit("exact")).alias("locator_precision"),
    )
    e = o.select("doc_id", F.lit("e").alias("id"), v(1, F.lit(""), F.lit("p")).alias("type"), v(2, F.lit(1.5), F.lit(0.5)).alias("confidence"), v(3, F.lit(None).cast("string"), F.lit("")).alias("content"), v(4, F.lit(-1), F.lit(0)).alias("ordinal"), one.alias("heading_path"), F.create_map(F.lit("a"), F.lit("b")).alias("properties"))
    d = o.select("doc_id", F.lit("1.0").alias("schema_version"), F.lit("f").alias("source_file"), v(1, F.lit("xyz"), F.sha2(F.lit("x"), 256)).alias("source_sha256"), F.lit("pdf").alias("file_type"), F.lit("document-root").alias("root_element_id"), v(2, F.lit(0), F.lit(1)).alias("element_count"), F.lit(0).alias("content_element_count"))
    return shapes.shape_issues(c, "chunk", "chunk_id").unionByName(shapes.shape_issues(e, "element")).unionByName(shapes.shape_issues(d, "document", "doc_id"))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k FROM orders) SELECT doc_id, unnest(CASE k WHEN 1 THEN ['HTML_TABLE_COUNT_MISMATCH'] WHEN 2 THEN ['HTML_MERGE_COUNT_MISMATCH'] WHEN 3 THEN ['HTML_METRICS_MISMATCH'] ELSE [] END) AS code FROM o""")
def html_metric_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pages against a table of two by two with one merged cell each."""
    k = F.col("doc_id") % 4
    o = _orders(spark, sf_dir)
    m = o.select("doc_id", F.when(k == 1, 2).otherwise(1).alias("table_count"), F.lit(1).alias("canonical_tables"), F.lit(1).alias("canonical_merges"), F.when(k == 2, 0).otherwise(1).alias("merged_anchor_count"), F.when(k == 3, 5).otherwise(4).alias("grid_cells"))
    t = o.select("doc_id", F.lit("t").alias("table_id"), F.lit(2).alias("n_rows"), F.lit(2).alias("n_columns"))
    c = o.select("doc_id", F.explode(F.array(F.lit(2), F.lit(1), F.lit(1))).alias("colspan"), F.lit(1).alias("rowspan"))
    return validate.html_metric_issues(m, t, c).drop("subject")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, count(*) AS n, count(*) FILTER (l_partkey % 3 = 0) AS a, count(*) FILTER (l_partkey % 3 = 1) AS f FROM lineitem GROUP BY ALL)
  SELECT doc_id, 'OCR_TABLE_METRICS_MISMATCH' AS code FROM c WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 'OCR_TABLE_ACCEPTED_COUNT_MISMATCH' FROM c WHERE doc_id % 3 = 2""")
def ocr_metric_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of candidates, a third with one too many, and accepted tables, a third with one too few."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), fixtures.picked(F.col("l_partkey"), "accepted", "fallback_to_text", "rejected").alias("decision"), F.lit(0.7).alias("confidence"))
    third = F.col("doc_id") % 3
    a = pages.assessment(i).withColumn("candidate_count", F.col("candidate_count") + F.when(third == 1, 1).otherwise(0)).withColumn("accepted_count", F.col("accepted_count") + F.when(third == 2, 1).otherwise(0))
    a = a.withColumn("candidate_count", F.col("candidate_count") + F.when(third == 2, 1).otherwise(0))
    return validate.ocr_metric_issues(a, i.filter("decision = 'accepted'").select("doc_id", F.lit("ocr_table_candidate").alias("origin"))).drop("subject")


#: A rule's code, the format and the column that trip it, and the value.
RULES = (
    ("FORMAT_EXTENSION_MISMATCH", "pdf", "mismatch", True), ("ENCRYPTION_CHECK_INCONCLUSIVE", "docx", "encryption_check", "unknown"), ("FORMULA_RESULT_UNAVAILABLE", "xlsx", "formula_cached_values_missing", 1), ("ENCODING_AMBIGUOUS", "markdown", "encoding_ambiguous", True),
    ("MIXED_PDF_MODE", "pdf", "page_mode", "mixed"), ("INCONSISTENT_TABLE_ROW_LENGTHS", "pdf", "table_row_consistency", "warning"), ("MULTI_COLUMN_LAYOUT_DETECTED", "pdf", "two_column_pages", 1), ("READING_ORDER_UNCERTAIN", "pdf", "overlapping_pairs", 1), ("TABLE_TEXT_ASSOCIATION_UNCERTAIN", "pdf", "two_column_table_pages", 1),
    ("VISUAL_FLOW_AMBIGUOUS", "pptx", "ambiguous_slides", 1), ("EMBEDDED_RASTER_TEXT_UNEXTRACTED", "pdf", "raster_pages", 1), ("OCR_TABLE_RECONSTRUCTION_UNTRUSTED", "image", "rejected_candidates", 1), ("GENERIC_FALLBACK_USED", "text", "engine", "generic_fallback"), ("HTML_TABLE_SPAN_INVALID", "html", "invalid_spans", 1),
    ("HTML_TABLE_SPAN_OVERLAP", "html", "overlapping_spans", 1), ("HTML_TABLE_EMPTY", "html", "empty_tables", 1), ("SMARTART_NOT_EXTRACTED", "pptx", "smartart_parts", 1), ("EMBEDDED_OLE_NOT_EXTRACTED", "pptx", "ole_objects", 1), ("CSV_INCONSISTENT_COLUMN_COUNT", "tsv", "row_widths", 2), ("INVALID_JSON_PRESERVED", "json", "json_valid", False),
    ("MERGED_CELLS_INCOMPLETE", "xlsx", "total_merged_ranges", 2), ("XLSX_CHART_NOT_RENDERED", "xlsx", "charts_found", 1), ("DOCX_NESTED_TABLE_FLATTENED", "docx", "nested_tables", 1),
)
_N = len(RULES) + 5
_CODES = "[" + ", ".join(f"'{r[0]}'" for r in RULES) + "]"


@query(f"""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % {_N} AS k FROM orders) SELECT doc_id, {_CODES}[1 + k] AS code FROM o WHERE k < {len(RULES)}
  UNION ALL SELECT doc_id, unnest(['MAIN_CONTENT_NOT_IDENTIFIED', 'BOILERPLATE_MAY_BE_INCLUDED']) FROM o WHERE k = {len(RULES)} UNION ALL SELECT doc_id, 'MIXED_PDF_MATERIAL_RASTER_OCR' FROM o WHERE k = {len(RULES) + 1}
  UNION ALL SELECT doc_id, unnest(['MISSING_WORD_SPACING', 'TESSERACT_FALLBACK_USED']) FROM o WHERE k = {len(RULES) + 2} UNION ALL SELECT doc_id, 'POSSIBLE_MOJIBAKE' FROM o WHERE k = {len(RULES) + 3}""")
def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that trip one rule each, rules that come in pairs, and one that trips none."""
    k = F.col("doc_id") % _N
    o = _orders(spark, sf_dir)
    kind, columns = F.lit("pdf"), {}
    for n, (_, fmt, column, value) in enumerate(RULES):
        kind = F.when(k == n, fmt).otherwise(kind)
        columns[column] = F.when(k == n, F.lit(value)).otherwise(columns[column]) if column in columns else F.when(k == n, F.lit(value))
    n = len(RULES)
    kind = F.when(k == n, "html").when(k == n + 2, "image").otherwise(kind)
    columns["raster_pages"] = F.when(k == n + 1, 1).otherwise(columns["raster_pages"])
    columns |= {"raster_read": k == n + 1, "main_confidence": F.when(k == n, "low"), "ocr_used": k == n + 2, "glued_pages": F.when(k == n + 2, 1), "tesseract_pages": F.when(k == n + 2, 1)}
    text = F.when(k == n + 3, "bad �").otherwise("text")
    return quality.warnings(o.select("doc_id", kind.alias("file_type"), text.alias("markdown"), *(c.alias(x) for x, c in columns.items()))).drop("evidence")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_partkey % 3 AS k FROM lineitem) SELECT doc_id, 'OCR_TABLE_REJECTED' AS code, count(*)::VARCHAR AS evidence FROM c WHERE k > 0 GROUP BY doc_id UNION ALL SELECT doc_id, 'OCR_TABLE_ORPHAN_TOKEN', count(*)::VARCHAR FROM c WHERE k = 2 GROUP BY doc_id""")
def candidate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(k == 0, "accepted").otherwise("fallback_to_text").alias("decision"), F.when(k == 2, _list("OCR_TABLE_ORPHAN_TOKEN", "OCR_TABLE_REJECTED")).otherwise(_list("OCR_TABLE_REJECTED")).alias("reason_codes"))
    return quality.candidate_warnings(c)


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per order: merged every other time, of three formats, with anchors every fifth time."""
    k = F.col("doc_id")
    grid = F.array_repeat(F.array(F.lit("abc"), F.lit("d")), (F.col("o_custkey") % 40 + 1).cast("int"))
    return _orders(spark, sf_dir).select("doc_id", F.lit("t").alias("table_id"), (k % 2 == 0).alias("merged"), fixtures.picked(k, "html", "xlsx", "docx").alias("source_format"), (k % 5 == 0).alias("has_anchors"), grid.alias("grid"), F.repeat(F.lit("m"), (F.col("o_custkey") % 900).cast("int")).alias("markdown"))


_REASONS = "CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'MERGED_TABLE_GEOMETRY_PRESENT,HTML_MERGED_TABLE_COMPLEX' ELSE 'MERGED_TABLE_GEOMETRY_PRESENT' END ELSE '' END"


@query(f"SELECT o_orderkey AS doc_id, 'table' AS target_type, 't' AS target_id, rtrim('EXPLICIT_USER_REQUEST,' || {_REASONS}, ',') AS reasons FROM orders")
def table_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as targets, with the reasons that their merged cells give, behind the user's own request."""
    t = review.requested(review.table_targets(_tables(spark, sf_dir)))
    return t.select("doc_id", "target_type", "target_id", F.array_join("reason_codes", ",").alias("reasons"))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS doc_id, (o_custkey % 40 + 1)::INT AS r, (o_custkey % 900)::INT AS m FROM orders),
  s AS (SELECT doc_id, r, m, 0 AS cuts, 64 + CASE WHEN r > 0 THEN r * 12 - 1 ELSE 0 END + m AS n FROM o UNION ALL
    SELECT doc_id, CASE WHEN r > 1 THEN r // 2 ELSE r END, CASE WHEN r > 1 OR m <= 200 THEN m ELSE 200 END, cuts + 1, 64 + (CASE WHEN r > 1 THEN r // 2 ELSE r END) * 12 - 1 + CASE WHEN r > 1 OR m <= 200 THEN m ELSE 200 END FROM s WHERE n > 400 AND (r > 1 OR m > 200))
  SELECT doc_id, n::BIGINT AS n_chars, r::BIGINT AS rows_kept, m::INT AS markdown_chars, cuts::INT AS n_truncations FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cuts DESC) = 1""")
def bounded_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets cut to 400 characters: rows are halved, then the text is cut."""
    b = review.bounded(review.table_targets(_tables(spark, sf_dir)), 400)
    return b.select("doc_id", "n_chars", "rows_kept", F.length("faithful_markdown").alias("markdown_chars"), F.size("truncations").alias("n_truncations"))


@query("""SELECT l_orderkey AS doc_id, 'advisory-c' || l_linenumber AS target_id, false AS projection_write_allowed FROM lineitem WHERE l_partkey % 3 <> 0""")
def advisory_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("candidate_id"), F.when(F.col("l_partkey") % 3 == 0, "accepted").otherwise("fallback_to_text").alias("decision"), _list("x").alias("reason_codes"))
    return review.advisory_targets(c).select("doc_id", "target_id", "projection_write_allowed")


@query(f"""WITH o AS (SELECT o_orderkey AS doc_id, o_custkey % 900 AS m, sha256(o_orderkey::VARCHAR) AS h, {_REASONS} AS r FROM orders),
  b AS (SELECT doc_id, r, m, r <> '' AND m <= 500 AS ok FROM o)
  SELECT doc_id, CASE WHEN r = '' THEN 'not_generated_no_actionable_targets' WHEN ok THEN 'generated' ELSE 'failed' END AS status, CASE WHEN r <> '' AND NOT ok THEN 'AI_REVIEW_CONTENT_TOO_LARGE' END AS error,
    CASE WHEN ok THEN 'ai-review-request-' || substr(sha256(doc_id::VARCHAR), 1, 16) END AS request_id, CASE WHEN ok THEN m::INT END AS markdown_chars FROM b""")
def review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of documents with merged tables; those with a target of over 500 characters fail."""
    t = _tables(spark, sf_dir)
    o = t.select("doc_id", F.lit("passed").alias("status"), F.lit(True).alias("valid"))
    e = review.eligibility(o, o.limit(0).select("doc_id", F.lit("x").alias("code")), t)
    docs = t.select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.lit("f").alias("fingerprint"))
    r = review.requests(e, review.table_targets(t), docs, target_limit=500)
    get = lambda p: F.get_json_object("request", p)
    return r.select("doc_id", "status", "error", get("$.request_id").alias("request_id"), F.length(get("$.targets[0].faithful_markdown")).alias("markdown_chars"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND strpos(text, 'e') > 0 THEN substr(text, 1, strpos(text, 'e') - 1) || '<E>' || substr(text, strpos(text, 'e') + 1) ELSE text END AS readable, sha256(text) AS canonical_sha256 FROM documents""")
def readable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of what a review replaces; the canonical text's hash stays."""
    d = table(spark, sf_dir, "documents")
    reviews = d.select("doc_id", F.lit("t").alias("target_id"), F.when(F.col("doc_id") % 2 == 0, "apply_projection").otherwise("no_change").alias("decision"), F.lit("e").alias("faithful_markdown"), F.lit("<E>").alias("readable_markdown"))
    return review.projected(d.select("doc_id", "text"), reviews)


@query("SELECT doc_id, replace(replace(text, chr(92), '/'), '~', chr(10)) AS body FROM (SELECT doc_id, replace(text, chr(10), '~') AS text FROM documents)")
def stable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without volatile columns, with one kind of line ends and slashes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", "\n", "\r\n"), "/", "\\\\").alias("body"), F.lit("now").alias("converted_at"), F.lit(7).alias("duration_ms"))
    s = diff.stable(d)
    return s if s.columns == ["doc_id", "body"] else s.limit(0)


@query("SELECT o_orderkey, o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_custkey % 2 = 0) AS same FROM orders")
def confidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal confidences, nearly equal ones of OCR records and of others, and different ones."""
    k = F.col("o_orderkey") % 3
    other = F.lit(0.5) + F.when(k == 0, 0.0).when(k == 1, 5e-7).otherwise(0.1)
    return table(spark, sf_dir, "orders").select("o_orderkey", diff.same_confidence(F.lit(0.5), other, F.col("o_custkey") % 2 == 0).alias("same"))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS k FROM orders) SELECT doc_id, 'table_added' AS category, '' AS field FROM o WHERE k = 0 UNION ALL SELECT doc_id, 'table_removed', '' FROM o WHERE k = 1 UNION ALL SELECT doc_id, 'table_dimensions_changed', 'dimensions' FROM o WHERE k = 2
  UNION ALL SELECT doc_id, 'merge_changed', 'merges' FROM o WHERE k = 3 UNION ALL SELECT doc_id, 'table_cell_changed', 'cells' FROM o WHERE k = 3""")
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    shape = lambda df, d, m, c: df.select("doc_id", F.lit("t").alias("table_id"), d.alias("dimensions"), m.alias("merges"), c.alias("cells"))
    o = _orders(spark, sf_dir)
    before = shape(o.filter(k != 0), F.lit("2x2"), F.lit("none"), F.lit("a,b"))
    after = shape(o.filter(k != 1), F.when(k == 2, "3x2").otherwise("2x2"), F.when(k == 3, "A1:B1").otherwise("none"), F.when(k == 3, "a,c").otherwise("a,b"))
    return diff.table_changes(before, after).select("doc_id", "category", "field")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'warning_added' ELSE 'warning_removed' END AS category FROM orders WHERE o_orderkey % 3 < 2")
def warning_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    o = _orders(spark, sf_dir)
    code = lambda x: F.explode(x).alias("code")
    return diff.warning_changes(o.select("doc_id", code(F.when(k == 1, _list("B", "C", "C")).otherwise(_list("C")))), o.select("doc_id", code(F.when(k == 0, _list("A", "C")).otherwise(_list("C")))))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders) SELECT CASE WHEN k = 1 THEN 'twice' ELSE o_orderkey::VARCHAR END AS case_id, unnest(CASE k WHEN 2 THEN ['no_fixture'] WHEN 3 THEN ['bounds'] ELSE [] END) AS error FROM o UNION ALL SELECT 'twice', 'duplicate'""")
def case_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    c = _orders(spark, sf_dir).select(F.when(k == 1, "twice").otherwise(F.col("doc_id").cast("string")).alias("case_id"), F.when(k == 2, "").otherwise("f").alias("fixture"), F.when(k == 3, 5).otherwise(1).alias("min_tables"), F.lit(2).alias("max_tables"))
    return diff.case_errors(c)


@query("""SELECT (l_orderkey % 50)::VARCHAR AS case_id, count(*) AS "rows", 'CROSS_FORMAT_NONDETERMINISTIC_RERUN' AS code FROM lineitem WHERE (l_orderkey % 50 = 7 AND l_linenumber % 2 = 0) OR l_orderkey % 50 = 9 GROUP BY 1""")
def reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of fifty cases: one with other values, one within the tolerance, one that lacks rows."""
    i = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("case_id"), "l_orderkey", "l_linenumber", F.lit("text").alias("content"), F.lit(0.5).alias("confidence"), F.lit(True).alias("ocr"))
    c = F.col("case_id")
    other = F.when((c == "7") & (F.col("l_linenumber") % 2 == 0), "else").otherwise(F.col("content"))
    second = i.filter(c != "9").withColumn("content", other).withColumn("confidence", F.when(c == "8", F.col("confidence") + 5e-7).otherwise(F.col("confidence")))
    return diff.rerun_mismatches(i.withColumn("started_at", F.lit("a")), second.withColumn("started_at", F.lit("b")), ["l_orderkey", "l_linenumber"], loose="confidence")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders) SELECT o_orderkey::VARCHAR AS case_id, unnest(CASE k WHEN 1 THEN ['BUNDLE_VALIDATION_FAILED'] WHEN 2 THEN ['HOST_REVIEW_REQUEST_MISSING'] WHEN 3 THEN ['WORKFLOW_REFERENCE_ERROR'] WHEN 4 THEN ['WORKFLOW_REASON_CODE_MISSING'] WHEN 5 THEN ['WORKFLOW_STATUS_MISMATCH']
  WHEN 6 THEN ['READABLE_PROJECTION_MISSING'] WHEN 7 THEN ['WORKFLOW_ROUTER_FAILED', 'READABLE_PROJECTION_SEMANTICS_MISSING'] ELSE [] END) AS code FROM o""")
def workflow_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a workflow that fall short in one way each."""
    k = F.col("doc_id") % 8
    o = _orders(spark, sf_dir).withColumn("case_id", F.col("doc_id").cast("string"))
    cases = o.select("case_id", _list("A").alias("required_reason_codes"), F.lit("generated").alias("expected_request_status"), F.lit("not_provided").alias("expected_review_status"), F.lit("rendered").alias("expected_projection_status"), _list("needle").alias("required_patterns"))
    asked = lambda c: F.when(k != 2, c)
    seen = o.select(
        "case_id", F.when(k == 7, _list("router")).otherwise(_list()).alias("failed_steps"), (k != 1).alias("valid"), F.lit("s").alias("source_sha256"), F.lit("f").alias("fingerprint"), asked(F.when(k == 3, "x").otherwise("s")).alias("request_sha256"), asked(F.lit("f")).alias("request_fingerprint"),
        asked(F.when(k == 4, _list("B")).otherwise(_list("A", "B"))).alias("request_codes"), F.when(k == 5, "none").otherwise("generated").alias("request_status"), F.lit("not_provided").alias("review_status"), F.lit("rendered").alias("projection_status"), F.when(k == 7, "hay").when(k != 6, "a needle").alias("readable"),
    )
    return diff.workflow_errors(cases, seen)
