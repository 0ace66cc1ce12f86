"""Quality rules: each a SELECT of warnings; their union gives a document's status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.scalars import blank, mojibake_count

#: Null figures in a converter's report count as absent.
n = lambda c: F.coalesce(F.col(c), F.lit(0))
flag = lambda c: F.coalesce(F.col(c), F.lit(False))
OCR = ("pdf", "image")


def _rules() -> dict[str, tuple[tuple[str, ...], Column, Column]]:
    ocr = flag("ocr_used")
    likely = F.coalesce(F.col("table_likelihood"), F.lit(0.0))
    return {
        "FORMAT_EXTENSION_MISMATCH": ((), flag("mismatch"), F.col("detected_by_magic")),
        "ENCRYPTION_CHECK_INCONCLUSIVE": ((), F.col("encryption_check") == "unknown", F.col("encryption_check")),
        "POSSIBLE_MOJIBAKE": ((), mojibake_count(F.col("markdown")) > 0, mojibake_count(F.col("markdown"))),
        "EMPTY_OUTPUT": ((), blank(F.col("markdown")), F.lit("empty_output")),
        "MERGED_CELLS_INCOMPLETE": (("xlsx",), n("total_merged_ranges") != n("merged_ranges_rendered"), n("merged_ranges_rendered")),
        "FORMULA_RESULT_UNAVAILABLE": (("xlsx",), n("formula_cached_values_missing") > 0, n("formula_cached_values_missing")),
        "XLSX_CHART_NOT_RENDERED": (("xlsx",), n("charts_found") > 0, n("charts_found")),
        "ENCODING_AMBIGUOUS": (("csv", "tsv", "json", "text", "markdown"), flag("encoding_ambiguous"), F.col("encoding")),
        "INVALID_JSON_PRESERVED": (("json",), ~F.coalesce(F.col("json_valid"), F.lit(True)), F.lit("json")),
        "MIXED_PDF_MODE": (("pdf",), F.col("page_mode") == "mixed", F.col("page_mode")),
        "LOW_OCR_CONFIDENCE_PAGES": (OCR, ocr & (n("low_confidence_pages") > 0), n("low_confidence_pages")),
        "MISSING_WORD_SPACING": (OCR, ocr & (n("glued_pages") > 0), n("glued_pages")),
        "TESSERACT_FALLBACK_USED": (OCR, ocr & (n("tesseract_pages") > 0), n("tesseract_pages")),
        "TABLE_STRUCTURE_UNVERIFIED": (OCR, ocr & (n("table_regions") == 0) & (likely >= 0.4), likely),
        "TABLE_STRUCTURE_HEURISTIC": (OCR, ocr & (n("table_regions") > 0), n("table_regions")),
        "INCONSISTENT_TABLE_ROW_LENGTHS": (("pdf",), F.col("table_row_consistency") == "warning", F.col("table_row_consistency")),
        "SMARTART_NOT_EXTRACTED": (("pptx",), n("smartart_parts") > 0, n("smartart_parts")),
        "EMBEDDED_OLE_NOT_EXTRACTED": (("pptx",), n("ole_objects") > 0, n("ole_objects")),
        "CSV_INCONSISTENT_COLUMN_COUNT": (("csv", "tsv"), n("row_widths") > 1, n("row_widths")),
        "MULTI_COLUMN_LAYOUT_DETECTED": (("pdf",), n("two_column_pages") > 0, n("two_column_pages")),
        "READING_ORDER_UNCERTAIN": (("pdf",), n("overlapping_pairs") > 0, n("overlapping_pairs")),
        "TABLE_TEXT_ASSOCIATION_UNCERTAIN": (("pdf",), n("two_column_table_pages") > 0, n("two_column_table_pages")),
        "VISUAL_FLOW_AMBIGUOUS": (("pptx",), n("ambiguous_slides") > 0, n("ambiguous_slides")),
        "MIXED_PDF_MATERIAL_RASTER_OCR": (("pdf",), (n("raster_pages") > 0) & flag("raster_read"), n("raster_pages")),
        "EMBEDDED_RASTER_TEXT_UNEXTRACTED": (("pdf",), (n("raster_pages") > 0) & ~flag("raster_read"), n("raster_pages")),
        "DOCX_NESTED_TABLE_FLATTENED": (("docx",), n("nested_tables") > 0, n("nested_tables")),
        "OCR_TABLE_RECONSTRUCTION_UNTRUSTED": (("image",), n("rejected_candidates") > 0, n("rejected_candidates")),
        "GENERIC_FALLBACK_USED": ((), F.col("engine") == "generic_fallback", F.col("engine")),
        "MAIN_CONTENT_NOT_IDENTIFIED": (("html",), F.col("main_confidence") == "low", F.col("main_strategy")),
        "BOILERPLATE_MAY_BE_INCLUDED": (("html",), F.col("main_confidence") == "low", F.col("main_strategy")),
        "BASE_URL_UNAVAILABLE": (("html",), n("unresolved_links") > 0, n("unresolved_links")),
        "RELATIVE_URL_UNRESOLVED": (("html",), n("unresolved_links") > 0, n("unresolved_links")),
        "HTML_TABLE_SPAN_INVALID": (("html",), n("invalid_spans") > 0, n("invalid_spans")),
        "HTML_TABLE_SPAN_OVERLAP": (("html",), n("overlapping_spans") > 0, n("overlapping_spans")),
        "HTML_TABLE_EMPTY": (("html",), n("empty_tables") > 0, n("empty_tables")),
    }


REPORT = "doc_id LONG, file_type STRING, engine STRING, failure STRING, markdown STRING, mismatch BOOLEAN, detected_by_magic STRING, encryption_check STRING, total_merged_ranges INT, merged_ranges_rendered INT, formula_cached_values_missing INT, charts_found INT, encoding_ambiguous BOOLEAN, encoding STRING, json_valid BOOLEAN, page_mode STRING, ocr_used BOOLEAN, low_confidence_pages INT, glued_pages INT, tesseract_pages INT, table_likelihood DOUBLE, table_regions INT, table_row_consistency STRING, smartart_parts INT, ole_objects INT, row_widths INT, two_column_pages INT, two_column_table_pages INT, overlapping_pairs INT, ambiguous_slides INT, raster_pages INT, raster_read BOOLEAN, nested_tables INT, rejected_candidates INT, main_confidence STRING, main_strategy STRING, unresolved_links INT, invalid_spans INT, overlapping_spans INT, empty_tables INT"


def full_report(report: DataFrame) -> DataFrame:
    """report with all columns the rules read; those it lacks are null."""
    from pyspark.sql import types as T

    have = set(report.columns)
    return report.select(*(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(REPORT).fields))


def warnings(report: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, code, evidence): one row for each rule that a document trips. One pass, no shuffle: rules are tried side by side."""
    rules = _rules()
    each = []
    for code in codes or rules:
        formats, when, evidence = rules[code]
        when = when & F.col("file_type").isin(*formats) if formats else when
        each.append(F.when(when & F.col("failure").isNull(), F.struct(F.lit(code).alias("code"), evidence.cast("string").alias("evidence"))))
    found = F.array_compact(F.array(*each))
    return full_report(report).select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.code", "w.evidence")


def candidate_warnings(candidates: DataFrame) -> DataFrame:
    """(doc_id, code, evidence): the reason codes of a document's rejected table candidates (decision, reason_codes), each once, with how many candidates have it."""
    each = candidates.filter(F.col("decision") != "accepted").select("doc_id", F.explode(F.array_distinct("reason_codes")).alias("code"))
    return each.groupBy("doc_id", "code").agg(F.count("*").cast("string").alias("evidence"))


def statuses(report: DataFrame) -> DataFrame:
    """doc_id, status, reason, n_warnings: failed, passed_with_warnings or passed. Any warning downgrades; empty output and a converter's failure fail."""
    w = warnings(report).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("code") == "EMPTY_OUTPUT").alias("empty"))
    d = full_report(report).select("doc_id", "failure").join(w, "doc_id", "left")
    failed = F.col("failure").isNotNull() | F.coalesce(F.col("empty"), F.lit(False))
    status = F.when(failed, "failed").when(F.coalesce(F.col("n"), F.lit(0)) > 0, "passed_with_warnings").otherwise("passed")
    return d.select("doc_id", status.alias("status"), F.coalesce("failure", F.when(failed, F.lit("empty_output"))).alias("reason"), F.coalesce("n", F.lit(0)).cast("long").alias("n_warnings"))
