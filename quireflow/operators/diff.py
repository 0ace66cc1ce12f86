"""Fingerprints, comparisons and contracts of corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.scalars import canonical_json

VOLATILE = frozenset("converted_at generated_at started_at finished_at duration duration_ms output_dir output_path hostname source_sha256 canonical_bundle_fingerprint request_id".split())
TOLERANCE = 1e-6


def stable(df: DataFrame) -> DataFrame:
    """Without volatile columns, line ends as LF and backslashes as slashes in strings."""
    text = lambda c: F.replace(F.regexp_replace(c, "\r\n?", "\n"), F.lit("\\"), F.lit("/")).alias(c)
    return df.select(*(text(c) if t == "string" else F.col(c) for c, t in df.dtypes if c not in VOLATILE))


def row_fingerprints(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and the SHA-256 of each row's canonical JSON."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.sha2(canonical_json(*rest), 256).alias("fingerprint"))


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: dict[str, str], added: str, removed: str, excerpt: int = 240) -> DataFrame:
    """category, keys, field, before, after: rows added and removed, and fields (column -> category) that changed. One full outer join."""
    b = before.select(*keys, F.struct(*fields).alias("__b"))
    a = after.select(*keys, F.struct(*fields).alias("__a"))
    j = b.join(a, list(keys), "full_outer")
    text = lambda c: F.substring(c.cast("string"), 1, excerpt)
    entry = lambda category, field, x, y: F.struct(F.lit(category).alias("category"), F.lit(field).alias("field"), x.alias("before"), y.alias("after"))
    null = F.lit(None).cast("string")
    own = [F.when(~F.col(f"__b.{f}").eqNullSafe(F.col(f"__a.{f}")), entry(category, f, text(F.col(f"__b.{f}")), text(F.col(f"__a.{f}")))) for f, category in fields.items()]
    found = F.when(F.col("__b").isNull(), F.array(entry(added, "", null, null))).when(F.col("__a").isNull(), F.array(entry(removed, "", null, null))).otherwise(F.array_compact(F.array(*own)))
    return j.select(*keys, F.explode(found).alias("x")).select(*keys, "x.category", "x.field", "x.before", "x.after")


def element_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    return changes(before, after, ("doc_id", "id"), {"type": "element_type_changed", "locator": "locator_changed", "heading_path": "heading_path_changed", "content": "content_changed"}, "element_added", "element_removed")


def table_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    return changes(before, after, ("doc_id", "table_id"), {"dimensions": "table_dimensions_changed", "merges": "merge_changed", "cells": "table_cell_changed"}, "table_added", "table_removed")


def warning_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, code, category of codes that only one side has. One aggregation of both sides, with two flags a code."""
    side = lambda df, old: df.select("doc_id", "code", F.lit(old).alias("__old"))
    both = side(before, True).unionByName(side(after, False)).groupBy("doc_id", "code").agg(F.bool_or("__old").alias("__b"), F.bool_and("__old").alias("__all"))
    lone = both.filter("NOT __b OR __all")
    return lone.select("doc_id", "code", F.when(F.col("__b"), "warning_removed").otherwise("warning_added").alias("category"))


def same_confidence(a: Column, b: Column, ocr: Column) -> Column:
    """Equal, or for OCR records within a tolerance."""
    return a.eqNullSafe(b) | F.coalesce(ocr & (F.abs(a - b) <= TOLERANCE), F.lit(False))


def against_baseline(now: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and verdict: same, changed, new or gone, by fingerprint."""
    j = now.select(*keys, F.col("fingerprint").alias("__n")).join(baseline.select(*keys, F.col("fingerprint").alias("__o")), list(keys), "full_outer")
    return j.select(*keys, F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "gone").when(F.col("__n") == F.col("__o"), "same").otherwise("changed").alias("verdict"))


def rerun_mismatches(first: DataFrame, second: DataFrame, keys: Sequence[str], case: str = "case_id", loose: str | None = None, ocr: str = "ocr") -> DataFrame:
    """(case, rows, code): cases of which two runs differ, by row: other values, a row that one run lacks, or one that comes more often.

    Volatile columns don't count. loose is a column of numbers that may differ by the tolerance where the column ocr is true.
    """
    w = Window.partitionBy(*keys).orderBy("fingerprint")

    def prints(df: DataFrame) -> DataFrame:
        df = stable(df)
        apart = [*keys, *(c for c in (case, ocr, loose) if c and c not in keys and c in df.columns)]
        return row_fingerprints(df, apart).withColumn("__k", F.row_number().over(w))

    x, y = prints(first), prints(second)
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "__k"]]
    j = x.alias("x").join(y.alias("y"), on, "full_outer")
    same = F.col("x.fingerprint").eqNullSafe(F.col("y.fingerprint"))
    if loose:
        same &= same_confidence(F.col(f"x.{loose}"), F.col(f"y.{loose}"), F.coalesce(F.col(f"x.{ocr}"), F.col(f"y.{ocr}")))
    return j.filter(~same).groupBy(F.coalesce(f"x.{case}", f"y.{case}").alias(case)).agg(F.count("*").alias("rows")).withColumn("code", F.lit("CROSS_FORMAT_NONDETERMINISTIC_RERUN"))


def workflow_errors(cases: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, code): what a workflow's run fell short of.

    cases: required_reason_codes, expected_request_status, expected_review_status, expected_projection_status, required_patterns.
    observed: failed_steps, valid, source_sha256, fingerprint, request_sha256, request_fingerprint, request_codes, request_status, review_status, projection_status, readable; null where there is no such artifact.
    """
    j = cases.join(observed, "case_id", "left")
    none = F.expr("cast(array() AS array<string>)")
    asked = F.col("request_sha256").isNotNull()
    when = lambda c, code: F.when(F.coalesce(c, F.lit(False)), F.lit(code))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    text = F.coalesce("readable", F.lit(""))
    codes = F.array(
        when(~F.coalesce("valid", F.lit(False)), "BUNDLE_VALIDATION_FAILED"), when(~asked, "HOST_REVIEW_REQUEST_MISSING"), when(asked & (differs("request_sha256", "source_sha256") | differs("request_fingerprint", "fingerprint")), "WORKFLOW_REFERENCE_ERROR"),
        when(asked & (F.size(F.array_except("required_reason_codes", F.coalesce("request_codes", none))) > 0), "WORKFLOW_REASON_CODE_MISSING"),
        when(differs("expected_request_status", "request_status") | differs("expected_review_status", "review_status") | differs("expected_projection_status", "projection_status"), "WORKFLOW_STATUS_MISMATCH"),
        when(F.col("readable").isNull(), "READABLE_PROJECTION_MISSING"), when(F.col("readable").isNotNull() & (~text.rlike(r"(?U)\S") | F.exists("required_patterns", lambda p: ~F.contains(text, p))), "READABLE_PROJECTION_SEMANTICS_MISSING"),
    )
    steps = F.transform(F.coalesce("failed_steps", none), lambda s: F.concat(F.lit("WORKFLOW_"), F.upper(s), F.lit("_FAILED")))
    return j.select("case_id", F.explode(F.array_distinct(F.concat(steps, F.array_compact(codes)))).alias("code"))


def contract_breaches(cases: DataFrame, observed: DataFrame) -> DataFrame:
    """case_id and breach of cases (required, allowed, forbidden codes, statuses, min_tables, max_tables) by what was observed (codes, status, n_tables)."""
    j = cases.join(observed, "case_id", "left")
    none = F.expr("cast(array() AS array<string>)")
    codes = F.coalesce("codes", none)
    found = F.concat(
        F.transform(F.array_except("required", codes), lambda c: F.concat(F.lit("missing:"), c)), F.transform(F.array_intersect("forbidden", codes), lambda c: F.concat(F.lit("forbidden:"), c)),
        F.transform(F.array_except(codes, F.concat("required", "allowed")), lambda c: F.concat(F.lit("unexpected:"), c)),
        F.when(~F.coalesce(F.array_contains("statuses", F.col("status")), F.lit(False)), F.array(F.lit("status"))).otherwise(none),
        F.when(~F.coalesce(F.col("n_tables").between(F.col("min_tables"), F.col("max_tables")), F.lit(False)), F.array(F.lit("tables"))).otherwise(none),
    )
    return j.select("case_id", F.explode(found).alias("breach"))


def case_errors(cases: DataFrame) -> DataFrame:
    """case_id and error of a manifest: repeated ids, no fixture, a minimum above the maximum."""
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("duplicate").alias("error"))
    none = cases.filter(F.coalesce(F.col("fixture"), F.lit("")) == "").select("case_id", F.lit("no_fixture").alias("error"))
    return twice.unionByName(none).unionByName(cases.filter("min_tables > max_tables").select("case_id", F.lit("bounds").alias("error")))


def regression_summary(results: DataFrame) -> DataFrame:
    """Counts of statuses by format."""
    return results.groupBy("format").pivot("status", ["passed", "passed_with_warnings", "failed"]).count().na.fill(0)
