"""What each canonical table's rows must look like, as predicates by column: a violation is a row of (doc_id, code, subject)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.scalars import RELATIONS, SAFE_ID

PRECISIONS = ("exact", "range", "page_only", "derived", "unknown")
Test = Callable[[Column], Column]

text: Test = lambda c: c.isNotNull()
filled: Test = lambda c: c.isNotNull() & (c != "")
version: Test = lambda c: c.eqNullSafe(F.lit("1.0"))
digest: Test = lambda c: c.isNull() | c.rlike(r"\A[0-9a-f]{64}\z")
share: Test = lambda c: c.isNull() | c.between(0, 1)
precision: Test = lambda c: c.isNull() | c.isin(*PRECISIONS)
short: Test = lambda c: c.isNull() | (F.length(c) <= 2000)
names: Test = lambda c: c.isNull() | (F.forall(c, lambda x: x.isNotNull() & (x != "")) & (F.size(F.array_distinct(c)) == F.size(c)))
strings: Test = lambda c: c.isNotNull() & F.forall(c, lambda x: x.isNotNull())


def at_least(n: int) -> Test:
    return lambda c: c.isNotNull() & (c >= n)


def size(c: Column) -> Column:
    return c.isNotNull() & c.between(0, 2000)


#: Columns that must be there, and those that may be, with what must hold for each of their values.
REQUIRED: dict[str, dict[str, Test]] = {
    "document": {"schema_version": version, "source_file": text, "source_sha256": digest, "file_type": text, "root_element_id": text, "element_count": at_least(1), "content_element_count": at_least(0)},
    "element": {"id": filled, "type": filled, "content": text, "heading_path": strings, "confidence": share, "properties": text, "ordinal": at_least(0)},
    "table": {"schema_version": version, "table_id": lambda c: c.isNotNull() & c.rlike(SAFE_ID), "source_format": text, "n_rows": at_least(0), "n_columns": at_least(0), "confidence": share, "merged": text},
    "cell": {"row": at_least(0), "column": at_least(0), "rowspan": at_least(1), "colspan": at_least(1)},
    "chunk": {"schema_version": version, "chunk_id": text, "chunk_index": at_least(1), "heading_path": strings, "element_ids": strings, "text": text, "char_count": size, "part_index": at_least(1), "part_count": at_least(1)},
}
OPTIONAL: dict[str, dict[str, Test]] = {
    "document": {},
    "element": {"locator_precision": precision},
    "table": {},
    "cell": {},
    "chunk": {
        "consumer_contract_version": version, "source_sha256": digest, "locator_precision": precision, "ancestor_element_ids": names, "related_element_ids": names, "layout_region_ids": names, "layout_zones": names, "layout_order_methods": names, "context_element_ids": names,
        "relation_types": lambda c: names(c) & F.coalesce(F.forall(c, lambda x: x.isin(*RELATIONS)), F.lit(True)), "context_policy": lambda c: c.eqNullSafe(F.lit("source_text_priority_v1")), "context_prefix": short, "context_char_count": size, "context_truncated": text, "embedding_text": short, "embedding_char_count": size,
    },
}


def shape_issues(rows: DataFrame, kind: str, subject: str = "id") -> DataFrame:
    """Rows of a table of this kind whose columns are not as they must be: one issue a column, in one pass. A required column that the table lacks is wrong in each row."""
    tests = REQUIRED[kind] | {c: t for c, t in OPTIONAL[kind].items() if c in rows.columns}
    wrong = F.array_compact(F.array(*(F.when(~F.coalesce(t(F.col(c)), F.lit(False)), F.lit(c)) if c in rows.columns else F.lit(c) for c, t in tests.items())))
    each = rows.select("doc_id", F.coalesce(F.col(subject).cast("string"), F.lit("?")).alias("__subject"), F.explode(wrong).alias("__column"))
    return each.select("doc_id", F.lit(f"{kind.upper()}_SCHEMA_INVALID").alias("code"), F.concat_ws(":", "__subject", "__column").alias("subject"))
