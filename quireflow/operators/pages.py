"""Pages that were read in two ways: text and scans put together, text of pictures laid over, headings told by their shape, counts of table candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.scalars import blank

RASTER = "-raster"


def block_type(content: Column) -> Column:
    """heading for a single line of at most 120 characters, else paragraph."""
    lines = F.filter(F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: ~blank(x))
    return F.when((F.size(lines) == 1) & (F.length(content) <= 120), "heading").otherwise("paragraph")


def merged_pages(digital: DataFrame, scanned: DataFrame) -> DataFrame:
    """Elements of both (doc_id, page, ordinal ...) in page order, numbered anew; on a page those with text come first."""
    both = digital.withColumn("__scan", F.lit(0)).unionByName(scanned.withColumn("__scan", F.lit(1)))
    return both.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "__scan", "ordinal"))).drop("__scan")


def overlaid_pages(pages: DataFrame, raster: DataFrame) -> DataFrame:
    """pages (doc_id, page, markdown) with what was read off their pictures (doc_id, page, markdown) behind a mark."""
    r = raster.select("doc_id", "page", F.col("markdown").alias("__read"))
    text = F.when(F.col("__read").isNotNull(), F.concat("markdown", F.lit("\n\n<!-- material-raster-ocr -->\n"), "__read")).otherwise(F.col("markdown"))
    return pages.join(r, ["doc_id", "page"], "left").withColumn("markdown", text).drop("__read")


def overlaid(elements: DataFrame, raster: DataFrame, tables: DataFrame) -> DataFrame:
    """elements and those read off pictures, but for pages: with ids of their own, below their page, and pointing at the tables' new ids.

    raster has doc_id, id, page, type, table_id; tables, those read off pictures, doc_id and table_id.
    """
    t = tables.select("doc_id", "table_id", F.concat("table_id", F.lit(RASTER)).alias("__new")).distinct()
    r = raster.filter("type <> 'page'").join(t, ["doc_id", "table_id"], "left").withColumn("table_id", F.coalesce("__new", "table_id")).drop("__new")
    r = r.withColumn("id", F.concat("id", F.lit(RASTER))).withColumn("parent_id", F.format_string("page-%04d", F.coalesce("page", F.lit(1))))
    return elements.unionByName(r.select(*elements.columns))


def overlaid_tables(tables: DataFrame, raster: DataFrame) -> DataFrame:
    return tables.unionByName(raster.withColumn("table_id", F.concat("table_id", F.lit(RASTER))).select(*tables.columns))


def assessment(candidates: DataFrame) -> DataFrame:
    """Per document what became of its table candidates (decision, confidence)."""
    n = lambda when, name: F.sum(F.when(when, 1).otherwise(0)).alias(name)
    accepted = F.col("decision") == "accepted"
    return candidates.groupBy("doc_id").agg(F.count("*").alias("candidate_count"), n(accepted, "accepted_count"), n(~accepted, "rejected_count"), n(F.col("decision") == "fallback_to_text", "fallback_to_text_count"), n(F.col("confidence") < 0.6, "low_confidence_count"))
