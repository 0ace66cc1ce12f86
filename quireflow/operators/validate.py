"""Referential integrity of canonical tables: each check gives (doc_id, code, subject); no row means that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.scalars import a1_bounds, inside
from quireflow.lineage import stored
from quireflow.operators import model
from quireflow.operators.parts import dealt, parts
from quireflow.operators.tables import SAFE_ID, overlaps

INVERSE = {"caption_of": "captioned_by", "captioned_by": "caption_of", "note_for": "has_note", "has_note": "note_for"}


def issue(rows: DataFrame, code: str, subject: Column | str = "id") -> DataFrame:
    return rows.select("doc_id", F.lit(code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_ids(rows: DataFrame, code: str, column: str = "id") -> DataFrame:
    return issue(dealt(rows.select("doc_id", column), "doc_id", column).groupBy("doc_id", column).agg(F.count("*").alias("n")).filter("n > 1"), code, column)


def missing(refs: DataFrame, known: DataFrame, ref: str, column: str, code: str) -> DataFrame:
    """References to what does not exist. Without doc_id, known holds for all documents. Known keys are unbounded, so they are never broadcast."""
    k = known.select(F.col(column).alias("__k"), *([F.col("doc_id").alias("__d")] if "doc_id" in known.columns else [])).distinct().hint("merge")
    on = F.col(ref) == F.col("__k")
    return issue(refs.filter(F.col(ref).isNotNull()).join(k, on & (F.col("doc_id") == F.col("__d")) if "__d" in k.columns else on, "left_anti"), code, ref)


def element_issues(elements: DataFrame) -> DataFrame:
    """Ids, root, parents, reachability and cycles."""
    rings = stored(model.on_cycles(elements), "rings")
    roots = elements.filter(F.col("id") == model.ROOT)
    docs = elements.select("doc_id").distinct()
    return _union(
        duplicate_ids(elements, "ELEMENT_ID_DUPLICATE"),
        issue(docs.join(roots.select("doc_id"), "doc_id", "left_anti"), "ROOT_MISSING", F.lit(model.ROOT)),
        issue(roots.filter((F.col("type") != "document") | F.col("parent_id").isNotNull()), "ROOT_INVALID"),
        issue(elements.filter((F.col("id") != model.ROOT) & F.col("parent_id").isNull()), "PARENT_MISSING"),
        missing(elements, elements, "parent_id", "id", "PARENT_UNKNOWN"),
        issue(model.unreachable(elements, model.closure(elements, rings)), "ELEMENT_UNREACHABLE"),
        issue(rings, "ELEMENT_CYCLE"),
    )


def child_issues(elements: DataFrame) -> DataFrame:
    """child_ids against parents: listed children that point elsewhere, children that are not listed."""
    listed = elements.select("doc_id", F.col("id").alias("parent"), F.explode("child_ids").alias("child"))
    real = elements.filter(F.col("parent_id").isNotNull()).select("doc_id", F.col("parent_id").alias("parent"), F.col("id").alias("child"))
    on = ["doc_id", "parent", "child"]
    return _union(issue(listed.join(real, on, "left_anti"), "CHILD_BACK_REFERENCE", "child"), issue(real.join(listed, on, "left_anti"), "CHILD_NOT_LISTED", "child"))


def count_issues(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """Stated element counts against the elements there are."""
    content = (F.col("type") != "document") & (F.trim(F.coalesce("content", F.lit(""))) != "")
    real = elements.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(content.cast("long")).alias("m"))
    j = documents.join(real, "doc_id", "left")
    return _union(issue(j.filter(~F.col("element_count").eqNullSafe(F.coalesce("n", F.lit(0)))), "ELEMENT_COUNT", "element_count"), issue(j.filter(~F.col("content_element_count").eqNullSafe(F.coalesce("m", F.lit(0)))), "CONTENT_ELEMENT_COUNT", "content_element_count"))


def hash_issues(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    j = documents.alias("d").join(manifest.alias("m"), "doc_id", "left")
    differs = ~F.col("d.sha256").eqNullSafe(F.col("m.sha256"))
    return _union(issue(j.filter(differs), "SHA256_MISMATCH", F.col("d.sha256")), issue(j.filter(~F.coalesce(F.col("d.sha256"), F.lit("")).rlike(r"\A[0-9a-f]{64}\z")), "SHA256_INVALID", F.col("d.sha256")))


def chunk_issues(chunks: DataFrame, elements: DataFrame | None = None, limit: int = 2000) -> DataFrame:
    """Lengths, numbering, parts and element references."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id"))
    refs = chunks.select("doc_id", "chunk_id", F.explode("element_ids").alias("ref"))
    parts = [
        issue(chunks.filter(F.col("char_count") != F.length("text")), "CHUNK_CHAR_COUNT", "chunk_id"), issue(chunks.filter(F.length("text") > limit), "CHUNK_TOO_LONG", "chunk_id"),
        duplicate_ids(chunks, "CHUNK_ID_DUPLICATE", "chunk_id"), issue(chunks.withColumn("__r", rank).filter(F.col("__r") != F.col("chunk_index")), "CHUNK_INDEX_GAP", "chunk_id"),
        issue(chunks.filter((F.col("part_index") > F.col("part_count")) | (F.col("part_index") < 1)), "CHUNK_PART_INVALID", "chunk_id"),
        issue(chunks.filter(F.size(F.array_distinct("element_ids")) < F.size("element_ids")), "CHUNK_REFERENCE_DUPLICATE", "chunk_id"),
    ]
    if elements is not None:
        parts.append(missing(refs, elements, "ref", "id", "CHUNK_REFERENCE_UNKNOWN"))
    return _union(*parts)


def table_issues(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Ids, bounds of cells, overlapping spans, against stated dimensions. Cells meet tables once, for their bounds and for tables that don't exist."""
    known = tables.select(F.col("doc_id").alias("__d"), F.col("table_id").alias("__t"), "n_rows", "n_columns")
    placed = cells.filter(F.col("table_id").isNotNull()).select("doc_id", "table_id", "row", "column", "rowspan", "colspan")
    n = parts(known, placed)
    j = dealt(placed, "doc_id", "table_id", n=n).join(dealt(known, "__d", "__t", n=n).hint("merge"), (F.col("doc_id") == F.col("__d")) & (F.col("table_id") == F.col("__t")), "left")
    out = (F.col("row") < 0) | (F.col("column") < 0) | (F.col("row") + F.col("rowspan") > F.col("n_rows")) | (F.col("column") + F.col("colspan") > F.col("n_columns"))
    code = F.when(F.col("__t").isNull(), "TABLE_REFERENCE_UNKNOWN").when(out, "TABLE_CELL_OUT_OF_BOUNDS")
    return _union(
        issue(tables.filter(~F.col("table_id").rlike(SAFE_ID)), "TABLE_ID_UNSAFE", "table_id"), duplicate_ids(tables, "TABLE_ID_DUPLICATE", "table_id"),
        j.select("doc_id", code.alias("code"), F.col("table_id").cast("string").alias("subject")).filter("code IS NOT NULL"), issue(overlaps(cells), "TABLE_SPAN_OVERLAP", "table_id"),
    )


def precision_issues(rows: DataFrame) -> DataFrame:
    """locator_precision against the evidence that source_locator has."""
    at, p = F.col("source_locator"), F.col("locator_precision")
    has = lambda c: at[c].isNotNull()
    fmt = at["format"]
    evidence = F.coalesce(
        F.when(fmt == "xlsx", has("sheet_name") & has("cell_range")), F.when(fmt == "pptx", has("slide_number") & (has("shape_id") | has("shape_ids"))), F.when(fmt == "pdf", has("page_start") & has("page_end") & has("bboxes")),
        F.when(fmt == "csv", has("row_start") & has("row_end")), F.when(fmt == "json", has("json_path")), F.when(fmt == "eml", has("mime_part")), F.when(fmt == "html", F.coalesce(at["element_index"] >= 1, F.lit(False))), F.lit(False),
    )
    known = p.isin("exact", "range", "page_only", "derived", "unknown")
    wrong = ~known | ((p == "exact") & ~evidence) | ((fmt == "pdf") & (p == "page_only") & has("bboxes"))
    return _union(issue(rows.filter(p.isNotNull() & at.isNotNull() & wrong), "LOCATOR_PRECISION_INVALID"), issue(rows.filter((p != "unknown") & at.isNull()), "LOCATOR_PRECISION_MISSING"))


def locator_issues(rows: DataFrame) -> DataFrame:
    """Fields of locators: ranges the right way round, cell ranges that parse, slides and pages from 1."""
    at = F.col("source_locator")
    bad = F.coalesce(at["page_start"] < 1, F.lit(False)) | F.coalesce(at["page_start"] > at["page_end"], F.lit(False)) | F.coalesce(at["slide_number"] < 1, F.lit(False)) | F.coalesce(at["row_start"] > at["row_end"], F.lit(False)) | (at["cell_range"].isNotNull() & a1_bounds(at["cell_range"]).isNull())
    return issue(rows.filter(bad), "LOCATOR_FIELD_INVALID")


def layout_issues(rows: DataFrame) -> DataFrame:
    """reading_order: positive and one to a place among siblings."""
    twice = rows.groupBy("doc_id", "parent_id", "reading_order").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1 AND reading_order IS NOT NULL")
    return _union(issue(rows.filter("reading_order < 1"), "LAYOUT_READING_ORDER_INVALID"), issue(twice, "LAYOUT_READING_ORDER_DUPLICATE"))


def edge_issues(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges to oneself, to nothing, and without their inverse."""
    inverse = F.create_map(*(F.lit(x) for kv in INVERSE.items() for x in kv))
    there = edges.filter(F.col("src") != F.col("dst"))
    back = edges.select(F.col("doc_id").alias("__d"), F.col("src").alias("__s"), F.col("dst").alias("__t"), F.col("relation").alias("__r"))
    lone = there.filter(F.col("relation").isin(*INVERSE)).join(back, (F.col("doc_id") == F.col("__d")) & (F.col("src") == F.col("__t")) & (F.col("dst") == F.col("__s")) & (inverse[F.col("relation")] == F.col("__r")), "left_anti")
    return _union(issue(edges.filter(F.col("src") == F.col("dst")), "ASSOCIATION_SELF_REFERENCE", "src"), missing(there, elements, "dst", "id", "ASSOCIATION_TARGET_MISSING"), issue(lone, "ASSOCIATION_RECIPROCAL_MISSING", "src"))


def asset_issues(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """Local targets: absolute or leading out, or not among the document's assets."""
    r = refs.withColumn("__p", inside(F.col("target")))
    a = assets.select(F.col("doc_id").alias("__d"), F.col("path").alias("__a")).distinct()
    return _union(issue(r.filter("__p IS NULL"), "ASSET_PATH_ESCAPE", "target"), issue(r.filter("__p IS NOT NULL").join(a, (F.col("doc_id") == F.col("__d")) & (F.col("__p") == F.col("__a")), "left_anti"), "ASSET_MISSING", "target"))


def artifact_issues(artifacts: DataFrame, required: tuple[str, ...] = ("document.md", "document.json", "chunks.jsonl", "manifest.json", "conversion-report.json")) -> DataFrame:
    """Bundles without a required artifact."""
    wanted = artifacts.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, required))).alias("name"))
    return issue(wanted.join(artifacts.select("doc_id", "name"), ["doc_id", "name"], "left_anti"), "ARTIFACT_MISSING", "name")


def html_metric_issues(metrics: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """A page's counts against its tables and cells (table_id; rowspan, colspan): metrics has table_count, merged_anchor_count, canonical_tables, canonical_merges and grid_cells."""
    t = tables.groupBy("doc_id").agg(F.count("*").alias("tables"), F.sum(F.col("n_rows").cast("long") * F.col("n_columns")).alias("grid"))
    c = cells.groupBy("doc_id").agg(F.sum(((F.col("rowspan") > 1) | (F.col("colspan") > 1)).cast("long")).alias("merges"))
    j = metrics.join(t, "doc_id", "left").join(c, "doc_id", "left").na.fill(0, ["tables", "grid", "merges"])
    differ = lambda a, b, code: F.when(~F.coalesce(F.col(a), F.lit(0)).eqNullSafe(F.coalesce(F.col(b), F.lit(0))), F.lit(code))
    codes = F.array(
        differ("canonical_tables", "tables", "HTML_TABLE_COUNT_MISMATCH"), differ("table_count", "canonical_tables", "HTML_TABLE_COUNT_MISMATCH"), differ("canonical_merges", "merges", "HTML_MERGE_COUNT_MISMATCH"),
        differ("merged_anchor_count", "canonical_merges", "HTML_MERGE_COUNT_MISMATCH"), differ("grid_cells", "grid", "HTML_METRICS_MISMATCH"),
    )
    return j.select("doc_id", F.explode(F.array_distinct(F.array_compact(codes))).alias("code"), F.col("doc_id").cast("string").alias("subject"))


def ocr_metric_issues(assessment: DataFrame, tables: DataFrame) -> DataFrame:
    """Counts of table candidates against each other, and the accepted ones against the tables whose origin they are."""
    real = tables.filter(F.col("origin") == "ocr_table_candidate").groupBy("doc_id").agg(F.count("*").alias("accepted_tables"))
    j = assessment.join(real, "doc_id", "left").na.fill(0, ["accepted_tables"])
    counts = ("candidate_count", "accepted_count", "rejected_count", "fallback_to_text_count", "low_confidence_count")
    odd = F.greatest(*(F.coalesce(F.col(c) < 0, F.lit(True)) for c in counts))
    wrong = odd | (F.col("candidate_count") != F.col("accepted_count") + F.col("rejected_count")) | (F.col("fallback_to_text_count") > F.col("rejected_count"))
    codes = F.array(F.when(F.coalesce(wrong, F.lit(True)), F.lit("OCR_TABLE_METRICS_MISMATCH")), F.when(~odd & (F.col("accepted_tables") != F.col("accepted_count")), F.lit("OCR_TABLE_ACCEPTED_COUNT_MISMATCH")))
    return j.select("doc_id", F.explode(F.array_compact(codes)).alias("code"), F.col("doc_id").cast("string").alias("subject"))


def context_issues(chunks: DataFrame, limit: int = 2000) -> DataFrame:
    """Context prefix, embedding text and their counts against each other, and against the prefix derived anew."""
    from quireflow.operators.chunk import with_context

    again = with_context(chunks.drop("context_prefix", "context_truncated", "context_char_count", "embedding_text", "embedding_char_count"), limit).select("doc_id", "chunk_id", F.col("context_prefix").alias("__again"))
    j = chunks.join(again, ["doc_id", "chunk_id"])
    return _union(
        issue(chunks.filter(F.col("embedding_text") != F.concat("context_prefix", "text")), "EMBEDDING_TEXT_INCONSISTENT", "chunk_id"),
        issue(chunks.filter(F.length("embedding_text") > limit), "EMBEDDING_TOO_LONG", "chunk_id"), issue(j.filter(F.col("context_prefix") != F.col("__again")), "CONTEXT_PREFIX_INCONSISTENT", "chunk_id"),
    )


def statuses(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, status and n_errors."""
    n = issues.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.when(F.coalesce("n", F.lit(0)) == 0, "passed").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_errors"))
