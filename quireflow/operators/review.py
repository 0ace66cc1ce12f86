"""Review eligibility, requests, validation of reviews, and readable projections."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.scalars import protected_tokens, reviewable, unsafe

RECOMMENDED = ("MERGED_TABLE_GEOMETRY_PRESENT", "HTML_MERGED_TABLE_COMPLEX", "OCR_TABLE_LOW_CONFIDENCE", "OCR_TABLE_GEOMETRY_UNAVAILABLE", "EXPLICIT_USER_REQUEST")
OPTIONAL = ("OCR_TABLE_IRREGULAR_ROWS", "MAIN_CONTENT_UNCERTAIN", "BOILERPLATE_MAY_BE_INCLUDED", "RELATIVE_URL_UNRESOLVED", "TABLE_STRUCTURE_UNVERIFIED", "OCR_TABLE_STRUCTURE_UNVERIFIED", "HEADING_STRUCTURE_WEAK", "READABILITY_COMPLEX_TABLE", "READABILITY_LONG_FLAT_SECTION")
#: Warnings whose reason has another name.
ALIASES = {"LOW_OCR_CONFIDENCE_PAGES": "OCR_TABLE_LOW_CONFIDENCE", "MAIN_CONTENT_NOT_IDENTIFIED": "MAIN_CONTENT_UNCERTAIN"}
OPERATIONS = ("improve_heading_readability", "render_table_cell_links", "render_table_cell_lists", "reduce_duplicate_visual_labels", "add_non-factual_section_spacing", "annotate_uncertain_structure")
DECISIONS = ("apply_projection", "no_change", "needs_human_review", "reject_target")
TARGET_CHARS, REQUEST_CHARS = 12_000, 100_000


def policy(spark) -> DataFrame:
    """reason and its policy: a literal table of fixed size, which is broadcast."""
    rows = [(x, "recommended") for x in RECOMMENDED] + [(x, "optional") for x in OPTIONAL]
    values = ", ".join(f"('{a}', '{b}')" for a, b in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(reason, policy)")


def geometry_reasons(merged: Column, source_format: Column, has_anchors: Column) -> Column:
    """Reasons that a table's merged cells give."""
    return F.array_compact(F.array(F.when(merged, F.lit("MERGED_TABLE_GEOMETRY_PRESENT")), F.when(merged & ((source_format == "html") | has_anchors), F.lit("HTML_MERGED_TABLE_COMPLEX"))))


def eligibility(statuses: DataFrame, warnings: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """doc_id, policy_status (prohibited, recommended, optional, not_needed), priority and reason_codes, sorted.

    statuses has doc_id, status and valid; warnings doc_id and code; tables doc_id, merged, source_format and has_anchors.
    """
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    reasons = warnings.select("doc_id", F.coalesce(alias[F.col("code")], F.col("code")).alias("reason"))
    if tables is not None:
        reasons = reasons.unionByName(tables.select("doc_id", F.explode(geometry_reasons(F.col("merged"), F.col("source_format"), F.col("has_anchors"))).alias("reason")))
    known = reasons.join(F.broadcast(policy(statuses.sparkSession)), "reason")
    found = known.groupBy("doc_id").agg(F.bool_or(F.col("policy") == "recommended").alias("rec"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    j = statuses.join(found, "doc_id", "left")
    barred = (F.col("status") == "failed") | ~F.col("valid")
    rec, some = F.coalesce(F.col("rec"), F.lit(False)), F.col("reasons").isNotNull()
    none = F.expr("cast(array() AS array<string>)")
    return j.select(
        "doc_id", F.when(barred, "prohibited").when(rec, "recommended").when(some, "optional").otherwise("not_needed").alias("policy_status"),
        F.when(barred, "none").when(rec, "medium").when(some, "low").otherwise("none").alias("priority"), F.when(barred | ~some, none).otherwise(F.col("reasons")).alias("reason_codes"),
    )


def advisory_targets(candidates: DataFrame) -> DataFrame:
    """Rejected OCR candidates as targets that may be looked at and not written."""
    c = candidates.filter(F.col("decision") != "accepted")
    return c.select("doc_id", F.lit("advisory").alias("target_type"), F.concat(F.lit("advisory-"), "candidate_id").alias("target_id"), "reason_codes", F.array(F.lit("needs_human_review"), F.lit("no_change")).alias("allowed_outcomes"), F.lit(False).alias("projection_write_allowed"), F.lit(False).alias("canonical_mutation_allowed"))


def table_targets(tables: DataFrame, explicit: bool = False) -> DataFrame:
    """Target records of tables: doc_id, table_id, merged, source_format, has_anchors, grid, markdown."""
    reasons = geometry_reasons(F.col("merged"), F.col("source_format"), F.col("has_anchors"))
    if explicit:
        reasons = F.concat(F.array(F.lit("EXPLICIT_USER_REQUEST")), reasons)
    return tables.select("doc_id", F.lit("table").alias("target_type"), F.col("table_id").alias("target_id"), reasons.alias("reason_codes"), "grid", F.col("markdown").alias("faithful_markdown"))


def bounded(targets: DataFrame, limit: int = TARGET_CHARS) -> DataFrame:
    """target_id, n_chars, rows_kept, markdown and truncations: rows are halved, then the Markdown cut to 200 characters, until the target fits.

    Characters are those of the target as JSON with sorted keys and no blanks. Each row is written once; its length tells what every halving leaves.
    """
    frame = len(json.dumps({"canonical": {"grid": []}, "faithful_markdown": "", "target_id": ""}, separators=(",", ":"))) - len('""""')
    chars = lambda x: F.length(F.to_json(F.array(x))).cast("long") - 2
    once = lambda x, f: F.transform(F.array(x), f)[0]
    halved = lambda n, k: F.call_function("shiftright", n, k)
    first = lambda xs, k: F.aggregate(F.slice(xs, 1, k), F.greatest(k - 1, F.lit(0)).cast("long"), lambda a, x: a + x)
    grid = F.coalesce("grid", F.expr("cast(array() AS array<array<string>>)"))
    t = targets.select("doc_id", "target_id", "faithful_markdown", F.transform(grid, lambda r: F.coalesce(F.length(F.to_json(r)), F.lit(len("null")))).alias("__rows"))
    n = F.size("__rows")
    t = t.withColumns({"__n": n, "__most": F.length(F.bin(n)) - 1, "__room": limit - frame - chars(F.col("target_id"))})
    t = t.withColumn("__sizes", once(F.col("__rows"), lambda xs: F.transform(F.sequence(F.lit(0), F.col("__most")), lambda k: first(xs, halved(F.col("__n"), k)))))
    over = once(F.col("__room") - chars(F.col("faithful_markdown")), lambda room: F.size(F.filter("__sizes", lambda x: x > room)))
    t = t.withColumn("__over", over).withColumn("__cuts", F.least("__over", "__most"))
    short = (F.col("__over") > F.col("__most")) & (F.length("faithful_markdown") > 200)
    t = t.withColumn("__short", F.coalesce(short, F.lit(False))).withColumn("faithful_markdown", F.when(F.col("__short"), F.left("faithful_markdown", F.lit(200))).otherwise(F.col("faithful_markdown")))
    t = t.withColumn("n_chars", F.get("__sizes", F.col("__cuts")) + limit - F.col("__room") + chars(F.col("faithful_markdown")))
    last = F.array_compact(F.array(F.when(F.col("__short"), "markdown_context_truncated"), F.when(F.col("n_chars") > limit, "too_large")))
    return t.select("doc_id", "target_id", "n_chars", halved(F.col("__n"), F.col("__cuts")).cast("long").alias("rows_kept"), "faithful_markdown", F.concat(F.array_repeat(F.lit("grid_rows_reduced"), F.col("__cuts")), last).alias("truncations"))


PROHIBITED = ("invent_content", "remove_source_content", "change_numbers", "change_dates", "change_urls", "change table geometry", "merge unrelated source sections", "rewrite canonical JSON", "change provenance")
PRESERVED = ("preserve_facts", "preserve_numbers", "preserve_urls", "preserve_table_ids", "preserve_source_order", "do_not_modify_canonical")
#: Elements offered where a document is recommended and no table is a target.
FALLBACK_TARGETS = 10


def element_targets(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """The first elements with content of documents (doc_id) as targets: a limit of the request, not of the data."""
    e = elements.join(documents.select("doc_id"), "doc_id", "left_semi").filter(F.coalesce("content", F.lit("")) != "")
    e = e.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "id"))).filter(F.col("__n") <= FALLBACK_TARGETS)
    return e.select("doc_id", F.lit("element_range").alias("target_type"), F.format_string("ocr-element-%04d", "__n").alias("target_id"), F.col("content").alias("faithful_markdown"))


def requested(targets: DataFrame, kind: str = "all_eligible_targets", target_id: str | None = None) -> DataFrame:
    """The targets that a user asks for: all, or the one of a kind (table, element_range) with this id; EXPLICIT_USER_REQUEST comes first among their reasons."""
    if kind not in ("all_eligible_targets", "table", "element_range") or (kind != "all_eligible_targets" and not target_id):
        raise ValueError("a request names all targets, or a kind and an id")
    t = targets if kind == "all_eligible_targets" else targets.filter((F.col("target_type") == kind) & (F.col("target_id") == target_id))
    first = F.array(F.lit("EXPLICIT_USER_REQUEST"))
    return t.withColumn("reason_codes", F.array_distinct(F.concat(first, F.coalesce("reason_codes", F.expr("cast(array() AS array<string>)")))))


def requests(eligible: DataFrame, targets: DataFrame, documents: DataFrame, limit: int = REQUEST_CHARS, target_limit: int = TARGET_CHARS) -> DataFrame:
    """(doc_id, status, request, n_chars, error): a document's review request as canonical JSON.

    eligible is what eligibility() gives; targets doc_id, target_type, target_id, reason_codes and faithful_markdown; documents doc_id, sha256 and fingerprint.
    Documents that are not recommended, or have no target, get no request; one with a target of over target_limit characters, or over limit in all, gets an error instead.
    """
    t = targets.select("doc_id", F.struct("target_id", "target_type", "reason_codes", "faithful_markdown").alias("t"), F.length("faithful_markdown").alias("n"))
    g = t.groupBy("doc_id").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.max("n").alias("longest"))
    d = eligible.select("doc_id", "policy_status", F.col("reason_codes").alias("reasons")).join(documents.select("doc_id", "sha256", "fingerprint"), "doc_id").join(g, "doc_id", "left")
    actionable = (F.col("policy_status") == "recommended") & (F.coalesce(F.size("ts"), F.lit(0)) > 0)
    one = lambda x: F.struct(x["faithful_markdown"].alias("faithful_markdown"), x["reason_codes"].alias("reason_codes"), x["target_id"].alias("target_id"), x["target_type"].alias("target_type"))
    words = lambda xs: F.array(*map(F.lit, xs))
    body = F.to_json(F.struct(
        words(sorted(OPERATIONS)).alias("allowed_operations"), F.col("fingerprint").alias("canonical_bundle_fingerprint"), F.struct(*(F.lit(True).alias(k) for k in sorted(PRESERVED))).alias("instructions"), words(PROHIBITED).alias("prohibited_operations"),
        F.col("reasons").alias("reason_codes"), F.concat(F.lit("ai-review-request-"), F.left("sha256", F.lit(16))).alias("request_id"), F.lit("readable_projection_only").alias("review_scope"), F.lit("1.0").alias("schema_version"), F.col("sha256").alias("source_sha256"), F.transform("ts", one).alias("targets"),
    ))
    d = d.withColumn("__body", F.when(actionable, body)).withColumn("n_chars", F.length("__body"))
    too_large = F.coalesce((F.col("n_chars") > limit) | (F.col("longest") > target_limit), F.lit(False)) & actionable
    status = F.when(~actionable, "not_generated_no_actionable_targets").when(too_large, "failed").otherwise("generated")
    return d.select("doc_id", status.alias("status"), F.when(~too_large, F.col("__body")).alias("request"), F.when(~too_large, F.col("n_chars")).alias("n_chars"), F.when(too_large, "AI_REVIEW_CONTENT_TOO_LARGE").alias("error"))


def lost_tokens(before: Column, after: Column) -> Column:
    """Protected tokens that a text no longer has."""
    return F.array_except(F.array_distinct(protected_tokens(before)), protected_tokens(after))


def loss_code(token: Column) -> Column:
    return F.when(token.startswith("http"), "AI_REVIEW_URL_LOSS").when(token.contains("年") | token.rlike(r"\A\d{4}-"), "AI_REVIEW_DATE_LOSS").when(token.startswith("table-"), "AI_REVIEW_SOURCE_TEXT_LOSS").otherwise("AI_REVIEW_NUMBER_LOSS")


def review_errors(reviews: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, target_id, code) of reviews (decision, confidence, operations, readable_markdown) against targets
    (target_type, allowed_outcomes, faithful_markdown, source_texts)."""
    twice = reviews.groupBy("doc_id", "target_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "target_id", F.lit("AI_REVIEW_TARGET_DUPLICATE").alias("code"))
    t = targets.select("doc_id", "target_id", "target_type", "allowed_outcomes", "faithful_markdown", "source_texts", F.lit(True).alias("known"))
    j = reviews.join(t, ["doc_id", "target_id"], "left")
    known, text, apply_ = F.coalesce(F.col("known"), F.lit(False)), F.coalesce(F.col("readable_markdown"), F.lit("")), F.col("decision") == "apply_projection"
    when = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit("AI_REVIEW_" + name))
    valid = F.col("decision").isin(*DECISIONS)
    checked = known & apply_ & (text != "")
    kept = F.forall(F.coalesce("source_texts", F.expr("cast(array() AS array<string>)")), lambda v: reviewable(text).contains(reviewable(v)))
    codes = F.array(
        when(~known, "TARGET_UNKNOWN"), when(~valid, "DECISION_INVALID"), when(known & valid & (F.size("allowed_outcomes") > 0) & ~F.array_contains("allowed_outcomes", F.col("decision")), "DECISION_NOT_ALLOWED"),
        when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "CONFIDENCE_INVALID"), when(F.exists("operations", lambda o: ~o.isin(*OPERATIONS)), "OPERATION_INVALID"), when(apply_ & ~text.rlike(r"(?U)\S"), "SCHEMA_INVALID"),
        when(known & F.col("target_type").isin("element_range", "advisory") & apply_, "ADVISORY_TARGET_APPLY_UNSUPPORTED"), when(F.length(text) > TARGET_CHARS, "CONTENT_TOO_LARGE"), when(unsafe(text), "UNSAFE_CONTENT"), when(checked & ~kept, "SOURCE_TEXT_LOSS"),
    )
    lost = F.when(checked, F.transform(lost_tokens(F.coalesce("faithful_markdown", F.lit("")), text), loss_code)).otherwise(F.expr("cast(array() AS array<string>)"))
    each = j.select("doc_id", "target_id", F.explode(F.array_distinct(F.array_compact(F.concat(codes, lost)))).alias("code"))
    return each.unionByName(twice).distinct()


def fingerprint(parts: DataFrame, *by: str) -> DataFrame:
    """SHA-256 of a bundle's parts (ordinal, part), joined by line ends in order. A bundle is one unit of work."""
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "part"))), lambda x: x["part"]), "\n"), 256).alias("fingerprint"))


def corpus_fingerprint(parts: DataFrame, *by: str) -> DataFrame:
    """A fingerprint of any number of parts (ordinal, part): the sum of what SHA-256 makes of each ordinal and part, so that it needs no order and no list."""
    slice_ = lambda k: F.sum(F.conv(F.substring("__h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    h = parts.withColumn("__h", F.sha2(F.concat_ws(":", F.col("ordinal").cast("string"), "part"), 256))
    return h.groupBy(*by).agg(F.concat_ws("-", *(slice_(k) for k in range(4)), F.count("*").cast("string")).alias("fingerprint"))


def projected(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """doc_id, readable, canonical_sha256: document text with each applied review's faithful table replaced once, in the order of target_id.

    The hash of the canonical text goes along, so that nobody can change it unseen.
    """
    r = reviews.filter(F.col("decision") == "apply_projection").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("target_id", "faithful_markdown", "readable_markdown"))).alias("rs"))
    d = documents.join(r, "doc_id", "left").withColumn("rs", F.coalesce("rs", F.expr("cast(array() AS array<struct<target_id: string, faithful_markdown: string, readable_markdown: string>>)")))

    def step(text: Column, x: Column) -> Column:
        at = F.call_function("instr", text, x["faithful_markdown"])
        return F.when((at > 0) & (x["faithful_markdown"] != ""), F.concat(F.substring(text, F.lit(1), at - 1), x["readable_markdown"], F.substring(text, at + F.length(x["faithful_markdown"]), F.length(text)))).otherwise(text)

    return d.select("doc_id", F.aggregate("rs", F.col("text"), step).alias("readable"), F.sha2("text", 256).alias("canonical_sha256"))
