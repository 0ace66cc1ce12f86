"""Queries over referential integrity, edges and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import scalars
from quireflow.operators import diff, review, validate
from quireflow.plans.registry import query, table
from quireflow.plans.structure import geography
from quireflow.sources import text as text_source


@query("SELECT o_orderkey % 100 AS doc_id, 'ORDER_CUSTOMER_UNKNOWN' AS code, o_custkey::VARCHAR AS subject FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def broken_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that are not there, a third of whom are taken out; each document knows all customers."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("doc_id"), F.col("o_custkey").cast("string").alias("ref"))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("id"))
    return validate.missing(o, c, "ref", "id", "ORDER_CUSTOMER_UNKNOWN")


@query("SELECT 0::BIGINT AS doc_id, 'DUPLICATE' AS code, o_custkey::VARCHAR AS subject FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("doc_id"), F.col("o_custkey").cast("string").alias("id"))
    return validate.duplicate_ids(o, "DUPLICATE")


@query("""WITH c AS (SELECT n_regionkey AS doc_id, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT doc_id, 'PARENT_UNKNOWN' AS code, 'nowhere' AS subject FROM c WHERE k % 50 = 0 UNION ALL SELECT doc_id, 'ELEMENT_UNREACHABLE', 'c' || k FROM c WHERE k % 50 = 0 OR k % 77 = 0 UNION ALL SELECT doc_id, 'ELEMENT_CYCLE', 'c' || k FROM c WHERE k % 77 = 0 AND k % 50 <> 0
  UNION ALL SELECT r_regionkey, 'ELEMENT_CYCLE', unnest(['x1', 'x2', 'x3']) FROM region UNION ALL SELECT r_regionkey, 'ELEMENT_UNREACHABLE', unnest(['x1', 'x2', 'x3', 'y1', 'y2']) FROM region""")
def element_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.element_issues(geography(spark, sf_dir, broken=True))


_EDGES = """e AS (SELECT l_orderkey AS doc_id, 'e' || l_linenumber AS src, 'caption_of' AS rel, 'e' || (l_linenumber + l_partkey % 2) AS dst FROM lineitem UNION ALL
  SELECT l_orderkey, 'e' || (l_linenumber + l_partkey % 2), 'captioned_by', 'e' || l_linenumber FROM lineitem WHERE l_suppkey % 3 <> 0)"""


@query(f"""WITH {_EDGES}, k AS (SELECT DISTINCT l_orderkey AS doc_id, 'e' || l_linenumber AS id FROM lineitem)
  SELECT doc_id, 'ASSOCIATION_SELF_REFERENCE' AS code, src AS subject FROM e WHERE src = dst UNION ALL SELECT doc_id, 'ASSOCIATION_TARGET_MISSING', dst FROM e WHERE src <> dst AND (doc_id, dst) NOT IN (SELECT (doc_id, id) FROM k)
  UNION ALL SELECT doc_id, 'ASSOCIATION_RECIPROCAL_MISSING', src FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM e f WHERE f.doc_id = e.doc_id AND f.src = e.dst AND f.dst = e.src AND f.rel = CASE e.rel WHEN 'caption_of' THEN 'captioned_by' ELSE 'caption_of' END)""")
def reciprocal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    e = lambda n: F.concat(F.lit("e"), n.cast("string"))
    a, b = e(F.col("l_linenumber")), e(F.col("l_linenumber") + F.col("l_partkey") % 2)
    there = item.select(F.col("l_orderkey").alias("doc_id"), a.alias("src"), F.lit("caption_of").alias("relation"), b.alias("dst"))
    back = item.filter("l_suppkey % 3 <> 0").select(F.col("l_orderkey").alias("doc_id"), b.alias("src"), F.lit("captioned_by").alias("relation"), a.alias("dst"))
    return validate.edge_issues(there.unionByName(back), item.select(F.col("l_orderkey").alias("doc_id"), a.alias("id")))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem)
  SELECT doc_id, 'CHUNK_CHAR_COUNT' AS code, 'chunk-' || i AS subject FROM c WHERE p % 10 = 0 UNION ALL SELECT doc_id, 'CHUNK_PART_INVALID', 'chunk-' || i FROM c WHERE p % 11 = 0
  UNION ALL SELECT doc_id, 'CHUNK_TOO_LONG', 'chunk-' || i FROM c WHERE p % 13 = 0 UNION ALL SELECT doc_id, 'CHUNK_REFERENCE_DUPLICATE', 'chunk-' || i FROM c WHERE p % 7 = 0 UNION ALL SELECT doc_id, 'CHUNK_INDEX_GAP', 'chunk-' || i FROM c WHERE r <> i
  UNION ALL SELECT doc_id, 'CHUNK_ID_DUPLICATE', 'chunk-' || i FROM c GROUP BY doc_id, i HAVING count(*) > 1""")
def chunk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with planted faults."""
    p = F.col("l_partkey")
    n = F.when(p % 13 == 0, 2001).otherwise(10)
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("chunk-"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.col("l_linenumber").alias("chunk_index"), F.when(p % 11 == 0, 2).otherwise(1).alias("part_index"), F.lit(1).alias("part_count"),
        F.when(p % 7 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("element_ids"), F.repeat(F.lit("x"), n).alias("text"), (n + F.when(p % 10 == 0, 1).otherwise(0)).alias("char_count"),
    )
    return validate.chunk_issues(c)


@query("""WITH r AS (SELECT doc_id, doc_id % 6 AS k FROM documents) SELECT doc_id, 't' AS target_id, unnest(CASE k WHEN 0 THEN ['AI_REVIEW_DECISION_INVALID'] WHEN 1 THEN ['AI_REVIEW_CONFIDENCE_INVALID'] WHEN 2 THEN ['AI_REVIEW_UNSAFE_CONTENT', 'AI_REVIEW_NUMBER_LOSS', 'AI_REVIEW_SOURCE_TEXT_LOSS']
  WHEN 3 THEN ['AI_REVIEW_OPERATION_INVALID', 'AI_REVIEW_NUMBER_LOSS', 'AI_REVIEW_SOURCE_TEXT_LOSS'] WHEN 4 THEN ['AI_REVIEW_TARGET_UNKNOWN'] ELSE [] END) AS code FROM r""")
def review_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with planted faults against one target a document."""
    d, k = table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id") % 6
    arr = lambda *x: F.array(*map(F.lit, x))
    targets = d.filter(k != 4).select("doc_id", F.lit("t").alias("target_id"), F.lit("table").alias("target_type"), F.expr("cast(array() AS array<string>)").alias("allowed_outcomes"), F.lit("total 42").alias("faithful_markdown"), arr("total *42*").alias("source_texts"))
    text = F.when(k == 2, "<script>x</script>").when(k == 3, "none").otherwise("Total 42")
    reviews = d.select("doc_id", F.lit("t").alias("target_id"), F.when(k == 0, "maybe").otherwise("apply_projection").alias("decision"), F.when(k == 1, 1.5).otherwise(0.5).alias("confidence"), F.when(k == 3, arr("invent")).otherwise(arr("render_table_cell_links")).alias("operations"), text.alias("readable_markdown"))
    return review.review_errors(reviews, targets)


@query("""WITH r AS (SELECT doc_id, doc_id % 5 AS k FROM documents) SELECT doc_id::VARCHAR AS case_id, unnest(CASE k WHEN 0 THEN ['missing:A'] WHEN 1 THEN ['forbidden:X', 'unexpected:X'] WHEN 2 THEN ['status'] WHEN 3 THEN ['tables'] ELSE [] END) AS breach FROM r""")
def contract_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), (F.col("doc_id") % 5).alias("k")), F.col("k")
    arr = lambda *x: F.array(*map(F.lit, x))
    cases = d.select("case_id", arr("A").alias("required"), arr("B").alias("allowed"), arr("X").alias("forbidden"), arr("passed").alias("statuses"), F.lit(1).alias("min_tables"), F.lit(2).alias("max_tables"))
    seen = d.select("case_id", F.when(k == 0, arr("B")).when(k == 1, arr("A", "X")).otherwise(arr("A")).alias("codes"), F.when(k == 2, "failed").otherwise("passed").alias("status"), F.when(k == 3, 3).otherwise(1).alias("n_tables"))
    return diff.contract_breaches(cases, seen)


@query("""SELECT source AS format, count(*) FILTER (lang = 'en') AS passed, count(*) FILTER (lang = 'fr') AS passed_with_warnings, count(*) FILTER (lang NOT IN ('en', 'fr')) AS failed FROM documents GROUP BY source""")
def regression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return diff.regression_summary(d.select(F.col("source").alias("format"), F.when(F.col("lang") == "en", "passed").when(F.col("lang") == "fr", "passed_with_warnings").otherwise("failed").alias("status")))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'assets/' || doc_id || '.png' WHEN 1 THEN 'assets/x.png' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'b.png' END AS path FROM documents""")
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundle-relative paths folded; absolute ones and those that lead out are null."""
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    p = F.when(k == 0, F.concat(F.lit("./assets/"), n, F.lit(".png"))).when(k == 1, "assets/y/../x.png").when(k == 2, "../etc/passwd").when(k == 3, "/etc/passwd").otherwise("a\\..\\b.png")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.inside(p).alias("path"))


@query("""WITH a AS (SELECT doc_id // 10 AS d, doc_id AS no, row_number() OVER (PARTITION BY doc_id // 10, doc_id % 2 ORDER BY doc_id) AS n, doc_id % 2 AS k FROM documents)
  SELECT d AS doc_id, no, CASE WHEN k = 0 THEN 'a_b' ELSE 'c' END || CASE WHEN n > 1 THEN '_' || (n - 1) ELSE '' END || CASE WHEN k = 0 THEN '.pdf' ELSE '' END AS safe FROM a""")
def attachment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("doc_id"), F.col("doc_id").alias("no"), F.when(F.col("doc_id") % 2 == 0, "x/../a b.pdf").otherwise("..\\c").alias("name"))
    return text_source.attachment_names(d).select("doc_id", "no", "safe")


@query("""SELECT doc_id, 'img ' || doc_id || '.png' AS normalized_target, 2 AS line_number FROM documents""")
def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("text \\![no](x.png)\n![alt](<img%20"), F.col("doc_id").cast("string"), F.lit(".png>) end"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(scalars.image_references(md)).alias("r"))
    return d.select("doc_id", "r.normalized_target", "r.line_number")
