"""Queries over file routing, JSON, CSV and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.plans.registry import query, table
from quireflow.sources import files, html, text

_EXT = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in es)}) THEN '{f}'" for f, es in files.EXTENSIONS.items()) + " ELSE 'unknown' END"


@query(f"SELECT page_id, {_EXT} AS fmt FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/.][^/]*\\.([^./]*)$', 1)) AS ext FROM pages)")
def extension_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.extension_format(F.regexp_replace("url", "[?#].*$", "")).alias("fmt"))


_HEADS = ("255044462D312E37", "89504E470D0A1A0A", "FFD8FFE0", "49492A00", "424D", "524946460000000057454250", "D0CF11E0A1B11AE1", "5B5D", "504B0304")
_NAMES = ("pdf", "pdf", "xlsx", "doc", "txt", "", "png", "xyz", "docx", "csv")


@query(f"""WITH f AS (SELECT doc_id, {list(_NAMES)!r}[1 + doc_id % 10] AS ext, {list(_HEADS)!r}[1 + doc_id % 9] AS h FROM documents),
  g AS (SELECT doc_id, {_EXT} AS e, CASE WHEN h LIKE '25504446%' THEN 'pdf' WHEN h LIKE '89504E%' OR h LIKE 'FFD8FF%' OR h LIKE '49492A00%' OR h LIKE '424D%' OR h LIKE '52494646%' THEN 'image' WHEN h LIKE 'D0CF%' THEN 'ole' ELSE 'unknown' END AS m FROM f)
  SELECT doc_id, e AS declared_extension, CASE m WHEN 'ole' THEN 'legacy_office_or_encrypted_ooxml' ELSE m END AS detected_by_magic, CASE m WHEN 'unknown' THEN e WHEN 'ole' THEN 'legacy_office' ELSE m END AS resolved,
    CASE m WHEN 'unknown' THEN false WHEN 'ole' THEN e NOT IN ('legacy_office', 'unknown') ELSE e <> 'unknown' AND e <> m END AS mismatch FROM g""")
def magic_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by name and by first bytes; the zip among them is damaged."""
    d = table(spark, sf_dir, "documents")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % n + 1).cast("int"))
    f = d.select("doc_id", F.concat(F.lit("in/file."), pick(_NAMES, 10)).alias("path"), F.unhex(F.concat(pick(_HEADS, 9), F.lit("00000000"))).alias("content"))
    return files.routed(f).drop("path", "content")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS length FROM documents")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("length"))


@query("SELECT event_id AS doc_id, '```json' || chr(10) || '{' || chr(10) || '  \"k\": ' || regexp_extract(props, '\\d+') || chr(10) || '}' || chr(10) || '```' AS content, true AS json_valid, 2 AS depth FROM events")
def json_structured_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.json_blocks(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text")))


@query("SELECT event_id AS doc_id, (1 + event_id % 3 + CASE WHEN event_id % 5 = 0 THEN 1200 ELSE 0 END)::INT AS source_depth, CASE WHEN event_id % 5 <> 0 THEN event_id % 4 <> 0 END AS json_valid, CASE WHEN event_id % 5 = 0 THEN 'JSON_NESTING_LIMIT_EXCEEDED' END AS failure FROM events")
def json_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, broken and far too deep texts made of the props."""
    n = (F.col("event_id") % 3 + F.when(F.col("event_id") % 5 == 0, 1200).otherwise(0)).cast("int")
    bad = F.when(F.col("event_id") % 4 == 0, F.lit(" x")).otherwise("")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.repeat(F.lit("["), n), "props", F.repeat(F.lit("]"), n), bad).alias("text"))
    return text.json_checked(e).drop("text")


@query("""WITH n AS (SELECT n_regionkey AS doc_id, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS r FROM nation)
  SELECT doc_id, r AS "row", unnest([0, 1, 2])::INT AS "column", unnest([n_nationkey::VARCHAR, n_name, CASE WHEN r = 1 THEN 'x;y' ELSE '' END]) AS value FROM n
  UNION ALL SELECT r_regionkey, 0, unnest([0, 1, 2])::INT, unnest(['key', 'name', '__extra_1']) FROM region""")
def csv_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ragged CSV file per region: its first row has a field more than the header."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    row = F.transform("ns", lambda x, i: F.concat(x["n_nationkey"].cast("string"), F.lit(","), x["n_name"], F.when(i == 0, ',"x;y"').otherwise("")))
    f = n.select("doc_id", F.concat(F.lit("key,name\r\n"), F.array_join(row, "\r\n")).alias("text"))
    return text.csv_cells(f).select("doc_id", "row", "column", "value")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id")


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


@query(f"""WITH a AS (SELECT page_id AS doc_id, {_ARTICLE} AS x FROM pages)
  SELECT doc_id, 'article_element' AS main_strategy, 'high' AS main_confidence, len(regexp_extract_all(x, '<h[1-6]>'))::INT AS heading_count, len(regexp_extract_all(x, '<p>'))::INT AS paragraph_count, len(regexp_extract_all(x, '<br>'))::INT AS break_count,
    len(regexp_extract_all(x, '<a '))::INT AS link_count, len(regexp_extract_all(x, '<table'))::INT AS table_count, len(regexp_extract_all(x, '<img'))::INT AS image_count, len(regexp_extract_all(x, '<h[1-6]>'))::INT AS canonical_headings FROM a""")
def html_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = html.metrics(_pages(spark, sf_dir))
    return m.select("doc_id", "main_strategy", "main_confidence", "heading_count", "paragraph_count", "break_count", "link_count", "table_count", "image_count", "canonical_headings")


@query(f"""WITH a AS (SELECT page_id AS doc_id, string_split_regex({_ARTICLE}, '<p>|</p>') AS x FROM pages), p AS (SELECT doc_id, unnest(x[2:]) AS t FROM a),
  n AS (SELECT doc_id, count(*) FILTER (trim(regexp_replace(t, '</?b>', '', 'g')) <> '') AS k FROM p GROUP BY doc_id)
  SELECT doc_id, 'heading' AS type, 1::BIGINT AS n FROM n UNION ALL SELECT doc_id, 'paragraph', k FROM n WHERE k > 0""")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each page's main part, by type."""
    return html.elements(_pages(spark, sf_dir)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc_id, 'passed' AS status, '' AS failure_codes FROM pages")
def html_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.fidelity(html.metrics(_pages(spark, sf_dir))).select("doc_id", "status", F.array_join("failure_codes", ",").alias("failure_codes"))
