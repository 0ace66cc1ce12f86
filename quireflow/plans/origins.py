"""Queries over where chunks come from, slides and their reading plans, and pages that were read in two ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import chunk, pages, provenance, slides
from quireflow.plans import fixtures
from quireflow.plans.layout import BOXES, boxes
from quireflow.plans.registry import query, table
from quireflow.plans.structure import geography
from quireflow.schemas import LOCATOR

@query("""WITH r AS (SELECT l_orderkey AS doc_id, (l_partkey % 3)::INT AS l, l_linenumber::INT AS t, (l_partkey % 3 + l_suppkey % 3)::INT AS r, (l_linenumber + l_suppkey % 2)::INT AS b FROM lineitem),
  x AS (SELECT doc_id, min(l) AS x0, min(t) AS y0, max(r) AS x1, max(b) AS y1 FROM r GROUP BY doc_id),
  c AS (SELECT DISTINCT doc_id, x, unnest(range(t, b + 1)) AS y FROM (SELECT doc_id, t, b, unnest(range(l, r + 1)) AS x FROM r))
  SELECT doc_id, count(*) = any_value((x1 - x0 + 1) * (y1 - y0 + 1)) AS filled FROM c JOIN x USING (doc_id) GROUP BY doc_id""")
def filled_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ranges of an order's lines leave no cell of their bounding rectangle free."""
    i = table(spark, sf_dir, "lineitem")
    left = (F.col("l_partkey") % 3).cast("int")
    box = F.struct(left.alias("left"), F.col("l_linenumber").cast("int").alias("top"), (left + F.col("l_suppkey") % 3).cast("int").alias("right"), (F.col("l_linenumber") + F.col("l_suppkey") % 2).cast("int").alias("bottom"))
    g = i.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(box).alias("bounds"))
    return g.select("doc_id", provenance.fills_rectangle(F.col("bounds")).alias("filled"))


_KINDS = "o_orderkey % 6"


@query(f"""WITH o AS (SELECT o_orderkey AS doc_id, {_KINDS} AS k, (o_custkey % 3)::INT AS a FROM orders)
  SELECT doc_id, CASE k WHEN 0 THEN CASE WHEN a = 2 THEN 'A1:B2|A5:B6' ELSE 'A1:B4' END WHEN 1 THEN '2,' || (9 + a) || '|' WHEN 2 THEN CASE WHEN a = 2 THEN '1-1|3-3' ELSE '1-' || (1 + a) END WHEN 3 THEN CASE WHEN a = 2 THEN '0-4|8-9' ELSE '0-9' END
    WHEN 4 THEN 'xlsx|pdf' ELSE 'same' END AS merged, CASE WHEN k = 5 OR k = 2 AND a = 0 THEN 'exact' ELSE 'range' END AS precision FROM o""")
def merged_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two locators each: cells, shapes, pages and rows that join or do not, two formats, and one locator twice."""
    k, a = F.col("o_orderkey") % 6, (F.col("o_custkey") % 3).cast("int")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    one = provenance._locator
    first = F.when(k == 0, one(format=F.lit("xlsx"), sheet_name=F.lit("S"), cell_range=F.lit("A1:B2"))).when(k == 1, one(format=F.lit("pptx"), slide_number=F.lit(1), shape_id=text(9 + a)))
    first = first.when(k == 2, one(format=F.lit("pdf"), page_start=F.lit(1), page_end=F.lit(1))).when(k == 3, one(format=F.lit("csv"), row_start=F.lit(0), row_end=F.lit(4))).when(k == 4, one(format=F.lit("xlsx"))).otherwise(one(format=F.lit("json"), json_path=F.lit("same")))
    second = F.when(k == 0, one(format=F.lit("xlsx"), sheet_name=F.lit("S"), cell_range=F.when(a == 2, "A5:B6").otherwise("A3:B4"))).when(k == 1, one(format=F.lit("pptx"), slide_number=F.lit(1), shape_id=F.lit("2")))
    second = second.when(k == 2, one(format=F.lit("pdf"), page_start=1 + a, page_end=1 + a)).when(k == 3, one(format=F.lit("csv"), row_start=F.when(a == 2, 8).otherwise(5), row_end=F.lit(9))).when(k == 4, one(format=F.lit("pdf"))).otherwise(one(format=F.lit("json"), json_path=F.lit("same")))
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), k.alias("k"), provenance.merged(F.array(first, second)).alias("m"))
    dash = lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))
    shown = lambda x: F.when(F.col("k") == 0, x["cell_range"]).when(F.col("k") == 1, F.concat(F.array_join(x["shape_ids"], ","), F.lit("|"))).when(F.col("k") == 2, dash(x["page_start"], x["page_end"])).when(F.col("k") == 3, dash(x["row_start"], x["row_end"])).when(F.col("k") == 4, x["format"]).otherwise(x["json_path"])
    return m.select("doc_id", F.array_join(F.transform("m.locators", shown), "|").alias("merged"), F.col("m.precision").alias("precision"))


def _origins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of ten customers at most of one nation, their elements with locators and layout, and edges to the next customer."""
    e = geography(spark, sf_dir)
    at = F.regexp_extract("id", r"\d+", 0).try_cast("int")
    loc = F.when(F.col("type") == "paragraph", provenance._locator(element_start=at, element_end=at)).when(F.col("type") == "heading", provenance._locator(format=F.lit("docx"), source_file=F.lit("f")))
    zone = F.create_map(F.lit("layout_zone"), F.when(at % 2 == 0, "left").otherwise("right"), F.lit("region_id"), F.lit("region-01"))
    e = e.withColumns({"source_locator": loc.cast(LOCATOR), "locator_precision": F.lit("range"), "table_id": F.when(at % 5 == 0, F.concat(F.lit("t"), at.cast("string"))), "properties": zone})
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    chunks = c.groupBy(F.col("n_regionkey").alias("doc_id"), F.format_string("n%d-%d", "c_nationkey", F.floor(F.col("c_custkey") / 100)).alias("chunk_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", name.alias("id")))), lambda x: x["id"]).alias("element_ids"))
    edges = c.filter("c_custkey % 4 = 0").select(F.col("n_regionkey").alias("doc_id"), name.alias("src"), F.lit("caption_of").alias("relation"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit(1.0).alias("confidence"), F.array(F.lit("x")).alias("evidence"), F.lit("m").alias("method"))
    return chunks, e, edges


_ORIGINS = """c AS (SELECT n_regionkey AS doc_id, 'n' || c_nationkey || '-' || c_custkey // 100 AS chunk_id, c_custkey AS k, c_nationkey AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
  g AS (SELECT doc_id, chunk_id, any_value(n) AS n, count(*) AS size, min(k) AS low, max(k) AS high, count(*) FILTER (k % 4 = 0) AS edges, string_agg('t' || k, ',' ORDER BY k) FILTER (k % 5 = 0) AS tables, arg_min(k % 2, k) AS first, count(DISTINCT k % 2) AS zones FROM c GROUP BY ALL)"""


@query(f"""WITH {_ORIGINS} SELECT doc_id, chunk_id, CASE WHEN size = 1 THEN low || '-' || high WHEN high <= low + 1 THEN low || '-' || high ELSE size || ' places' END AS place, 'range' AS locator_precision, coalesce(tables, '') AS table_ids, 'r' || doc_id || ',n' || n AS ancestor_element_ids,
  'r' || doc_id AS section_element_id, 'n' || n AS unit_element_id, CASE WHEN edges > 0 THEN 'n' || n ELSE '' END AS related, edges::INT AS n_relationships, CASE WHEN edges > 0 THEN 'caption_of' ELSE '' END AS relation_types,
  CASE WHEN zones = 2 THEN CASE WHEN first = 0 THEN 'left,right' ELSE 'right,left' END WHEN first = 0 THEN 'left' ELSE 'right' END AS layout_zones, 'region-01' AS layout_region_ids FROM g""")
def chunk_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks rolled up: locators with what they inherit, ancestors, section and unit, relations, tables and layout."""
    p = provenance.chunk_provenance(*_origins(spark, sf_dir))
    one = F.get("source_locators", F.lit(0))
    place = F.when((F.size("source_locators") == 1) & (one["format"] == "docx"), F.concat_ws("-", one["element_start"].cast("string"), one["element_end"].cast("string"))).otherwise(F.concat(F.size("source_locators").cast("string"), F.lit(" places")))
    many = lambda c: F.array_join(c, ",").alias(c)
    return p.select("doc_id", "chunk_id", place.alias("place"), "locator_precision", many("table_ids"), many("ancestor_element_ids"), "section_element_id", "unit_element_id", F.array_join("related_element_ids", ",").alias("related"), F.size("relationships").alias("n_relationships"), many("relation_types"), many("layout_zones"), many("layout_region_ids"))


@query(f"""WITH {_ORIGINS} SELECT doc_id, 'CHUNK_CONTEXT_INCONSISTENT' AS code, chunk_id || ':' || f AS subject FROM g, (VALUES ('section_element_id', 0), ('layout_zones', 1)) AS v(f, m) WHERE n % 3 = m""")
def context_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk contexts derived anew, a third with a forged section, a third with forged zones."""
    chunks, e, edges = _origins(spark, sf_dir)
    p = provenance.chunk_provenance(chunks, e, edges)
    n = F.regexp_extract("chunk_id", r"n(\d+)", 1).cast("int") % 3
    p = p.withColumns({"section_element_id": F.when(n == 0, "forged").otherwise(F.col("section_element_id")), "layout_zones": F.when(n == 1, F.array(F.lit("forged"))).otherwise(F.col("layout_zones"))})
    return provenance.context_issues(p, e, edges)


@query(f"""WITH {_ORIGINS} SELECT doc_id, count(*) AS chunk_count, count(*) AS located_chunks, count(*) FILTER (size = 1 OR high <= low + 1) AS single_locator_chunks, 0::BIGINT AS exact_chunks, sum(size)::BIGINT AS referenced_elements, count(*)::BIGINT AS unresolved_references FROM g GROUP BY doc_id""")
def provenance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of chunks that each also refer to an element that is not there."""
    chunks, e, edges = _origins(spark, sf_dir)
    p = provenance.chunk_provenance(chunks, e, edges)
    m = provenance.metrics(p.withColumn("element_ids", F.concat("element_ids", F.array(F.lit("ghost")))), e, "doc_id")
    return m.withColumn("referenced_elements", F.col("referenced_elements") - 1)


@query(f"""WITH {_ORIGINS} SELECT doc_id, chunk_id, 'r' || doc_id AS section_element_id, '1.0' AS schema_version, 'f' AS source_file, sha256(doc_id::VARCHAR) AS source_sha256,
  CASE WHEN edges > 0 THEN '[section_element_id: r' || doc_id || ']' || chr(10) || '[unit_element_id: n' || n || ']' || chr(10) || '[relation_types: caption_of]' || chr(10) || '[related_element_ids: n' || n || ']' || chr(10) ELSE '[section_element_id: r' || doc_id || ']' || chr(10) || '[unit_element_id: n' || n || ']' || chr(10) END
    || '[layout_region_ids: region-01]' || chr(10) || chr(10) || 'text' AS embedding_text FROM g WHERE size = 1 OR high <= low + 1""")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records of the chunks that have one locator."""
    chunks, e, edges = _origins(spark, sf_dir)
    docs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit("other").alias("source_file"), F.sha2(F.col("r_regionkey").cast("string"), 256).alias("sha256"))
    r = provenance.records(chunks.withColumn("text", F.lit("text")), e, docs, edges).filter(F.size("source_locators") == 1)
    return r.select("doc_id", "chunk_id", "section_element_id", "schema_version", "source_file", "source_sha256", "embedding_text")


@query("""SELECT c_custkey AS doc_id, 'chunk-00001' AS chunk_id, 1 AS chunk_index, 1 AS part_index, 1 AS part_count, c_name AS text FROM customer WHERE c_custkey % 2 = 0""")
def markdown_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a chunk get their Markdown, cut."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("markdown"))
    return provenance.fallback_chunks(c, c.filter("doc_id % 2 = 1"))


@query("""WITH RECURSIVE p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, '| ' || o_orderkey || ' | ' || repeat('x', (o_orderkey % 90)::INT) || ' |' AS line FROM orders),
  f AS (SELECT doc_id, i, 1 AS part, 23 + length(line) AS n FROM p WHERE i = 1 UNION ALL
    SELECT p.doc_id, p.i, CASE WHEN n + 1 + length(line) <= 400 THEN part ELSE part + 1 END, CASE WHEN n + 1 + length(line) <= 400 THEN n + 1 + length(line) ELSE 23 + length(line) END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
  SELECT doc_id, part::INT AS part, '| key | x |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY p.i) AS text FROM p JOIN f USING (doc_id, i) GROUP BY doc_id, part""".replace("23 +", "26 +"))
def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables cut between rows, each part with the header."""
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.repeat(F.lit("x"), (F.col("o_orderkey") % 90).cast("int")), F.lit(" |"))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("x")))), lambda s: s["x"]).alias("rows"))
    parts = chunk.cut_pipe_table(F.concat(F.array(F.lit("| key | x |"), F.lit("| --- | --- |")), F.col("rows")), 400)
    return g.select("doc_id", F.posexplode(parts).alias("no", "text")).select("doc_id", (F.col("no") + 1).alias("part"), "text")


def _shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The boxes as shapes of slides of 600 x 800, narrower, with roles; one in ten has no place, one in thirteen no substance."""
    b = boxes(spark, sf_dir)
    k = F.col("idx")
    role = F.when(k % 10 == 0, "title").when(k % 10 == 9, "footer").otherwise("body")
    x1 = F.col("x0") + F.when(k % 4 == 0, F.col("x1") - F.col("x0") + 300).otherwise((F.col("x1") - F.col("x0")) / 2)
    placed = k % 10 != 5
    s = b.select("doc_id", F.col("page").alias("slide"), "idx", role.alias("role"), (k % 13 != 0).alias("material"), *(F.when(placed, c).alias(n) for n, c in (("x0", F.col("x0")), ("y0", F.col("y0")), ("x1", x1), ("y1", F.col("y1")))))
    return s, b.select("doc_id", F.col("page").alias("slide")).distinct().select("doc_id", "slide", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


_SHAPES = f"""{BOXES}, z AS (SELECT doc_id, page AS slide, idx, CASE idx % 10 WHEN 0 THEN 'title' WHEN 9 THEN 'footer' ELSE 'body' END AS role, idx % 13 <> 0 AS material, idx % 10 <> 5 AS placed, x0, y0, x0 + CASE WHEN idx % 4 = 0 THEN x1 - x0 + 300 ELSE (x1 - x0) / 2 END AS x1, y1 FROM b),
  m AS (SELECT * FROM z WHERE material AND placed),
  p AS (SELECT a.doc_id, a.slide, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) AS ratio,
    greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / least(a.y1 - a.y0, c.y1 - c.y0) AS shared, greatest(c.x0 - a.x1, a.x0 - c.x1) AS apart, greatest(a.x1 - a.x0, c.x1 - c.x0) AS wide FROM m a JOIN m c ON a.doc_id = c.doc_id AND a.slide = c.slide AND a.idx < c.idx),
  n AS (SELECT doc_id, slide, count(*) FILTER (ratio >= 0.2) AS over, count(*) FILTER (shared >= 0.5 AND apart >= 12 AND wide <= 360) AS side FROM p GROUP BY ALL),
  q AS (SELECT doc_id, slide, (x0 + x1) / 2 AS c, idx FROM m WHERE x1 - x0 <= 390 AND role = 'body'),
  r AS (SELECT *, lead(c) OVER w AS d, row_number() OVER w AS rank FROM q WINDOW w AS (PARTITION BY doc_id, slide ORDER BY c, idx)),
  t AS (SELECT doc_id, slide, arg_max((c + d) / 2, (d - c, -rank)) AS x FROM r WHERE d IS NOT NULL GROUP BY ALL),
  f AS (SELECT s.doc_id, s.slide, coalesce(k, 0) AS k, coalesce(over, 0) AS over, coalesce(side, 0) AS side, CASE WHEN side > 0 THEN round(x, 3) END AS split_x FROM (SELECT DISTINCT doc_id, slide FROM z) s LEFT JOIN (SELECT doc_id, slide, count(*) AS k FROM m GROUP BY ALL) USING (doc_id, slide) LEFT JOIN n USING (doc_id, slide) LEFT JOIN t USING (doc_id, slide))"""


@query(f"""WITH {_SHAPES} SELECT doc_id, slide, k AS material_shapes, over AS overlapping_pairs, side AS side_by_side_pairs, split_x, over > 0 OR side > 0 AS ambiguous FROM f""")
def slide_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slides.flows(*_shapes(spark, sf_dir)).drop("signals")


@query(f"""WITH {_SHAPES}, h AS (SELECT z.*, split_x, over, side, split_x IS NOT NULL AND side > 0 AND over = 0 AS cols, z.material AND z.placed AS here FROM z JOIN f USING (doc_id, slide)),
  zo AS (SELECT *, CASE WHEN NOT here THEN CASE WHEN material THEN 'freeform' END WHEN role = 'title' THEN 'title' WHEN role = 'footer' OR y0 >= 720 THEN 'footer' WHEN cols AND x1 - x0 < 432 THEN CASE WHEN (x0 + x1) / 2 < split_x THEN 'body_left' ELSE 'body_right' END ELSE 'body' END AS zone FROM h),
  co AS (SELECT *, CASE zone WHEN 'body_left' THEN 1 WHEN 'body_right' THEN 2 ELSE 0 END AS col, row_number() OVER (PARTITION BY doc_id, slide ORDER BY y0, x0, idx) AS rk FROM zo),
  ba AS (SELECT *, CASE WHEN col = 0 THEN rk ELSE coalesce((SELECT min(o.rk) FROM co o WHERE o.doc_id = co.doc_id AND o.slide = co.slide AND o.here AND o.col = 0 AND o.y0 > (co.y0 + co.y1) / 2), 1000000) END AS band FROM co),
  oo AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slide ORDER BY CASE WHEN here THEN 0 WHEN material THEN 1 ELSE 2 END, CASE WHEN NOT here OR cols THEN 0 WHEN zone = 'title' THEN 0 WHEN zone = 'footer' THEN 2 ELSE 1 END, CASE WHEN here AND cols THEN band ELSE 0 END, CASE WHEN NOT here OR NOT cols THEN 0 WHEN col = 0 THEN 3 ELSE col END, CASE WHEN here THEN rk ELSE 0 END, CASE WHEN placed THEN y0 ELSE 0 END, CASE WHEN placed THEN x0 ELSE 0 END, idx)::INT AS reading_order FROM ba),
  st AS (SELECT *, min(CASE WHEN here THEN reading_order END) OVER (PARTITION BY doc_id, slide, zone) AS start FROM oo)
  SELECT doc_id, slide, idx, reading_order, CASE WHEN here THEN printf('slide-region-%02d', dense_rank() OVER (PARTITION BY doc_id, slide ORDER BY start NULLS LAST)) WHEN material THEN 'slide-region-unlocated' END AS region_id, zone AS layout_zone,
    CASE WHEN material THEN CASE WHEN NOT here THEN 0.5 WHEN cols THEN 0.88 WHEN over > 0 OR side > 0 THEN 0.6 ELSE 0.95 END END::DOUBLE AS order_confidence FROM st""")
def slide_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slides.plan(*_shapes(spark, sf_dir)).select("doc_id", "slide", "idx", "reading_order", "region_id", "layout_zone", "order_confidence")


@query("""SELECT conv_id AS doc_id, unnest(['n' || turn, 's']) AS src, unnest(['note_for', 'has_note']) AS relation, unnest(['s', 'n' || turn]) AS dst, 1.0::DOUBLE AS confidence FROM conversations WHERE role = 'assistant'""")
def note_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns as notes of their conversation's slide."""
    c = table(spark, sf_dir, "conversations")
    e = c.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("n"), F.col("turn").cast("string")).alias("id"), F.lit("s").alias("parent_id"), F.when(F.col("role") == "assistant", "note").otherwise("paragraph").alias("type"))
    roots = c.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.lit("s").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("slide").alias("type"))
    return slides.note_edges(e.unionByName(roots)).drop("evidence", "method")


@query("SELECT doc_id, CASE WHEN strpos(trim(text, chr(10)), chr(10)) = 0 AND length(text) <= 120 THEN 'heading' ELSE 'paragraph' END AS type FROM documents WHERE trim(text) <> ''")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.trim("text") != "")
    return d.select("doc_id", pages.block_type(F.col("text")).alias("type"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber::INT AS page, CASE WHEN l_partkey % 2 = 0 THEN 'pdfplumber' ELSE 'ocr' END AS engine, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 2, l_partkey, l_suppkey)::INT AS ordinal FROM lineitem""")
def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with text and scanned pages of a document, merged in page order."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), F.struct("l_partkey", "l_suppkey").alias("ordinal"), (F.col("l_partkey") % 2 == 0).alias("text"))
    part = lambda text, engine: i.filter(F.col("text") if text else ~F.col("text")).select("doc_id", "page", "ordinal", F.lit(engine).alias("engine"))
    return pages.merged_pages(part(True, "pdfplumber"), part(False, "ocr")).select("doc_id", "page", "engine", "ordinal")


@query("""SELECT o_orderkey AS doc_id, 'e1' AS id, 'page-0001' AS parent_id, 't1' AS table_id FROM orders UNION ALL SELECT o_orderkey, 'e2-raster', printf('page-%04d', o_custkey % 9), CASE WHEN o_custkey % 2 = 0 THEN 't1-raster' ELSE 'other' END FROM orders""")
def raster_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements read off pictures, laid over those with text; the read page itself is left out."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "doc_id")
    shape = lambda i, kind, page, t: o.select("doc_id", F.lit(i).alias("id"), F.lit("page-0001").alias("parent_id"), F.lit(kind).alias("type"), page.cast("int").alias("page"), t.alias("table_id"))
    base = shape("e1", "paragraph", F.lit(1), F.lit("t1"))
    raster = shape("p", "page", F.lit(1), F.lit(None).cast("string")).unionByName(shape("e2", "table", F.col("o_custkey") % 9, F.when(F.col("o_custkey") % 2 == 0, "t1").otherwise("other")))
    tables = o.select("doc_id", F.lit("t1").alias("table_id"))
    return pages.overlaid(base, raster, tables).select("doc_id", "id", "parent_id", "table_id")


@query("""SELECT doc_id, (doc_id % 7)::INT AS page, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '<!-- material-raster-ocr -->' || chr(10) || 'read' ELSE '' END AS markdown FROM documents""")
def raster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).cast("int").alias("page"), F.col("text").alias("markdown"))
    return pages.overlaid_pages(d, d.filter("doc_id % 2 = 0").withColumn("markdown", F.lit("read")))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, ['accepted', 'fallback_to_text', 'rejected'][1 + l_partkey % 3] AS d, l_discount * 10 AS conf FROM lineitem)
  SELECT doc_id, count(*) AS candidate_count, count(*) FILTER (d = 'accepted') AS accepted_count, count(*) FILTER (d <> 'accepted') AS rejected_count, count(*) FILTER (d = 'fallback_to_text') AS fallback_to_text_count, count(*) FILTER (conf < 0.6) AS low_confidence_count FROM c GROUP BY doc_id""")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), fixtures.picked(F.col("l_partkey"), "accepted", "fallback_to_text", "rejected").alias("decision"), (F.col("l_discount") * 10).alias("confidence"))
    return pages.assessment(c)


