"""Queries over page geometry, with boxes derived from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import layout
from quireflow.plans.registry import query, table


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten boxes a page of 600 x 800, at whole coordinates that the vectors give."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    at = lambda k, m: F.pmod(F.floor(F.abs(F.col("embedding")[k].cast("double")) * 100000).cast("long"), F.lit(m)).cast("double")
    x0, y0 = at(0, 400), at(1, 700)
    b = e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("vec_id").cast("int").alias("idx"), x0.alias("x0"), y0.alias("y0"), (x0 + 40 + at(2, 160)).alias("x1"), (y0 + 10 + at(3, 60)).alias("y1"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("text"), (at(4, 100) / 100).alias("conf"))
    return b


BOXES = """b AS (SELECT vec_id // 10 AS doc_id, 1 AS page, vec_id::INT AS idx, x0, y0, x0 + 40 + w AS x1, y0 + 10 + h AS y1, 'w' || vec_id AS text, conf FROM (
  SELECT vec_id, (floor(abs(embedding[1]::DOUBLE) * 100000)::BIGINT % 400)::DOUBLE AS x0, (floor(abs(embedding[2]::DOUBLE) * 100000)::BIGINT % 700)::DOUBLE AS y0, (floor(abs(embedding[3]::DOUBLE) * 100000)::BIGINT % 160)::DOUBLE AS w,
    (floor(abs(embedding[4]::DOUBLE) * 100000)::BIGINT % 60)::DOUBLE AS h, (floor(abs(embedding[5]::DOUBLE) * 100000)::BIGINT % 100) / 100 AS conf FROM embeddings))"""


def pages(b: DataFrame) -> DataFrame:
    return b.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("doc_id", "page", "idx", F.col("x0").alias("x"), F.col("y0").alias("y"), "text", "conf")


COLUMNS = """c AS (SELECT *, (x0 + x1) / 2 AS center FROM b WHERE x1 - x0 <= 432),
  n AS (SELECT *, row_number() OVER w AS rank, lead(center) OVER w - center AS gap, count(*) OVER (PARTITION BY doc_id, page) AS n FROM c WINDOW w AS (PARTITION BY doc_id, page ORDER BY center, idx)),
  s AS (SELECT doc_id, page, max(gap) AS gap FROM n WHERE n >= 4 GROUP BY ALL), k AS (SELECT n.doc_id, n.page, s.gap, min(rank) AS cut FROM n JOIN s ON n.doc_id = s.doc_id AND n.page = s.page AND n.gap = s.gap GROUP BY ALL),
  g AS (SELECT n.doc_id, n.page, any_value(k.gap) AS gap, count(*) FILTER (rank <= cut) AS left_blocks, count(*) FILTER (rank > cut) AS right_blocks, max(x1) FILTER (rank <= cut) AS le, min(x0) FILTER (rank > cut) AS re,
    min(y0) FILTER (rank <= cut) AS ly0, max(y1) FILTER (rank <= cut) AS ly1, min(y0) FILTER (rank > cut) AS ry0, max(y1) FILTER (rank > cut) AS ry1 FROM n JOIN k ON n.doc_id = k.doc_id AND n.page = k.page GROUP BY n.doc_id, n.page),
  l AS (SELECT *, greatest(0, least(ly1, ry1) - greatest(ly0, ry0)) / greatest(1, least(ly1 - ly0, ry1 - ry0)) AS shared FROM g WHERE left_blocks >= 2 AND right_blocks >= 2)"""


@query(f"""WITH {BOXES}, {COLUMNS} SELECT doc_id, page, round(gap / 600, 3) AS center_gap_ratio, round((re - le) / 600, 3) AS separation_ratio, round(shared, 3) AS vertical_overlap_ratio, left_blocks, right_blocks, round((le + re) / 2, 3) AS split_x,
  gap / 600 >= 0.18 AND (re - le) / 600 >= 0.02 AND shared >= 0.4 AS two_columns FROM l""")
def column_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return layout.column_layout(b, pages(b))


@query(f"""WITH {BOXES}, {COLUMNS}, t AS (SELECT doc_id, page, round((le + re) / 2, 3) AS split_x FROM l WHERE gap / 600 >= 0.18 AND (re - le) / 600 >= 0.02 AND shared >= 0.4),
  p AS (SELECT b.*, split_x, split_x IS NOT NULL AS two, (y0 <= 80 OR y0 >= 680 OR x1 - x0 >= 432 OR coalesce(x0 < split_x AND split_x < x1 AND x1 - x0 >= 270, false)) AS spanning FROM b LEFT JOIN t USING (doc_id, page)),
  q AS (SELECT *, CASE WHEN NOT two OR spanning THEN 0 WHEN (x0 + x1) / 2 < split_x THEN 1 ELSE 2 END AS column_index FROM p),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, idx) AS k FROM q),
  m AS (SELECT *, CASE WHEN column_index = 0 THEN k ELSE coalesce((SELECT min(z.k) FROM f z WHERE z.doc_id = f.doc_id AND z.page = f.page AND z.column_index = 0 AND (f.y0 + f.y1) / 2 < z.y0), 1000000) END AS band FROM f),
  o AS (SELECT *, CASE WHEN two AND column_index > 0 THEN 'column' WHEN spanning THEN 'full_width' ELSE 'body' END AS region_type, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN two THEN band ELSE k END, CASE WHEN NOT two OR column_index = 0 THEN 3 ELSE column_index END, k)::INT AS reading_order FROM m),
  r AS (SELECT *, min(reading_order) OVER (PARTITION BY doc_id, page, region_type, column_index) AS first FROM o)
  SELECT doc_id, page, idx, reading_order, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY first)::INT AS region, region_type, column_index, CASE column_index WHEN 1 THEN 'body_left' WHEN 2 THEN 'body_right' ELSE region_type END AS layout_zone FROM r""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return layout.reading_order(b, pages(b))


_LINES = """a AS (SELECT *, CASE WHEN y0 - lag(y0) OVER w <= 10 THEN 0 ELSE 1 END AS cut FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, text)),
  o AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INT AS line FROM a)"""


@query(f"WITH {BOXES}, {_LINES} SELECT doc_id, page, idx, line FROM o")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ocr_lines(ocr(spark, sf_dir)).select("doc_id", "page", "idx", "line")


@query(f"""WITH {BOXES}, {_LINES}, l AS (SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY x0, idx) AS t FROM o GROUP BY ALL)
  SELECT doc_id, page, string_agg(t, chr(10) ORDER BY line) AS text, count(*) AS n_lines FROM l GROUP BY doc_id, page""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_text(ocr(spark, sf_dir))


_BINS = """d AS (SELECT *, CASE WHEN x0 - lag(x0) OVER w <= 20 THEN 0 ELSE 1 END AS cut FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY x0, idx)),
  e AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page ORDER BY x0, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM d),
  v AS (SELECT doc_id, page, cluster, avg(x0) AS center, count(*) AS n FROM e GROUP BY ALL)"""


@query(f"WITH {BOXES}, {_BINS} SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY cluster) - 1)::INT AS bin, round(center, 6) AS center, n FROM v WHERE n >= 3")
def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_bins(ocr(spark, sf_dir)).withColumn("center", F.round("center", 6))


@query(f"""WITH {BOXES}, {_LINES}, {_BINS}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY cluster) AS bin FROM v WHERE n >= 2),
  t AS (SELECT o.doc_id, o.page, o.line, o.idx, arg_min(bin, (abs(center - x0), bin)) AS bin FROM o JOIN w ON w.doc_id = o.doc_id AND w.page = o.page GROUP BY ALL),
  h AS (SELECT doc_id, page, line, count(DISTINCT bin) AS hits FROM t GROUP BY ALL), m AS (SELECT doc_id, page, count(*) FILTER (hits >= 2) AS multi FROM h GROUP BY ALL), k AS (SELECT doc_id, page, count(*) AS bins FROM w GROUP BY ALL),
  p AS (SELECT doc_id, page, count(*) AS nb, max(line) AS nl FROM o GROUP BY ALL)
  SELECT p.doc_id, p.page, CASE WHEN nb < 4 OR nl < 2 OR multi IS NULL THEN 0 ELSE round_even(least(1, 0.5::DOUBLE * multi / nl + 0.3::DOUBLE * least(bins / 4, 1) + 0.2::DOUBLE * least(nb / (nl * bins), 1)), 3) END AS table_likelihood FROM p LEFT JOIN m USING (doc_id, page) LEFT JOIN k USING (doc_id, page)""")
def table_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_likelihood(ocr(spark, sf_dir))


@query(f"""WITH {BOXES}, {_LINES}, {_BINS}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY cluster) AS bin FROM v WHERE n >= 3), k AS (SELECT doc_id, page, count(*) AS columns FROM w GROUP BY ALL),
  t AS (SELECT o.doc_id, o.page, o.line, o.idx, arg_min(w.bin, (abs(center - x0), w.bin)) AS bin, min(abs(center - x0)) AS far FROM o JOIN w ON w.doc_id = o.doc_id AND w.page = o.page GROUP BY ALL),
  u AS (SELECT doc_id, page, line, count(DISTINCT bin) FILTER (far <= 28) AS hits, count(*) FILTER (far > 28) AS orphans FROM t GROUP BY ALL),
  h AS (SELECT doc_id, page, count(*) AS n_rows, avg((hits >= 2)::INT) AS aligned, avg((hits < 2)::INT) AS irregular, sum(orphans)::BIGINT AS orphans FROM u JOIN k USING (doc_id, page) WHERE columns >= 2 GROUP BY doc_id, page),
  g AS (SELECT doc_id, page, coalesce(columns, 0) AS columns, coalesce(n_rows, 0) AS n_rows, coalesce(aligned, 0)::DOUBLE AS aligned, coalesce(irregular, 1)::DOUBLE AS irregular, coalesce(orphans, 0)::BIGINT AS orphans FROM (SELECT DISTINCT doc_id, page FROM b) LEFT JOIN k USING (doc_id, page) LEFT JOIN h USING (doc_id, page)),
  c AS (SELECT *, greatest(0, least(1, 0.30::DOUBLE + 0.35::DOUBLE * aligned + 0.15::DOUBLE * least(columns / 3, 1) + 0.10::DOUBLE * least(n_rows / 4, 1) - 0.35::DOUBLE * irregular)) AS score,
    list_filter([CASE WHEN n_rows < 3 THEN 'OCR_TABLE_INSUFFICIENT_ROWS' END, CASE WHEN columns < 2 OR aligned < 0.75 THEN 'OCR_TABLE_COLUMN_INCONSISTENT' END, CASE WHEN irregular > 0.25 THEN 'OCR_TABLE_IRREGULAR_ROWS' END,
      CASE WHEN orphans > 0 THEN 'OCR_TABLE_ORPHAN_TOKEN' END, CASE WHEN n_rows = 0 THEN 'OCR_TABLE_EMPTY' END], lambda x: x IS NOT NULL) AS codes FROM g)
  SELECT doc_id, page, columns, n_rows AS "rows", round_even(aligned, 3) AS aligned_row_ratio, 0.0::DOUBLE AS key_value_pattern_ratio, round_even(irregular, 3) AS irregular_row_ratio, 0.0::DOUBLE AS numeric_column_ratio, orphans, round_even(score, 3) AS confidence,
    CASE WHEN len(codes) = 0 AND score >= 0.6 THEN 'accepted' ELSE 'fallback_to_text' END AS decision,
    array_to_string(codes || CASE WHEN len(codes) = 0 AND score >= 0.6 THEN ['OCR_TABLE_CANDIDATE_ACCEPTED'] ELSE ['OCR_TABLE_LOW_CONFIDENCE', 'OCR_TABLE_REJECTED', 'OCR_TABLE_FALLBACK_TO_TEXT'] END, ',') AS reason_codes FROM c""")
def table_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says of pages of boxes at random places; tables and key-value pages are in the tests."""
    return layout.table_gate(ocr(spark, sf_dir)).withColumn("reason_codes", F.array_join("reason_codes", ","))


@query(f"""WITH {BOXES}, c AS (SELECT * FROM b WHERE idx % 5 = 0), t AS (SELECT * FROM b WHERE idx % 5 = 1),
  j AS (SELECT c.doc_id, c.page, c.idx AS caption, t.idx AS tab, least(abs(t.y0 - c.y1), abs(c.y0 - t.y1)) AS gap, greatest(0, least(c.x1, t.x1) - greatest(c.x0, t.x0)) / greatest(1, least(c.x1 - c.x0, t.x1 - t.x0)) AS al FROM c JOIN t USING (doc_id, page))
  SELECT doc_id, page, caption, tab AS "table", gap FROM j WHERE gap <= 64 AND al >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id, page, caption ORDER BY gap, -al, tab) = 1""")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    captions = b.filter("idx % 5 = 0").withColumn("text", F.concat(F.lit("Table "), F.col("idx").cast("string"), F.lit(": x")))
    return layout.nearest_captions(captions, b.filter("idx % 5 = 1"), pages(b))


@query(f"""WITH {BOXES}, r AS (SELECT p.doc_id, p.page, p.idx AS a, q.idx AS b, greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) / greatest(1, (p.x1 - p.x0) * (p.y1 - p.y0)) AS ratio
  FROM b p JOIN b q ON p.doc_id = q.doc_id AND p.page = q.page AND p.idx < q.idx) SELECT doc_id, page, a, b, round(ratio, 6) AS ratio FROM r WHERE ratio >= 0.2""")
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overlapping_pairs(boxes(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {BOXES}, w AS (SELECT * FROM b WHERE idx % 2 = 0), t AS (SELECT * FROM b WHERE idx % 2 = 1)
  SELECT doc_id, idx FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = w.doc_id AND t.page = w.page AND w.x0 >= t.x0 - 60 AND w.y0 >= t.y0 - 60 AND w.x1 <= t.x1 + 60 AND w.y1 <= t.y1 + 60)""")
def words_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return layout.outside(b.filter("idx % 2 = 0"), b.filter("idx % 2 = 1"), 60.0).select("doc_id", "idx")


@query(f"WITH {BOXES} SELECT doc_id, page, round_even(avg(conf), 3) AS confidence FROM b GROUP BY doc_id, page HAVING avg(conf) < 0.45")
def low_confidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.low_confidence_pages(ocr(spark, sf_dir), 0.45)


@query(f"WITH {BOXES} SELECT doc_id, min(x0) AS x0, min(y0) AS y0, max(x0) AS x1, max(y0) AS y1 FROM b GROUP BY doc_id")
def overall_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overall_box(ocr(spark, sf_dir), "doc_id")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey % 4 <> 0 AS digital, l_discount AS ratio FROM lineitem)
  SELECT doc_id, CASE WHEN bool_and(digital) THEN 'digital' WHEN NOT bool_or(digital) THEN 'scanned' ELSE 'mixed' END AS mode, count(*) FILTER (digital) AS digital_pages, count(*) FILTER (NOT digital) AS scanned_pages, count(*) FILTER (ratio * 4 >= 0.2) AS raster_pages FROM p GROUP BY doc_id""")
def page_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.when(F.col("l_partkey") % 4 != 0, "text").otherwise(" ").alias("text"), (F.col("l_discount") * 4).alias("image_ratio"))
    return layout.page_modes(p)


@query()
def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential within a page, so tested apart."""
    return layout.paragraphs(boxes(spark, sf_dir))
