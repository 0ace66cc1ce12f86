"""Queries over trees, tables and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import scalars
from quireflow.operators import layout, model, tables
from quireflow.plans.registry import query, table


def geography(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Regions as headings, nations as sheets, customers as paragraphs, below a root per region.

    broken sends some customers astray, and gives each region a chain of 150, and a ring of three with a tail of two.
    """
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    null = F.lit(None).cast("string")
    ids = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    regions = r.select(F.col("r_regionkey").alias("doc_id"), ids("r", "r_regionkey").alias("id"), F.lit(model.ROOT).alias("parent_id"), F.lit(1).alias("ordinal"), F.lit("heading").alias("type"), F.concat(F.lit("# "), "r_name").alias("content"), null.alias("place"))
    nations = n.select(F.col("n_regionkey").alias("doc_id"), ids("n", "n_nationkey").alias("id"), ids("r", "n_regionkey").alias("parent_id"), (F.col("n_nationkey") + 2).cast("int").alias("ordinal"), F.lit("sheet").alias("type"), F.lit("").alias("content"), F.col("n_name").alias("place"))
    up = ids("n", "c_nationkey")
    if broken:
        up = F.when(F.col("c_custkey") % 50 == 0, "nowhere").when(F.col("c_custkey") % 77 == 0, ids("c", "c_custkey")).otherwise(up)
    customers = c.join(F.broadcast(n.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc_id"), ids("c", "c_custkey").alias("id"), up.alias("parent_id"), (F.col("c_custkey") + 100).cast("int").alias("ordinal"), F.lit("paragraph").alias("type"), F.col("c_name").alias("content"), null.alias("place"))
    every = regions.unionByName(nations).unionByName(customers)
    if broken:
        odd = [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y1", "x1"), ("y2", "y1"), *((f"d{k}", f"d{k - 1}" if k > 1 else model.ROOT) for k in range(1, 151))]
        links = ", ".join(f"struct('{a}' AS id, '{b}' AS parent_id)" for a, b in odd)
        more = r.select(F.col("r_regionkey").alias("doc_id"), F.posexplode(F.expr(f"array({links})")).alias("no", "e"))
        every = every.unionByName(more.select("doc_id", "e.id", "e.parent_id", (F.col("no") + 1000).alias("ordinal"), F.lit("paragraph").alias("type"), F.lit("x").alias("content"), null.alias("place")))
    return model.with_roots(every)


@query("""SELECT n_regionkey AS doc_id, 'c' || c_custkey AS id, r_name || ' > Sheet: ' || n_name AS heading_path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, 'r' || r_regionkey, '' FROM region UNION ALL SELECT r_regionkey, 'document-root', '' FROM region""")
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.heading_paths(geography(spark, sf_dir)).select("doc_id", "id", F.array_join("heading_path", " > ").alias("heading_path"))


@query("""SELECT n_regionkey AS doc_id, 'c' || c_custkey AS id, 'r' || n_regionkey AS nearest_id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT r_regionkey, 'r' || r_regionkey, NULL FROM region UNION ALL SELECT r_regionkey, 'document-root', NULL FROM region""")
def nearest_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.nearest(geography(spark, sf_dir), ("heading",))


@query("""SELECT n_regionkey AS doc_id, 'c' || c_custkey AS id, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 'n' || n_nationkey, n_name FROM nation
  UNION ALL SELECT r_regionkey, 'r' || r_regionkey, NULL FROM region UNION ALL SELECT r_regionkey, 'document-root', NULL FROM region""")
def inherited_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.inherited(geography(spark, sf_dir), "place")


@query("""SELECT id, count(*)::BIGINT AS n_ancestors FROM (SELECT 'c' || c_custkey AS id, unnest(range(3)) FROM customer UNION ALL SELECT 'n' || n_nationkey, unnest(range(2)) FROM nation UNION ALL SELECT 'r' || r_regionkey, unnest(range(1)) FROM region) GROUP BY id""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.closure(geography(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n_ancestors"))


@query("""SELECT n_regionkey AS doc_id, 'c' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 0 OR c_custkey % 77 = 0
  UNION ALL SELECT r_regionkey, unnest(['x1', 'x2', 'x3', 'y1', 'y2']) FROM region""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.unreachable(geography(spark, sf_dir, broken=True))


@query("""SELECT n_regionkey AS doc_id, 'c' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 77 = 0 AND c_custkey % 50 <> 0
  UNION ALL SELECT r_regionkey, unnest(['x1', 'x2', 'x3']) FROM region""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.on_cycles(geography(spark, sf_dir, broken=True))


@query("""SELECT r_regionkey AS doc_id, 'document-root' AS id, 'r' || r_regionkey AS children FROM region UNION ALL SELECT n_regionkey, 'r' || n_regionkey, string_agg('n' || n_nationkey, ',' ORDER BY n_nationkey) FROM nation GROUP BY n_regionkey
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, coalesce(string_agg('c' || c_custkey, ',' ORDER BY c_custkey), '') FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey""")
def child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.with_children(geography(spark, sf_dir)).filter("type <> 'paragraph'").select("doc_id", "id", F.array_join("child_ids", ",").alias("children"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of nations per region: a header and two columns, as rows of values."""
    n = table(spark, sf_dir, "nation")
    rows = n.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    grid = F.concat(F.array(F.array(F.lit("n_nationkey"), F.lit("n_name"))), F.transform("ns", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return rows.select("doc_id", F.lit("table-0001").alias("table_id"), grid.alias("grid"))


@query("""WITH n AS (SELECT n_regionkey AS doc_id, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS r FROM nation)
  SELECT doc_id, 'table-0001' AS table_id, r AS "row", unnest([0, 1])::INT AS "column", unnest([n_nationkey::VARCHAR, n_name]) AS value, 1 AS rowspan, 1 AS colspan, false AS is_header FROM n
  UNION ALL SELECT r_regionkey, 'table-0001', 0, unnest([0, 1])::INT, unnest(['n_nationkey', 'n_name']), 1, 1, true FROM region""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grid_cells(_nations(spark, sf_dir))


@query("""SELECT n_regionkey AS doc_id, 'table-0001' AS table_id, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pipe_tables(tables.expanded(tables.grid_cells(_nations(spark, sf_dir))))


@query("""SELECT n_regionkey AS doc_id, 'table-0001' AS table_id, 'n_nationkey,n_name' || chr(13) || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(13) || chr(10), '' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.csv_tables(tables.expanded(tables.grid_cells(_nations(spark, sf_dir))))


@query("""SELECT n_regionkey AS doc_id, 'table-0001' AS table_id, '<table>' || chr(10) || '<tr>' || chr(10) || '<td>n_nationkey</td>' || chr(10) || '<td>n_name</td>' || chr(10) || '</tr>' || chr(10) ||
  string_agg('<tr>' || chr(10) || '<td>' || n_nationkey || '</td>' || chr(10) || '<td>' || n_name || '</td>' || chr(10) || '</tr>', chr(10) ORDER BY n_nationkey) || chr(10) || '</table>' AS text FROM nation GROUP BY n_regionkey""")
def html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.html_tables(tables.grid_cells(_nations(spark, sf_dir)))


@query("""SELECT n_regionkey AS doc_id, 'table-0001' AS table_id, (count(*) + 1)::INT AS "rows", 2 AS cols, false AS has_merged_cells, 'table-0001.csv' AS csv, 'table-0001.html' AS html, 'table-0001.json' AS json FROM nation GROUP BY n_regionkey""")
def table_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.index(tables.grid_cells(_nations(spark, sf_dir)))


_SHEET = "SELECT DISTINCT l_orderkey AS sheet, (l_linenumber + l_partkey % 3)::INT AS r, (l_suppkey % 7)::INT AS c FROM lineitem"


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    return item.select(F.col("l_orderkey").alias("sheet"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int").alias("row"), (F.col("l_suppkey") % 7).cast("int").alias("column")).distinct()


@query(f"""WITH s AS ({_SHEET}), b AS (SELECT *, r - dense_rank() OVER (PARTITION BY sheet ORDER BY r) AS band FROM s), t AS (SELECT *, c - dense_rank() OVER (PARTITION BY sheet, band ORDER BY c) AS strip FROM b),
  e AS (SELECT sheet, band, min(r) AS row_start, max(r) AS row_end FROM b GROUP BY ALL)
  SELECT sheet, row_start, row_end, min(c) AS col_start, max(c) AS col_end, count(*) AS n_cells FROM t JOIN e USING (sheet, band) GROUP BY sheet, band, strip, row_start, row_end""")
def sheet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sheet_blocks(_sheet(spark, sf_dir), "sheet")


@query(f"SELECT sheet, min(r) AS row_start, max(r) AS row_end, min(c) AS col_start, max(c) AS col_end FROM ({_SHEET}) GROUP BY sheet")
def used_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.used_region(_sheet(spark, sf_dir), "sheet")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, ((l_linenumber - 1) * 2 + l_partkey % 2)::INT AS r, (l_quantity % 3)::INT + 1 AS h FROM lineitem),
  p AS (SELECT doc_id, unnest(range(r, r + h)) AS x FROM c) SELECT doc_id, x::INT AS r, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1""")
def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row spans of a one-column table that meet."""
    item = table(spark, sf_dir, "lineitem")
    c = item.select(F.col("l_orderkey").alias("doc_id"), F.lit("t").alias("table_id"), ((F.col("l_linenumber") - 1) * 2 + F.col("l_partkey") % 2).cast("int").alias("row"), F.lit(0).alias("column"), ((F.col("l_quantity") % 3).cast("int") + 1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit("").alias("value"))
    return tables.overlaps(c).select("doc_id", "r", "n")


@query("""WITH n AS (SELECT p_partkey, (p_partkey % 700 + 1)::INT AS a, (p_partkey % 50 + 1)::INT AS b FROM part),
  l AS (SELECT *, CASE WHEN a > 26 THEN chr(64 + (a - 1) // 26) ELSE '' END || chr(65 + (a - 1) % 26) AS letters FROM n)
  SELECT p_partkey, letters || b || ':' || letters || (b + 3) AS label, a AS "left", b AS top, a AS "right", b + 3 AS bottom FROM l""")
def cell_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell ranges printed and parsed again."""
    a, b = (F.col("p_partkey") % 700 + 1).cast("int"), (F.col("p_partkey") % 50 + 1).cast("int")
    p = table(spark, sf_dir, "part").select("p_partkey", scalars.a1_label(a, b, a, b + 3).alias("label"))
    return p.withColumn("x", scalars.a1_bounds(F.col("label"))).select("p_partkey", "label", "x.*")


@query("""WITH e AS (SELECT user_id, event_id // 10 AS s, event_id // 10 + event_id % 7 AS t FROM events),
  c AS (SELECT *, CASE WHEN s <= max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS cut FROM e),
  r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c)
  SELECT user_id, min(s) AS "start", max(t) AS "end", count(*) AS n FROM r GROUP BY user_id, run""")
def locator_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ranges that touch, joined per user."""
    s = F.floor(F.col("event_id") / 10)
    e = table(spark, sf_dir, "events").select("user_id", s.alias("start"), (s + F.col("event_id") % 7).alias("end"))
    return layout.merged_ranges(e, ("user_id",))
