"""Tables: grids, anchor cells, spans, and their renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.scalars import SAFE_ID, csv_field, escape_html, escape_pipe
from quireflow.operators.parts import dealt


def rectangular(grid: Column) -> Column:
    """Rows padded with null to the widest."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), width - F.size(r))))


def grid_cells(tables: DataFrame, grid: str = "grid") -> DataFrame:
    """The grid as anchor cells of one row and column each, the first row as header. No shuffle."""
    keys = [c for c in tables.columns if c != grid]
    rows = tables.select(*keys, F.posexplode(rectangular(F.col(grid))).alias("row", "__r"))
    cells = rows.select(*keys, "row", F.posexplode("__r").alias("column", "value"))
    return cells.select(*keys, "row", "column", "value", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), (F.col("row") == 0).alias("is_header"))


def summary(cells: DataFrame) -> DataFrame:
    """Dimensions and whether anything is merged, per table."""
    return cells.groupBy("doc_id", "table_id").agg(F.max(F.col("row") + F.col("rowspan")).alias("n_rows"), F.max(F.col("column") + F.col("colspan")).alias("n_columns"), F.bool_or((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("merged"), F.count("*").alias("n_cells"))


def covered(cells: DataFrame) -> DataFrame:
    """Every position of every span: (doc_id, table_id, r, c, row, column, value), row and column being the anchor's."""
    r = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)).alias("r")
    c = F.explode(F.sequence(F.col("column"), F.col("column") + F.col("colspan") - 1)).alias("c")
    return cells.select("doc_id", "table_id", "row", "column", "colspan", "value", r).select("doc_id", "table_id", "row", "column", "value", "r", c)


def expanded(cells: DataFrame) -> DataFrame:
    """The grid of each table with merged values repeated, as rows of ordered values."""
    w = Window.partitionBy("doc_id", "table_id", "r", "c").orderBy("row", "column")
    first = covered(cells).withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    row = first.groupBy("doc_id", "table_id", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "value"))), lambda x: x["value"]).alias("values"))
    return row.select("doc_id", "table_id", F.col("r").alias("row"), "values")


def overlaps(cells: DataFrame) -> DataFrame:
    """Positions that more than one span covers. They are dealt out by document and row, so that one table's are many parts."""
    at = ("doc_id", "table_id", "r", "c")
    return dealt(covered(cells).select(*at), "doc_id", "r").groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1")


def _lines(rows: DataFrame, line: Column, head: Column | None = None) -> DataFrame:
    """Per table the rows' lines joined in order; head is what follows the first line."""
    text = F.when((F.col("row") == 0) & F.lit(head is not None), F.concat(line, F.lit("\n"), head if head is not None else F.lit(""))).otherwise(line)
    return rows.groupBy("doc_id", "table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", text.alias("x")))), lambda s: s["x"]), "\n").alias("text"))


def pipe_tables(rows: DataFrame) -> DataFrame:
    """Pipe tables from (doc_id, table_id, row, values): the first row is the header."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("values", escape_pipe), " | "), F.lit(" |"))
    dashes = F.concat(F.lit("| "), F.array_join(F.transform("values", lambda _: F.lit("---")), " | "), F.lit(" |"))
    return _lines(rows, line, dashes)


def csv_tables(rows: DataFrame) -> DataFrame:
    """CSV with CRLF line ends; nulls are empty, spans flattened."""
    line = F.concat(F.array_join(F.transform("values", csv_field), ","), F.lit("\r"))
    return _lines(rows, line).select("doc_id", "table_id", F.concat("text", F.lit("\n")).alias("text"))


def html_tables(cells: DataFrame) -> DataFrame:
    """HTML from anchor cells, with their spans; rows without anchors stay as empty rows."""
    size = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))).otherwise("")
    td = F.concat(F.lit("<td"), size("rowspan"), size("colspan"), F.lit(">"), escape_html(F.col("value")), F.lit("</td>"))
    row = cells.groupBy("doc_id", "table_id", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column", td.alias("td")))), lambda x: x["td"]), "\n").alias("tds"))
    last = summary(cells).select("doc_id", "table_id", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
    full = last.join(row, ["doc_id", "table_id", "row"], "left")
    body = F.concat(F.lit("<tr>\n"), F.when(F.col("tds").isNotNull(), F.concat("tds", F.lit("\n"))).otherwise(""), F.lit("</tr>"))
    return _lines(full, body).select("doc_id", "table_id", F.concat(F.lit("<table>\n"), "text", F.lit("\n</table>")).alias("text"))


def index(cells: DataFrame) -> DataFrame:
    """The table index: sizes, merges and asset names, for tables with safe ids."""
    s = summary(cells).filter(F.col("table_id").rlike(SAFE_ID))
    asset = lambda kind: F.concat("table_id", F.lit("." + kind)).alias(kind)
    return s.select("doc_id", "table_id", F.col("n_rows").alias("rows"), F.col("n_columns").alias("cols"), F.col("merged").alias("has_merged_cells"), asset("csv"), asset("html"), asset("json"))


def used_region(cells: DataFrame, *by: str) -> DataFrame:
    """The bounds of what a sheet really holds, from (row, column)."""
    return cells.groupBy(*by).agg(F.min("row").alias("row_start"), F.max("row").alias("row_end"), F.min("column").alias("col_start"), F.max("column").alias("col_end"))


def sheet_blocks(cells: DataFrame, *by: str) -> DataFrame:
    """Blocks that blank rows, and within those blank columns, separate: runs of consecutive numbers, twice."""
    rank = lambda of, *part: F.col(of) - F.dense_rank().over(Window.partitionBy(*by, *part).orderBy(of))
    own = cells.filter("row IS NOT NULL AND column IS NOT NULL").withColumn("band", rank("row")).withColumn("strip", rank("column", "band"))
    band = Window.partitionBy(*by, "band")
    own = own.withColumns({"row_start": F.min("row").over(band), "row_end": F.max("row").over(band)})
    strips = own.groupBy(*by, "band", "strip", "row_start", "row_end").agg(F.min("column").alias("col_start"), F.max("column").alias("col_end"), F.count("*").alias("n_cells"))
    return strips.select(*by, "row_start", "row_end", "col_start", "col_end", "n_cells")
