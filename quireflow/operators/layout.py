"""Page geometry: columns, reading order, lines and tables of OCR boxes, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.scalars import overlap_ratio

PAGE = ("doc_id", "page")
LINE_TOLERANCE, COLUMN_TOLERANCE, ROWS, COLUMNS, ORPHAN = 10, 20, 3, 2, 28
#: Bands of a page at most in which boxes meet.
BANDS = 1024


def islands(rows: DataFrame, by: tuple[str, ...], value: str, tolerance: float, name: str, *ties: str) -> DataFrame:
    """Numbers runs in which each value is within tolerance of the one before, from 1."""
    w = Window.partitionBy(*by).orderBy(value, *ties)
    gap = F.when(F.col(value) - F.lag(value).over(w) <= tolerance, 0).otherwise(1)
    return rows.withColumn("__gap", gap).withColumn(name, F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__gap")


def meeting(a: DataFrame, b: DataFrame, by: tuple[str, ...] = PAGE, slack: Column | float = 0.0) -> DataFrame:
    """(by, a, ax0 ... , b, bx0 ...): pairs of boxes of a page, one of each side, whose heights meet within slack.

    The page is cut into as many bands as it has boxes, at most BANDS; boxes that share one meet in the first they share. So a page costs what
    there is at equal heights, not the square of its boxes. slack may be a column of a.
    """
    edges = a.select(*by, "y0", "y1").unionByName(b.select(*by, "y0", "y1"))
    extent = edges.groupBy(*by).agg(F.min("y0").alias("top"), F.greatest((F.max("y1") - F.min("y0")) / F.least(F.count("*"), F.lit(BANDS)), F.lit(1e-9)).alias("band"))
    wide = slack if isinstance(slack, Column) else F.lit(float(slack))

    def dealt(boxes: DataFrame, side: str, more: Column) -> DataFrame:
        at = lambda y: F.floor((y - F.col("top")) / F.col("band"))
        d = boxes.join(extent, list(by)).withColumn("first", at(F.col("y0") - more)).withColumn("last", at(F.col("y1") + more))
        keep = [F.col(c).alias(side + c) for c in ("x0", "y0", "x1", "y1")]
        return d.select(*by, F.col("idx").alias(side), *keep, F.col("first").alias(side + "first"), more.alias(side + "more"), F.explode(F.sequence("first", F.greatest("first", "last"))).alias("at"))

    met = dealt(a, "a", wide).join(dealt(b, "b", F.lit(0.0)), [*by, "at"]).filter(F.col("at") == F.greatest("afirst", "bfirst"))
    close = (F.col("by0") <= F.col("ay1") + F.col("amore")) & (F.col("ay0") - F.col("amore") <= F.col("by1"))
    return met.filter(close).drop("at", "afirst", "bfirst", "amore", "bmore")


def overlapping_pairs(boxes: DataFrame, least: float = 0.2) -> DataFrame:
    """(page keys, a, b, ratio): pairs of a page's boxes that share at least that part of the first one's area."""
    ratio = overlap_ratio(*(F.col(f"{s}{c}") for s in "ab" for c in ("x0", "y0", "x1", "y1")))
    return meeting(boxes, boxes).filter("a < b").withColumn("ratio", ratio).filter(F.col("ratio") >= least).select(*PAGE, "a", "b", "ratio")


def column_layout(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page whether two columns stand side by side, where they part, and the evidence. pages has page_width."""
    narrow = blocks.join(pages, list(PAGE)).filter((F.trim("text") != "") & (F.col("x1") - F.col("x0") <= F.col("page_width") * 0.72))
    narrow = narrow.withColumn("center", (F.col("x0") + F.col("x1")) / 2)
    w = Window.partitionBy(*PAGE).orderBy("center", "idx")
    n = narrow.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.lead("center").over(w) - F.col("center")).withColumn("n", F.count("*").over(Window.partitionBy(*PAGE)))
    n = n.filter("n >= 4")
    split = F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("rank")).alias("first")))).over(Window.partitionBy(*PAGE))
    n = n.withColumn("__s", split).withColumn("left", F.col("rank") <= -F.col("__s.first"))
    side = lambda agg, c, left: agg(F.when(F.col("left") == left, F.col(c)))
    g = n.groupBy(*PAGE, "page_width").agg(
        F.first("__s.gap").alias("gap"), F.sum(F.col("left").cast("int")).alias("left_blocks"), F.sum((~F.col("left")).cast("int")).alias("right_blocks"),
        side(F.max, "x1", True).alias("left_edge"), side(F.min, "x0", False).alias("right_edge"),
        side(F.min, "y0", True).alias("ly0"), side(F.max, "y1", True).alias("ly1"), side(F.min, "y0", False).alias("ry0"), side(F.max, "y1", False).alias("ry1"),
    )
    g = g.filter("left_blocks >= 2 AND right_blocks >= 2")
    shared = F.greatest(F.lit(0.0), F.least("ly1", "ry1") - F.greatest("ly0", "ry0")) / F.greatest(F.lit(1.0), F.least(F.col("ly1") - F.col("ly0"), F.col("ry1") - F.col("ry0")))
    center, apart = F.col("gap") / F.col("page_width"), (F.col("right_edge") - F.col("left_edge")) / F.col("page_width")
    return g.select(*PAGE, F.round(center, 3).alias("center_gap_ratio"), F.round(apart, 3).alias("separation_ratio"), F.round(shared, 3).alias("vertical_overlap_ratio"), "left_blocks", "right_blocks", F.round((F.col("left_edge") + F.col("right_edge")) / 2, 3).alias("split_x"), ((center >= 0.18) & (apart >= 0.02) & (shared >= 0.4)).alias("two_columns"))


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Each block's place: single flow by (y, x), or on two-column pages bands between full-width blocks, left column before right.

    A column block belongs to the band before the first full-width block, in order, whose top is below its middle.
    """
    layout = column_layout(blocks, pages).filter("two_columns").select(*PAGE, "split_x")
    b = blocks.filter(F.trim("text") != "").join(pages, list(PAGE)).join(layout, list(PAGE), "left")
    width, two = F.col("x1") - F.col("x0"), F.col("split_x").isNotNull()
    crosses = F.coalesce((F.col("x0") < F.col("split_x")) & (F.col("split_x") < F.col("x1")), F.lit(False))
    spanning = (F.col("y0") <= F.col("page_height") * 0.1) | (F.col("y0") >= F.col("page_height") * 0.85) | (width >= F.col("page_width") * 0.72) | (crosses & (width >= F.col("page_width") * 0.45))
    column = F.when(~two | spanning, 0).when((F.col("x0") + F.col("x1")) / 2 < F.col("split_x"), 1).otherwise(2)
    b = b.withColumn("column_index", column).withColumn("region_type", F.when(two & (F.col("column_index") > 0), "column").when(spanning, "full_width").otherwise("body"))
    b = b.withColumn("__two", two).withColumn("key", F.struct("y0", "x0", "idx"))
    # On a page, the band of a column block is the least full-width block, in order, that starts below its middle: one sweep from below.
    at = F.when(F.col("column_index") > 0, (F.col("y0") + F.col("y1")) / 2).otherwise(F.col("y0"))
    sweep = Window.partitionBy(*PAGE).orderBy(at.desc(), F.when(F.col("column_index") > 0, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("fkey", F.min(F.when((F.col("column_index") == 0) & F.col("__two"), F.col("key"))).over(sweep))
    last = F.struct(F.lit(float("inf")).alias("y0"), F.lit(0.0).alias("x0"), F.lit(0).cast("int").alias("idx"))
    place = F.when(F.col("column_index") == 0, F.col("key")).otherwise(F.coalesce("fkey", last))
    own = F.when(~F.col("__two") | (F.col("column_index") == 0), 3).otherwise(F.col("column_index"))
    w = Window.partitionBy(*PAGE).orderBy(place, own, "key")
    out = b.withColumn("reading_order", F.row_number().over(w))
    first = F.min("reading_order").over(Window.partitionBy(*PAGE, "region_type", "column_index"))
    out = out.withColumn("__first", first).withColumn("region", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("__first")))
    zone = F.when(F.col("column_index") == 1, "body_left").when(F.col("column_index") == 2, "body_right").otherwise(F.col("region_type"))
    return out.select(*PAGE, "idx", "reading_order", "region", "region_type", "column_index", zone.alias("layout_zone"))


def ocr_lines(boxes: DataFrame) -> DataFrame:
    """Boxes with line: chained by their tops."""
    return islands(boxes, PAGE, "y", LINE_TOLERANCE, "line", "x", "text")


def page_text(boxes: DataFrame) -> DataFrame:
    """The page's lines, words from left to right."""
    lines = ocr_lines(boxes).groupBy(*PAGE, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "idx", "text"))), lambda t: t["text"]), " ").alias("text"))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda t: t["text"]), "\n").alias("text"), F.count("*").alias("n_lines"))


def column_bins(boxes: DataFrame, least: int = ROWS) -> DataFrame:
    """(page keys, bin, center, n): clusters of left edges that at least so many boxes have, from left to right, numbered from 0."""
    c = islands(boxes, PAGE, "x", COLUMN_TOLERANCE, "cluster", "idx").groupBy(*PAGE, "cluster").agg(F.avg("x").alias("center"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return c.select(*PAGE, (F.row_number().over(Window.partitionBy(*PAGE).orderBy("cluster")) - 1).alias("bin"), "center", "n")


def assigned(boxes: DataFrame, least: int = ROWS) -> DataFrame:
    """Boxes with line and the nearest column bin (the left one of equals) and how far it is. Bins are gathered per page."""
    bins = column_bins(boxes, least).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("bin", "center"))).alias("bins"))
    near = F.array_min(F.transform("bins", lambda b: F.struct(F.abs(b["center"] - F.col("x")).alias("far"), b["bin"].alias("bin"))))
    return ocr_lines(boxes).join(bins, list(PAGE)).withColumn("__n", near).select(*boxes.columns, "line", F.size("bins").alias("n_bins"), F.col("__n.bin").alias("bin"), F.col("__n.far").alias("far"))


def table_likelihood(boxes: DataFrame) -> DataFrame:
    """How tabular a page looks, 0 to 1: half for lines that hit two columns, 0.3 for columns, 0.2 for density."""
    all_ = ocr_lines(boxes).groupBy(*PAGE).agg(F.count("*").alias("n_boxes"), F.max("line").alias("n_lines"))
    hit = assigned(boxes, 2).groupBy(*PAGE, "line", "n_bins").agg(F.countDistinct("bin").alias("hits")).groupBy(*PAGE, "n_bins").agg(F.sum((F.col("hits") >= 2).cast("int")).alias("multi"))
    d = all_.join(hit, list(PAGE), "left")
    score = 0.5 * F.col("multi") / F.col("n_lines") + 0.3 * F.least(F.col("n_bins") / 4, F.lit(1.0)) + 0.2 * F.least(F.col("n_boxes") / (F.col("n_lines") * F.col("n_bins")), F.lit(1.0))
    return d.select(*PAGE, F.when((F.col("n_boxes") < 4) | (F.col("n_lines") < 2) | F.col("multi").isNull(), 0.0).otherwise(F.bround(F.least(score, F.lit(1.0)), 3)).alias("table_likelihood"))


def table_rows(boxes: DataFrame, far: float = ORPHAN) -> DataFrame:
    """(page keys, line, bin, value): the cells of a candidate table; boxes further than far from any column are left out."""
    a = assigned(boxes).filter(F.col("far") <= far)
    return a.groupBy(*PAGE, "line", "bin").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "idx", "text"))), lambda t: t["text"]), " ").alias("value"))


def table_gate(boxes: DataFrame) -> DataFrame:
    """Per page the signals, confidence, decision and reason codes of its table candidate."""
    lines = ocr_lines(boxes).groupBy(*PAGE, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "idx", "text"))), lambda t: t["text"]), " ").alias("text"))
    page = lines.groupBy(*PAGE).agg(F.avg(F.col("text").rlike(r"\A\s*[^:]{1,80}:\s*\S+").cast("int")).alias("kv"), F.count("*").alias("n_lines"))
    a = assigned(boxes)
    used = a.groupBy(*PAGE, "line", "n_bins").agg(F.countDistinct(F.when(F.col("far") <= ORPHAN, F.col("bin"))).alias("hits"), F.sum((F.col("far") > ORPHAN).cast("int")).alias("orphans"))
    hits = used.filter(F.col("n_bins") >= 2).groupBy(*PAGE, "n_bins").agg(F.count("*").alias("rows"), F.avg((F.col("hits") >= 2).cast("int")).alias("aligned"), F.avg((F.col("hits") < 2).cast("int")).alias("irregular"), F.sum("orphans").alias("orphans"))
    cells = table_rows(boxes).groupBy(*PAGE).agg(F.avg(F.col("value").rlike(r"\A(?:\d+\.?\d*|\.\d+)\z").cast("int")).alias("numeric"), F.bool_or(F.col("value").rlike(r"\d[A-Z]{2,}")).alias("glue"))
    bins = column_bins(boxes).groupBy(*PAGE).agg(F.count("*").alias("columns"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    d = page.join(bins, list(PAGE), "left").join(hits.drop("n_bins"), list(PAGE), "left").join(cells, list(PAGE), "left")
    has = F.col("rows").isNotNull()
    d = d.select(*PAGE, "kv", zero("columns", 0).alias("columns"), zero("rows", 0).alias("rows"), zero("aligned", 0.0).alias("aligned"), zero("irregular", 1.0).alias("irregular"), zero("orphans", 0).alias("orphans"), F.when(has, zero("numeric", 0.0)).otherwise(0.0).alias("numeric"), (has & zero("glue", False)).alias("glue"))
    score = 0.30 + 0.35 * F.col("aligned") + 0.15 * F.least(F.col("columns") / 3, F.lit(1.0)) + 0.10 * F.least(F.col("rows") / 4, F.lit(1.0)) + 0.10 * F.col("numeric") - 0.55 * F.col("kv") - 0.35 * F.col("irregular")
    d = d.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    code = lambda when, name: F.when(when, F.lit("OCR_TABLE_" + name))
    own = F.array_compact(F.array(
        code(F.col("kv") >= 0.5, "KEY_VALUE_PATTERN"), code(F.col("rows") < ROWS, "INSUFFICIENT_ROWS"), code((F.col("columns") < COLUMNS) | (F.col("aligned") < 0.75), "COLUMN_INCONSISTENT"),
        code(F.col("irregular") > 0.25, "IRREGULAR_ROWS"), code(F.col("orphans") > 0, "ORPHAN_TOKEN"), code(F.col("glue"), "SUSPICIOUS_GLUED_TOKEN"), code(F.col("rows") == 0, "EMPTY"),
    ))
    d = d.withColumn("__own", own).withColumn("accepted", (F.size("__own") == 0) & (F.col("confidence") >= 0.6))
    tail = F.when(F.col("accepted"), F.array(F.lit("OCR_TABLE_CANDIDATE_ACCEPTED"))).otherwise(F.array(*(F.lit("OCR_TABLE_" + x) for x in ("LOW_CONFIDENCE", "REJECTED", "FALLBACK_TO_TEXT"))))
    return d.select(*PAGE, "columns", "rows", F.bround("aligned", 3).alias("aligned_row_ratio"), F.bround("kv", 3).alias("key_value_pattern_ratio"), F.bround("irregular", 3).alias("irregular_row_ratio"), F.bround("numeric", 3).alias("numeric_column_ratio"), "orphans", F.bround("confidence", 3).alias("confidence"), F.when(F.col("accepted"), "accepted").otherwise("fallback_to_text").alias("decision"), F.concat("__own", tail).alias("reason_codes"))


CAPTION = r"(?iu)\A\s*(table|表)\s*(?:[0-9IVXivx一二三四五六七八九十]+|[:：])"


def nearest_captions(captions: DataFrame, tables: DataFrame, pages: DataFrame, near: float = 0.08, floor: float = 24.0) -> DataFrame:
    """(page keys, caption, table): each caption's nearest table of the page by (gap, alignment, id), if close and aligned. Boxes are (x0, y0, x1, y1)."""
    reach = F.greatest(F.col("page_height") * near, F.lit(floor))
    c = captions.filter(F.regexp_replace("text", r"\A[# ]+", "").rlike(CAPTION)).join(pages.select(*PAGE, reach.alias("reach")), list(PAGE))
    gap = F.least(F.abs(F.col("by0") - F.col("ay1")), F.abs(F.col("ay0") - F.col("by1")))
    alignment = F.greatest(F.lit(0.0), F.least("ax1", "bx1") - F.greatest("ax0", "bx0")) / F.greatest(F.lit(1.0), F.least(F.col("ax1") - F.col("ax0"), F.col("bx1") - F.col("bx0")))
    j = meeting(c, tables, PAGE, F.col("reach")).withColumnsRenamed({"a": "caption", "b": "table"}).join(pages.select(*PAGE, reach.alias("reach")), list(PAGE))
    j = j.withColumn("gap", gap).withColumn("alignment", alignment).filter((F.col("gap") <= F.col("reach")) & (F.col("alignment") >= 0.5))
    best = F.min(F.struct("gap", (-F.col("alignment")).alias("a"), "table"))
    return j.groupBy(*PAGE, "caption").agg(best.alias("b")).select(*PAGE, "caption", F.col("b.table").alias("table"), F.col("b.gap").alias("gap"))


def caption_edges(pairs: DataFrame) -> DataFrame:
    """Both directions of each caption's link, without repeats."""
    there = pairs.select("doc_id", F.col("caption").alias("src"), F.lit("caption_of").alias("relation"), F.col("table").alias("dst"))
    back = pairs.select("doc_id", F.col("table").alias("src"), F.lit("captioned_by").alias("relation"), F.col("caption").alias("dst"))
    return there.unionByName(back).distinct().withColumn("confidence", F.lit(0.95)).withColumn("method", F.lit("deterministic_rule_v1"))


def outside(words: DataFrame, boxes: DataFrame, slack: float = 2.0) -> DataFrame:
    """Words of a page that lie in none of its boxes."""
    inside = (F.col("ax0") >= F.col("bx0") - slack) & (F.col("ay0") >= F.col("by0") - slack) & (F.col("ax1") <= F.col("bx1") + slack) & (F.col("ay1") <= F.col("by1") + slack)
    held = meeting(words, boxes, PAGE, slack).filter(inside).select(*PAGE, F.col("a").alias("idx"))
    return words.join(held, [*PAGE, "idx"], "left_anti")


def page_modes(pages: DataFrame) -> DataFrame:
    """Per document digital, scanned or mixed, from pages with text; and pages whose pictures cover at least a fifth (image_ratio)."""
    digital = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    mode = F.when(F.bool_and(digital), "digital").when(~F.bool_or(digital), "scanned").otherwise("mixed")
    return pages.groupBy("doc_id").agg(mode.alias("mode"), F.sum(digital.cast("int")).alias("digital_pages"), F.sum((~digital).cast("int")).alias("scanned_pages"), F.sum((F.col("image_ratio") >= 0.2).cast("int")).alias("raster_pages"))


def low_confidence_pages(boxes: DataFrame, least: float = 0.75) -> DataFrame:
    return boxes.groupBy(*PAGE).agg(F.avg("conf").alias("__c")).filter(F.col("__c") < least).select(*PAGE, F.bround("__c", 3).alias("confidence"))


def overall_box(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def merged_ranges(ranges: DataFrame, by: tuple[str, ...], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges of whole numbers that touch or overlap, joined."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col(start) <= F.max(end).over(w) + 1, 0).otherwise(1)
    run = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    r = ranges.withColumn("__cut", cut).withColumn("__run", F.sum("__cut").over(run))
    return r.groupBy(*by, "__run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__run")


def paragraphs(lines: DataFrame, gap: float = 1.8, alignment: float = 0.5) -> DataFrame:
    """Text lines of a page (idx, x0, y0, x1, y1, text) grouped to paragraphs. Each line, from the top, joins the open paragraph
    whose last line is nearest above it, close and aligned enough; so this is sequential within a page, and only there."""
    import pandas as pd

    def run(page: pd.DataFrame) -> pd.DataFrame:
        reachable: dict[int, tuple] = {}  # a group's last line; lines come from the top, so what is too far above stays so
        number, n = {}, 0
        for r in page.sort_values(["y0", "x0", "idx"]).itertuples():
            best = None
            for k, p in list(reachable.items()):
                apart, height = r.y0 - p.y1, max(1.0, p.y1 - p.y0)
                if apart > gap * height:
                    del reachable[k]
                    continue
                shared = max(0.0, min(r.x1, p.x1) - max(r.x0, p.x0)) / max(1.0, min(r.x1 - r.x0, p.x1 - p.x0))
                if -height <= apart and shared >= alignment and (best is None or (apart, k) < best):
                    best = (apart, k)
            if best is None:
                n += 1
            at = best[1] if best else n
            reachable[at] = r
            number[r.idx] = at
        return pd.DataFrame({"doc_id": page["doc_id"], "page": page["page"], "idx": page["idx"], "paragraph": page["idx"].map(number).astype("int32")})

    return lines.groupBy(*PAGE).applyInPandas(run, "doc_id long, page int, idx int, paragraph int")


