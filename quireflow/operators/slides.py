"""Slides: where a flow is ambiguous, the reading plan of shapes, and the edges between notes and slides.

Shapes are rows of doc_id, slide, idx (their place in the file), role (title, center_title, footer, date, slide_number, body ... or none), material
(whether it has text, a table, a chart, a picture or is a group) and x0, y0, x1, y1, null where the file places none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.scalars import shared_area
from quireflow.operators.layout import meeting

SLIDE = ("doc_id", "slide")
TITLES, FOOTERS = ("title", "center_title"), ("footer", "date", "slide_number")
CORNERS = ("x0", "y0", "x1", "y1")


def located(shapes: DataFrame) -> DataFrame:
    """Shapes of substance that have a place and an extent."""
    return shapes.filter("material AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 > x0 AND y1 > y0")


def flows(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    """Per slide (slides: doc_id, slide, width, height): shapes, overlapping pairs, pairs side by side, where columns part, and whether the flow is ambiguous.

    A pair overlaps if it shares a fifth of the smaller one; it is side by side if it shares half of the smaller height, stands apart by a fiftieth
    of the width and neither is wider than 0.6 of it. Either needs a common height, so only shapes of common bands meet.
    """
    s = located(shapes)
    pairs = meeting(s, s, SLIDE).filter("a < b").join(slides.select(*SLIDE, "width"), list(SLIDE))
    box = lambda k: [F.col(k + c) for c in CORNERS]
    area = lambda k: F.greatest((F.col(k + "x1") - F.col(k + "x0")) * (F.col(k + "y1") - F.col(k + "y0")), F.lit(1.0))
    ratio = shared_area(*box("a"), *box("b")) / F.least(area("a"), area("b"))  # one division: a share of exactly a fifth counts
    shared = F.greatest(F.lit(0.0), F.least("ay1", "by1") - F.greatest("ay0", "by0")) / F.greatest(F.lit(1.0), F.least(F.col("ay1") - F.col("ay0"), F.col("by1") - F.col("by0")))
    wide = F.greatest("width", F.lit(1.0))
    apart = F.greatest(F.col("bx0") - F.col("ax1"), F.col("ax0") - F.col("bx1")) >= wide * 0.02
    narrow = F.greatest(F.col("ax1") - F.col("ax0"), F.col("bx1") - F.col("bx0")) <= wide * 0.6
    count = lambda when: F.sum(F.when(when, 1).otherwise(0))
    p = pairs.groupBy(*SLIDE).agg(count(ratio >= 0.2).alias("overlapping_pairs"), count((shared >= 0.5) & apart & narrow).alias("side_by_side_pairs"))
    n = s.groupBy(*SLIDE).agg(F.count("*").alias("material_shapes"))
    own = s.join(slides.select(*SLIDE, "width"), list(SLIDE)).filter((F.col("x1") - F.col("x0") <= F.greatest("width", F.lit(1.0)) * 0.65) & ~F.col("role").isin(*TITLES, *FOOTERS)).withColumn("center", (F.col("x0") + F.col("x1")) / 2)
    w = Window.partitionBy(*SLIDE).orderBy("center", "idx")
    gaps = own.withColumn("next", F.lead("center").over(w)).withColumn("rank", F.row_number().over(w)).filter("next IS NOT NULL")
    split = gaps.groupBy(*SLIDE).agg(F.max(F.struct((F.col("next") - F.col("center")).alias("gap"), (-F.col("rank")).alias("first"), ((F.col("next") + F.col("center")) / 2).alias("x"))).alias("g"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    d = slides.select(*SLIDE).join(n, list(SLIDE), "left").join(p, list(SLIDE), "left").join(split, list(SLIDE), "left")
    d = d.select(*SLIDE, zero("material_shapes"), zero("overlapping_pairs"), zero("side_by_side_pairs"), "g")
    signals = F.array_compact(F.array(F.when(F.col("overlapping_pairs") > 0, F.lit("material_shape_overlap")), F.when(F.col("side_by_side_pairs") > 0, F.lit("independent_side_by_side_flows"))))
    return d.select(*SLIDE, "material_shapes", "overlapping_pairs", "side_by_side_pairs", F.when(F.col("side_by_side_pairs") > 0, F.round("g.x", 3)).alias("split_x"), signals.alias("signals"), (F.size(signals) > 0).alias("ambiguous"))


def plan(shapes: DataFrame, slides: DataFrame) -> DataFrame:
    """Each shape's reading_order, zone, column, region, method and confidence.

    Titles come first and footers last; on slides with two columns and no overlap, full-width shapes cut bands, in which the left column comes before the
    right one: a column's shape belongs to the band before the first full-width one whose top is below its middle. Shapes of substance without a place
    follow, and the rest by top and left edge; the rest has no region.
    """
    a = flows(shapes, slides)
    s = shapes.join(slides.select(*SLIDE, "width", "height"), list(SLIDE)).join(a.select(*SLIDE, "split_x", "overlapping_pairs", "side_by_side_pairs", "ambiguous"), list(SLIDE))
    placed = F.coalesce(F.expr("material AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 > x0 AND y1 > y0"), F.lit(False))
    columns = F.col("split_x").isNotNull() & (F.col("side_by_side_pairs") > 0) & (F.col("overlapping_pairs") == 0)
    s = s.withColumn("placed", placed).withColumn("columns", columns)
    spanning = F.col("x1") - F.col("x0") >= F.greatest("width", F.lit(1.0)) * 0.72
    footer = F.col("role").isin(*FOOTERS) | (F.col("y0") >= F.greatest("height", F.lit(1.0)) * 0.9)
    left = (F.col("x0") + F.col("x1")) / 2 < F.col("split_x")
    zone = F.when(~F.col("placed"), F.when(F.col("material"), "freeform")).when(F.col("role").isin(*TITLES), "title").when(footer, "footer").when(F.col("columns") & ~spanning, F.when(left, "body_left").otherwise("body_right")).otherwise("body")
    s = s.withColumn("zone", zone).withColumn("column", F.when(F.col("zone") == "body_left", 1).when(F.col("zone") == "body_right", 2).otherwise(0))
    s = s.withColumn("key", F.struct("y0", "x0", "idx"))
    # The band of a column's shape: the first full-width one, in order, that starts below its middle. One sweep from below.
    full = F.col("placed") & (F.col("column") == 0)
    middle = F.when(F.col("column") > 0, (F.col("y0") + F.col("y1")) / 2).otherwise(F.col("y0"))
    sweep = Window.partitionBy(*SLIDE).orderBy(F.col("placed").desc(), middle.desc_nulls_last(), F.when(F.col("column") > 0, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("band", F.min(F.when(full, F.col("key"))).over(sweep))
    last = F.struct(F.lit(float("inf")).alias("y0"), F.lit(0.0).alias("x0"), F.lit(0).cast("int").alias("idx"))
    place = F.when(F.col("column") == 0, F.col("key")).otherwise(F.coalesce("band", last))
    own = F.when(F.col("column") == 0, 3).otherwise(F.col("column"))
    role = F.when(F.col("zone") == "title", 0).when(F.col("zone") == "footer", 2).otherwise(1)
    group = F.when(F.col("placed"), 0).when(F.col("material"), 1).otherwise(2)
    top, edge = F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0))
    first = F.when(F.col("columns"), 0).otherwise(role)
    w = Window.partitionBy(*SLIDE).orderBy(group, F.when(F.col("placed"), first), F.when(F.col("placed") & F.col("columns"), place), F.when(F.col("placed") & F.col("columns"), own), F.when(F.col("placed"), F.col("key")), top, edge, "idx")
    s = s.withColumn("reading_order", F.row_number().over(w))
    start = F.min(F.when(F.col("placed"), F.col("reading_order"))).over(Window.partitionBy(*SLIDE, "zone"))
    s = s.withColumn("start", start)
    s = s.withColumn("region", F.dense_rank().over(Window.partitionBy(*SLIDE).orderBy(F.col("start").asc_nulls_last())))
    method = F.when(~F.col("placed"), "stable_source_order_fallback_v1").when(F.col("columns"), "placeholder_role_columns_v1").when(F.col("overlapping_pairs") > 0, "geometry_top_left_ambiguous_v1").otherwise("placeholder_role_geometry_v1")
    confidence = F.when(~F.col("placed"), 0.5).when(F.col("columns"), 0.88).when(F.col("ambiguous"), 0.6).otherwise(0.95)
    material = lambda c: F.when(F.col("material"), c)
    region = F.when(F.col("placed"), F.format_string("slide-region-%02d", "region")).when(F.col("material"), "slide-region-unlocated")
    kind = F.when(~F.col("placed"), "unlocated").when(F.col("column") > 0, "column").otherwise(F.col("zone"))
    return s.select(*SLIDE, "idx", "reading_order", region.alias("region_id"), material(kind).alias("region_type"), material(F.col("column")).alias("column_index"), F.col("zone").alias("layout_zone"), material(confidence).alias("order_confidence"), material(method).alias("order_method"))


def note_edges(elements: DataFrame) -> DataFrame:
    """Both directions between each note of a slide and the slide: (doc_id, src, relation, dst, confidence, evidence, method)."""
    notes = elements.filter(F.col("type").isin("note", "speaker_note"))
    on_slide = notes.join(elements.filter("type = 'slide'").select("doc_id", F.col("id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
    both = F.explode(F.array(F.struct(F.col("id").alias("src"), F.lit("note_for").alias("relation"), F.col("parent_id").alias("dst")), F.struct(F.col("parent_id").alias("src"), F.lit("has_note").alias("relation"), F.col("id").alias("dst")))).alias("e")
    return on_slide.select("doc_id", both).select("doc_id", "e.*", F.lit(1.0).alias("confidence"), F.array(F.lit("ooxml_notes_relationship")).alias("evidence"), F.lit("deterministic_rule_v1").alias("method"))
