"""Where chunks come from: inherited locators, merged locators, ancestors, relations and layout, and what to measure of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.scalars import a1_bounds, a1_label
from quireflow.operators import model
from quireflow.operators.chunk import with_context
from quireflow.schemas import LOCATOR

#: Rectangles are counted cell by cell up to this area; beyond it each must span one whole side.
AREA = 1_000_000


def _types() -> dict[str, str]:
    """A locator's fields and their types, in the order of its struct."""
    out, part, depth = [], "", 0
    for c in LOCATOR.removeprefix("struct<").removesuffix(">") + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return dict(x.split(": ") for x in out)


TYPES = _types()
FIELDS = list(TYPES)
#: Fields that are numbers of a run, and its last.
RUNS = (("element_start", "element_end"), ("row_start", "row_end"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fills_rectangle(bounds: Column) -> Column:
    """Whether rectangles (left, top, right, bottom) leave no cell of their bounding rectangle free.

    Up to AREA cells they are counted: the strips between neighbouring edges of rows and columns, each all in or all out. Beyond that each
    rectangle must reach over the whole width or the whole height.
    """
    return _let(bounds, _fills)


def _fills(bounds: Column) -> Column:
    least = lambda f: F.array_min(F.transform(bounds, lambda b: b[f]))
    most = lambda f: F.array_max(F.transform(bounds, lambda b: b[f]))
    box = F.struct(least("left").alias("left"), least("top").alias("top"), most("right").alias("right"), most("bottom").alias("bottom"))
    area = lambda box: (box["right"].cast("long") - box["left"] + 1) * (box["bottom"].cast("long") - box["top"] + 1)
    edges = lambda low, high: F.array_sort(F.array_distinct(F.concat(F.transform(bounds, lambda b: b[low]), F.transform(bounds, lambda b: b[high] + 1))))
    inside = lambda x, y: F.exists(bounds, lambda b: (b["left"] <= x) & (x <= b["right"]) & (b["top"] <= y) & (y <= b["bottom"]))
    open_ = lambda e: F.slice(e, F.lit(1), F.size(e) - 1)  # noqa: E731  an edge begins a strip, but for the last
    full = _let(open_(edges("top", "bottom")), lambda ys: F.forall(open_(edges("left", "right")), lambda x: F.forall(ys, lambda y: inside(x, y))))
    spans = lambda box: F.forall(bounds, lambda b: ((b["left"] == box["left"]) & (b["right"] == box["right"])) | ((b["top"] == box["top"]) & (b["bottom"] == box["bottom"])))
    return _let(box, lambda box: F.when(area(box) <= AREA, full).otherwise(spans(box)))


def _locator(**values: Column) -> Column:
    """A locator with these fields, the others null."""
    return F.struct(*(values.get(f, F.lit(None)).cast(t).alias(f) for f, t in TYPES.items()))


def merged(locators: Column) -> Column:
    """A struct of locators, an array of one where they are compatible, and precision: null for one locator, else range.

    Cells of a sheet that fill a rectangle, shapes of a slide, pages that follow each other, and runs of elements or
    rows that touch become one locator, which keeps the source file if all have the same. What cannot be one stays a list, without repeats, in the order of first appearance.
    """
    distinct = F.array_distinct(F.filter(locators, lambda x: x.isNotNull()))

    def one(ls: Column, bounds: Column, shapes: Column, boxes: Column) -> Column:
        get = lambda f: F.transform(ls, lambda x: x[f])
        same = lambda f: F.size(F.array_distinct(get(f))) == 1
        known = lambda f: F.forall(ls, lambda x: x[f].isNotNull())
        first = F.get(ls, F.lit(0))
        fmt, of = first["format"], {"format": first["format"], "source_file": F.when(same("source_file"), first["source_file"])}
        edge = lambda agg, f: agg(F.transform(bounds, lambda b: b[f]))
        sheet = (fmt == "xlsx") & same("sheet_name") & F.forall(bounds, lambda b: b.isNotNull()) & fills_rectangle(bounds)
        cells = _locator(**of, sheet_name=first["sheet_name"], cell_range=a1_label(edge(F.array_min, "left"), edge(F.array_min, "top"), edge(F.array_max, "right"), edge(F.array_max, "bottom")))
        slide = (fmt == "pptx") & same("slide_number") & (F.size(shapes) > 0)
        start, end = F.array_min(get("page_start")), F.array_max(get("page_end"))
        pages = (fmt == "pdf") & known("page_start") & known("page_end") & (F.array_max(get("page_start")) <= F.array_min(get("page_end")) + 1)
        page = _locator(**of, page_start=start, page_end=end, bboxes=F.when((start == end) & (F.size(boxes) > 0), boxes))
        section = first["section_index"].isNull() | same("section_index")
        out = F.when(sheet, cells).when(slide, _locator(**of, slide_number=first["slide_number"], shape_ids=shapes)).when(pages, page)
        for a, b in RUNS:
            touch = known(a) & known(b) & section & (F.array_max(get(a)) <= F.array_min(get(b)) + 1)
            out = out.when(touch, _locator(**of, section_index=first["section_index"], **{a: F.array_min(get(a)), b: F.array_max(get(b))}))
        return F.when(same("format"), out)

    def joined(ls: Column) -> Column:
        bounds = F.transform(ls, lambda x: a1_bounds(x["cell_range"]))
        shapes = F.array_distinct(F.filter(F.flatten(F.transform(ls, lambda x: F.coalesce(F.when(F.size(x["shape_ids"]) > 0, x["shape_ids"]), F.array(x["shape_id"])))), lambda x: x.isNotNull()))
        shapes = F.transform(F.array_sort(F.transform(shapes, lambda x: F.struct(x.try_cast("long").alias("n"), x.alias("id")))), lambda x: x["id"])  # numbers by value
        boxes = F.flatten(F.transform(ls, lambda x: F.coalesce(x["bboxes"], F.expr("cast(array() AS array<array<double>>)"))))
        return F.when(F.size(ls) > 1, _let(bounds, lambda b: _let(shapes, lambda s: _let(boxes, lambda p: one(ls, b, s, p)))))

    def result(ls: Column) -> Column:
        found = _let(joined(ls), lambda j: F.when(j.isNotNull(), F.array(j)).otherwise(ls))
        return F.struct(found.alias("locators"), F.when(F.size(locators) > 1, F.when(F.size(ls) == 1, "exact").otherwise("range")).alias("precision"))

    return _let(distinct, result)


def resolved(elements: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, locator): each field of source_locator the element's own, or that of its nearest ancestor that has one. One pass over the closure."""
    has = elements.filter(F.col("source_locator").isNotNull())
    own = has.select("doc_id", "id", F.lit(0).alias("distance"), "source_locator")
    above = (up or model.closure(elements)).join(has.select("doc_id", F.col("id").alias("ancestor_id"), "source_locator"), ["doc_id", "ancestor_id"]).select("doc_id", "id", "distance", "source_locator")
    field = lambda f: F.min(F.when(F.col(f"source_locator.{f}").isNotNull(), F.struct("distance", F.col(f"source_locator.{f}").alias("v")))).getField("v").alias(f)
    found = own.unionByName(above).groupBy("doc_id", "id").agg(*map(field, FIELDS))
    return found.select("doc_id", "id", F.struct(*FIELDS).alias("locator"))


LISTS = ("table_ids", "ancestor_element_ids", "related_element_ids", "relation_types", "layout_region_ids", "layout_zones", "layout_order_methods", "column_indexes", "context_element_ids")


def chunk_provenance(chunks: DataFrame, elements: DataFrame, edges: DataFrame | None = None, up: DataFrame | None = None) -> DataFrame:
    """chunks (doc_id, chunk_id, element_ids) with where they come from: locators and their precision, table_ids, ancestors from the root on,
    section_element_id (the one heading above or at all elements, else null), unit_element_id (page, slide or sheet), relationships and what they name, and layout.

    elements has id, parent_id, type, source_locator, locator_precision, table_id and properties (layout fields by name); edges src, relation, dst, confidence,
    evidence and method. Lists are in the order of the elements, first seen first; the rows that meet are those of the chunks' elements alone.
    """
    up = up if up is not None else model.closure(elements)
    kind = elements.select("doc_id", F.col("id").alias("ancestor_id"), "type")
    path = up.join(kind, ["doc_id", "ancestor_id"])
    above = path.groupBy("doc_id", "id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("type") != "document", F.struct("distance", "ancestor_id"))), asc=False), lambda x: x["ancestor_id"]).alias("ancestors"),
        F.min_by("ancestor_id", F.when(F.col("type") == "heading", F.col("distance"))).alias("heading_above"), F.min_by("ancestor_id", F.when(F.col("type").isin("page", "slide", "sheet"), F.col("distance"))).alias("unit_above"),
    )
    e = elements.select("doc_id", "id", "type", "locator_precision", "table_id", "properties").join(above, ["doc_id", "id"], "left").join(resolved(elements, up), ["doc_id", "id"], "left")
    none = F.expr("cast(array() AS array<string>)")
    if edges is None:
        edge = "array<struct<source_element_id: string, relation: string, target_element_id: string, confidence: double, evidence: array<string>, method: string>>"
        e = e.withColumn("relationships", F.expr(f"cast(array() AS {edge})"))
    else:
        one = F.struct(F.col("src").alias("source_element_id"), "relation", F.col("dst").alias("target_element_id"), "confidence", "evidence", "method")
        e = e.join(edges.groupBy("doc_id", F.col("src").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("relationships")), ["doc_id", "id"], "left")
    mine = lambda when, above_: F.when(when, F.col("id")).otherwise(F.col(above_))
    layout = lambda k: F.try_element_at("properties", F.lit(k))
    e = e.select(
        "doc_id", F.col("id").alias("element_id"), "locator", F.coalesce("locator_precision", F.lit("unknown")).alias("precision"), "table_id", F.coalesce("ancestors", none).alias("ancestors"), "relationships",
        mine(F.col("type") == "heading", "heading_above").alias("section"), mine(F.col("type").isin("page", "slide", "sheet"), "unit_above").alias("unit"),
        *(layout(k).alias(k) for k in ("region_id", "layout_zone", "order_method", "column_index")),
    )
    rest = [c for c in e.columns if c not in ("doc_id", "element_id")]
    ref = chunks.select("doc_id", "chunk_id", F.posexplode("element_ids").alias("at", "element_id")).join(e, ["doc_id", "element_id"])
    g = ref.groupBy("doc_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("at", F.struct(*rest).alias("e")))).alias("es"))
    each = lambda f: F.transform("es", lambda x: x["e"][f])
    single = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    g = g.withColumn("m", merged(each("locator"))).withColumn("relationships", F.flatten(F.filter(each("relationships"), lambda x: x.isNotNull())))
    related = model.ordered_unique(F.transform("relationships", lambda r: r["target_element_id"]))
    ancestors = F.array_distinct(F.flatten(each("ancestors")))
    g = g.select(
        "doc_id", "chunk_id", F.col("m.locators").alias("source_locators"), F.coalesce("m.precision", F.get(each("precision"), F.lit(0))).alias("locator_precision"), model.ordered_unique(each("table_id")).alias("table_ids"), ancestors.alias("ancestor_element_ids"),
        single(model.ordered_unique(each("section"))).alias("section_element_id"), single(model.ordered_unique(each("unit"))).alias("unit_element_id"), related.alias("related_element_ids"), model.ordered_unique(F.transform("relationships", lambda r: r["relation"])).alias("relation_types"), "relationships",
        model.ordered_unique(each("region_id")).alias("layout_region_ids"), model.ordered_unique(each("layout_zone")).alias("layout_zones"), model.ordered_unique(each("order_method")).alias("layout_order_methods"), model.ordered_unique(each("column_index")).alias("column_indexes"),
        F.array_distinct(F.concat(ancestors, related)).alias("context_element_ids"),
    )
    out = chunks.select(*(c for c in chunks.columns if c not in g.columns or c in ("doc_id", "chunk_id"))).join(g, ["doc_id", "chunk_id"], "left")
    filled = {c: F.coalesce(F.col(c), none) for c in LISTS}
    return out.withColumns(filled | {"locator_precision": F.coalesce("locator_precision", F.lit("unknown"))})


def records(chunks: DataFrame, elements: DataFrame, documents: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Whole chunk records: provenance, flat locator fields, context and embedding text, and the document's file and hash (documents: doc_id, source_file, sha256)."""
    c = with_context(chunk_provenance(chunks, elements, edges))
    at = F.when(F.size("source_locators") == 1, F.get("source_locators", F.lit(0)))
    c = c.join(documents.select("doc_id", "source_file", F.col("sha256").alias("source_sha256")), "doc_id", "left")
    return c.withColumns({
        "schema_version": F.lit("1.0"), "consumer_contract_version": F.lit("1.0"), "context_policy": F.lit("source_text_priority_v1"), "source_file": F.coalesce(at["source_file"], "source_file"), "page_start": at["page_start"],
        "page_end": F.coalesce(at["page_end"], at["page_start"]), "sheet_name": at["sheet_name"], "slide_start": at["slide_number"], "slide_end": at["slide_number"],
    })


def fallback_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, part_index, part_count, text): the Markdown of documents without a chunk, cut. Each part counts as the first."""
    from quireflow.operators.chunk import text_chunks

    left = documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.col("markdown").alias("text"))
    c = text_chunks(left)
    return c.select("doc_id", F.format_string("chunk-%05d", "chunk_index").alias("chunk_id"), "chunk_index", F.lit(1).alias("part_index"), "part_count", "text")


def metrics(chunks: DataFrame, elements: DataFrame, *by: str) -> DataFrame:
    """Per group of by: chunks, those with locators, with one locator, with exact ones, elements referred to, and references to no element."""
    refs = chunks.select(*by, "doc_id", F.explode("element_ids").alias("id"))
    known = elements.select("doc_id", "id", F.lit(True).alias("known")).distinct()
    r = refs.join(known, ["doc_id", "id"], "left").groupBy(*by).agg(F.count_distinct("doc_id", "id").alias("referenced_elements"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("unresolved_references"))
    n = F.coalesce(F.size("source_locators"), F.lit(0))
    whole = lambda when, name: F.sum(F.when(when, 1).otherwise(0)).alias(name)
    c = chunks.groupBy(*by).agg(F.count("*").alias("chunk_count"), whole(n > 0, "located_chunks"), whole(n == 1, "single_locator_chunks"), whole(F.col("locator_precision") == "exact", "exact_chunks"))
    return c.join(r, list(by), "left").na.fill(0, ["referenced_elements", "unresolved_references"])


#: Fields of a chunk that are derived from its elements, and compared with what is derived anew.
DERIVED = ("ancestor_element_ids", "section_element_id", "unit_element_id", "related_element_ids", "relation_types", "relationships", "layout_region_ids", "layout_zones", "layout_order_methods", "column_indexes", "context_element_ids")


def context_issues(chunks: DataFrame, elements: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(doc_id, code, subject): fields of chunks that differ from what their elements give."""
    again = chunk_provenance(chunks.select("doc_id", "chunk_id", "element_ids"), elements, edges).select("doc_id", "chunk_id", F.struct(*DERIVED).alias("again"))
    j = chunks.join(again, ["doc_id", "chunk_id"])
    wrong = [F.when(~F.col(f).eqNullSafe(F.col(f"again.{f}")), F.lit(f)) for f in DERIVED if f in chunks.columns]
    field = j.select("doc_id", "chunk_id", F.explode(F.array_compact(F.array(*wrong))).alias("field"))
    return field.select("doc_id", F.lit("CHUNK_CONTEXT_INCONSISTENT").alias("code"), F.concat_ws(":", "chunk_id", "field").alias("subject"))


__all__ = ["chunk_provenance", "context_issues", "fallback_chunks", "fills_rectangle", "merged", "metrics", "records", "resolved"]
