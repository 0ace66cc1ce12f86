"""The element tree: normal form, synthetic root, ancestors, reachability and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.scalars import locator_precision
from quireflow.lineage import stored
from quireflow.schemas import ELEMENTS, schema

ROOT = "document-root"


def normalized(elements: DataFrame, fmt: Column, engine: Column) -> DataFrame:
    """Elements with all canonical columns: missing ones null, engine and precision filled in, parentless ones below the root."""
    have = {f.name for f in elements.schema.fields}
    e = elements.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(ELEMENTS).fields), fmt.alias("__fmt"), engine.alias("__engine"))
    e = e.withColumn("engine", F.coalesce("engine", "__engine")).withColumn("parent_id", F.coalesce("parent_id", F.lit(ROOT)))
    e = e.withColumn("heading_path", F.coalesce("heading_path", F.expr("cast(array() AS array<string>)"))).withColumn("properties", F.coalesce("properties", F.expr("cast(map() AS map<string,string>)")))
    precision = F.coalesce("locator_precision", locator_precision(F.col("__fmt"), F.col("engine"), F.col("source_locator")))
    return e.withColumn("locator_precision", precision).drop("__fmt", "__engine")


def with_roots(elements: DataFrame) -> DataFrame:
    """Elements and a root row for each document."""
    own = {"id": F.lit(ROOT), "ordinal": F.lit(0), "type": F.lit("document"), "content": F.lit("")}
    roots = elements.select("doc_id").distinct().select(*(F.col("doc_id") if f.name == "doc_id" else own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in elements.schema.fields))
    return elements.unionByName(roots)


def with_children(elements: DataFrame) -> DataFrame:
    """Adds child_ids, in order; hot parents cost a list of their own children only."""
    kids = elements.filter(F.col("parent_id").isNotNull()).groupBy("doc_id", F.col("parent_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.col("id").alias("child")))), lambda x: x["child"]).alias("child_ids"))
    return elements.join(kids, ["doc_id", "id"], "left").withColumn("child_ids", F.coalesce("child_ids", F.expr("cast(array() AS array<string>)")))


def parents(elements: DataFrame) -> DataFrame:
    """(doc_id, id, ancestor_id): the elements whose parent exists. Of an id that several elements have, the least parent counts."""
    up = elements.filter(F.col("parent_id").isNotNull()).groupBy("doc_id", "id").agg(F.min("parent_id").alias("ancestor_id"))
    return up.join(elements.select("doc_id", F.col("id").alias("ancestor_id")), ["doc_id", "ancestor_id"], "left_semi").select("doc_id", "id", "ancestor_id")


def closure(elements: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, ancestor_id, distance): every element's ancestors, nearest at distance 1, however deep the tree. rings is on_cycles(elements), where it is at hand.

    Path lengths double: with ancestors up to 2^k known, those up to 2^(k+1) come of one join, so depth d takes log2(d) joins.
    Elements on a cycle have no ancestors, those below one have the ancestors up to its first element: if an element
    meets itself, which is seen as soon as the paths are as long as the cycle, the cycle's links are taken out and the work begins anew.
    """
    up = parents(elements)
    found = _closure(up) if rings is None else None
    return found or _closure(up.join(rings if rings is not None else on_cycles(elements), ["doc_id", "id"], "left_anti"))


def _closure(up: DataFrame) -> DataFrame | None:
    known = stored(up.withColumn("distance", F.lit(1)), "ancestors")
    own = F.col("id") == F.col("ancestor_id")
    if not known.filter(own).isEmpty():
        return None
    reach = 1
    while True:
        far = known.filter(F.col("distance") == reach).select("doc_id", "id", F.col("ancestor_id").alias("mid"))
        more = far.join(known.select("doc_id", F.col("id").alias("mid"), "ancestor_id", "distance"), ["doc_id", "mid"]).select("doc_id", "id", "ancestor_id", (F.col("distance") + reach).alias("distance"))
        more = stored(more, "ancestors")  # read twice by the next round
        if more.isEmpty():
            return known
        if not more.filter(own).isEmpty():
            return None
        known = known.unionByName(more)
        reach *= 2


def label(kind: Column, content: Column, place: Column) -> Column:
    """What an ancestor adds to a heading path: null for most."""
    place = F.coalesce(place.cast("string"), F.lit("?"))
    return F.when(kind == "sheet", F.concat(F.lit("Sheet: "), place)).when(kind == "page", F.concat(F.lit("Page "), place)).when(kind == "slide", F.concat(F.lit("Slide "), place)).when(kind == "heading", F.nullif(F.regexp_replace(content, r"\A[# ]+", ""), F.lit("")))


def heading_paths(elements: DataFrame, place: str = "place", up: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, heading_path): labels of the ancestors, outermost first. up is closure(elements), where it is at hand."""
    labels = elements.select("doc_id", F.col("id").alias("ancestor_id"), label(F.col("type"), F.col("content"), F.col(place)).alias("label")).filter("label IS NOT NULL")
    labelled = (up or closure(elements)).join(labels, ["doc_id", "ancestor_id"])
    path = labelled.groupBy("doc_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("distance", "label")), asc=False), lambda x: x["label"]).alias("heading_path"))
    return elements.select("doc_id", "id").join(path, ["doc_id", "id"], "left").withColumn("heading_path", F.coalesce("heading_path", F.expr("cast(array() AS array<string>)")))


def nearest(elements: DataFrame, kinds: tuple[str, ...], up: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, nearest_id): the nearest ancestor of one of the kinds."""
    wanted = elements.filter(F.col("type").isin(*kinds)).select("doc_id", F.col("id").alias("ancestor_id"))
    near = (up or closure(elements)).join(wanted, ["doc_id", "ancestor_id"]).groupBy("doc_id", "id").agg(F.min_by("ancestor_id", "distance").alias("nearest_id"))
    return elements.select("doc_id", "id").join(near, ["doc_id", "id"], "left")


def inherited(elements: DataFrame, column: str, up: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, column): the element's own value, or that of the nearest ancestor that has one."""
    has = elements.filter(F.col(column).isNotNull())
    own = has.select("doc_id", "id", F.lit(0).alias("distance"), column)
    above = (up or closure(elements)).join(has.select("doc_id", F.col("id").alias("ancestor_id"), column), ["doc_id", "ancestor_id"]).select("doc_id", "id", "distance", column)
    return elements.select("doc_id", "id").join(own.unionByName(above).groupBy("doc_id", "id").agg(F.min_by(column, "distance").alias(column)), ["doc_id", "id"], "left")


def unreachable(elements: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """Elements with no path to their document's root."""
    rooted = (up or closure(elements)).filter(F.col("ancestor_id") == ROOT).select("doc_id", "id").distinct()
    return elements.filter(F.col("id") != ROOT).select("doc_id", "id").join(rooted, ["doc_id", "id"], "left_anti")


def on_cycles(elements: DataFrame) -> DataFrame:
    """(doc_id, id) of the elements that are on a cycle; those that only lead to one are not.

    Pointers double until no element runs out of parents any more (all that are left lead to a cycle) and the elements
    pointed at stay the same number: these then are the cycles, as a step from them leads to all of them again.
    """
    at = stored(parents(elements).withColumnRenamed("ancestor_id", "to"), "pointers")
    count = lambda df: (df.count(), df.select("doc_id", "to").distinct().count())
    before = count(at)
    while before[0]:
        next_ = at.select("doc_id", F.col("id").alias("to"), F.col("to").alias("next"))
        at = stored(at.join(next_, ["doc_id", "to"]).select("doc_id", "id", F.col("next").alias("to")), "pointers")
        now = count(at)
        if now == before:
            break
        before = now
    return at.select("doc_id", F.col("to").alias("id")).distinct()


def ordered_unique(c: Column) -> Column:
    """First-seen order, without nulls."""
    return F.array_compact(F.array_distinct(c))


def sibling_order(elements: DataFrame) -> DataFrame:
    return elements.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("ordinal", "id")))
