"""Bounded chunks: splitting, packing, coalescing of ordered elements, context prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions.scalars import SPACE, blank, strip

LIMIT = 2000
#: What ends a line, Unicode's separators included.
LINE = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
NONE = "cast(array() AS array<string>)"


def cut_line(line: Column, limit: Column | int = LIMIT) -> Column:
    """A stripped line in parts of at most limit characters: at the last blank unless that is in the first half, else hard."""
    n = limit if isinstance(limit, Column) else F.lit(limit)
    half = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    pattern = F.format_string(r"(?s)(?U)\s*+(.{1,%d}\z|.{%d,%d}(?= )|.{%d})", n, half, n, n)
    return F.transform(F.regexp_extract_all(line, pattern, F.lit(1)), lambda p: F.regexp_replace(p, r"(?U)\s+\z", ""))


def _fold(units: Column, limit: int, joint: str) -> Column:
    """Units packed greedily, joint between those of a part."""
    start = F.struct(F.expr(NONE).alias("done"), F.lit(None).cast("string").alias("now"))

    def step(s: Column, u: Column) -> Column:
        fits = s["now"].isNull() | (F.length(s["now"]) + len(joint) + F.length(u) <= limit)
        now = F.when(s["now"].isNull(), u).when(fits, F.concat(s["now"], F.lit(joint), u)).otherwise(u)
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), now.alias("now"))

    return F.aggregate(units, start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def cut_pipe_table(lines: Column, limit: int = LIMIT) -> Column:
    """A pipe table's lines in parts that each repeat the header; a row that is too long is cut under it."""
    header = F.concat(lines[0], F.lit("\n"), lines[1])
    start = F.struct(F.expr(NONE).alias("done"), header.alias("now"))

    def step(s: Column, row: Column) -> Column:
        fits = F.length(s["now"]) + 1 + F.length(row) <= limit
        flushed = F.when(s["now"] != header, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        whole = F.length(header) + 1 + F.length(row) <= limit
        rows = F.transform(cut_line(row, F.greatest(F.lit(1), limit - F.length(header) - 1)), lambda p: F.concat(header, F.lit("\n"), p))
        done = F.when(fits, s["done"]).when(whole, flushed).otherwise(F.concat(flushed, rows))
        now = F.when(fits, F.concat(s["now"], F.lit("\n"), row)).when(whole, F.concat(header, F.lit("\n"), row)).otherwise(header)
        return F.struct(done.alias("done"), now.alias("now"))

    end = lambda s: F.when((s["now"] != header) | (F.size(s["done"]) == 0), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
    parts = F.aggregate(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), start, step, end)
    return F.when(F.length(header) > limit, F.flatten(F.transform(lines, lambda x: cut_line(x, limit)))).otherwise(parts)


def split_text(text: Column, limit: int = LIMIT) -> Column:
    """Parts of at most limit characters: paragraphs, else lines or table rows, else words, packed with blank lines between."""
    whole = strip(text)

    def units(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, LINE), strip), lambda x: x != "")
        table = (F.size(lines) >= 2) & F.get(lines, F.lit(0)).startswith("|") & F.get(lines, F.lit(1)).rlike(r"\A\|?(?U)\s*:?-+")
        return F.when(F.length(block) <= limit, F.array(block)).when(table, cut_pipe_table(lines, limit)).otherwise(F.flatten(F.transform(lines, lambda x: cut_line(x, limit))))

    blocks = F.filter(F.transform(F.split(whole, r"(?U)\n\s*\n"), strip), lambda x: x != "")
    packed = _fold(F.flatten(F.transform(blocks, units)), limit, "\n\n")
    return F.when(whole == "", F.expr(NONE)).when(F.length(whole) <= limit, F.array(whole)).otherwise(packed)


def split_plain(text: Column, limit: int = LIMIT) -> Column:
    """Parts of at most limit characters of text without structure: one that fits stays as it is, and of a longer one only LF ends a line and only blanks part words."""
    half = max(1, limit // 2)
    # A line's first part keeps the blanks it begins with.
    pattern = rf"(?s)(?:\A|(?!\A) *+)(.{{1,{limit}}}\z|.{{{half},{limit}}}(?= )|.{{{limit}}})"
    trimmed = lambda x: F.rtrim(x)
    cut = lambda x: F.when(F.length(x) <= limit, F.array(trimmed(x))).otherwise(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), trimmed))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    packed = _fold(F.flatten(F.transform(lines, cut)), limit, "\n\n")
    return F.when(text == "", F.expr(NONE)).when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def text_chunks(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", split: Callable[[Column, int], Column] = split_text) -> DataFrame:
    """Chunks of documents of one element each: numbered from 1, with part counts. No shuffle."""
    d = docs.select(key, split(F.coalesce("text", F.lit("")), limit).alias("parts"))
    d = d.select(key, F.size("parts").alias("part_count"), F.posexplode("parts").alias("no", "text"))
    return d.select(key, (F.col("no") + 1).alias("chunk_index"), (F.col("no") + 1).alias("part_index"), "part_count", "text", F.length("text").alias("char_count"))


def leaves(elements: DataFrame) -> DataFrame:
    """Elements with content that are nobody's parent and not a root."""
    parents = elements.select("doc_id", F.col("parent_id").alias("id")).filter("id IS NOT NULL").distinct()
    return elements.filter(F.col("type") != "document").filter(~blank(F.col("content"))).join(parents, ["doc_id", "id"], "left_anti")


def coalesced(elements: DataFrame, limit: int = LIMIT, cut: bool = True) -> DataFrame:
    """Chunks of leaf elements (doc_id, id, parent_id, ordinal, type, content, heading_path), in order.

    Neighbours are joined while parent and heading path stay and the text fits; headings and elements of several parts
    stand alone. Without cut, an element that is longer than limit is a chunk as it is. A document's elements are folded in one expression, as each step
    depends on the one before.
    """
    e = elements.select("doc_id", F.struct("ordinal", "id", "parent_id", "type", F.coalesce("heading_path", F.expr(NONE)).alias("path"), F.regexp_replace("content", r"\A[# ]+", "").alias("own"), (split_text(F.col("content"), limit) if cut else F.array(strip(F.col("content")))).alias("parts")).alias("e"))
    d = e.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("es"))
    chunk = "struct<path: array<string>, ids: array<string>, text: string, part_index: int, part_count: int>"
    pend = "named_struct('path', s.path, 'ids', s.ids, 'text', s.text, 'part_index', 1, 'part_count', 1)"
    flushed = f"CASE WHEN size(s.ids) > 0 THEN concat(s.done, array({pend})) ELSE s.done END"
    path = "CASE WHEN e.type = 'heading' THEN concat(e.path, array(e.own)) ELSE e.path END"
    apart = f"(e.type = 'heading' OR size(e.parts) != 1 OR (size(s.ids) > 0 AND (NOT e.parent_id <=> s.parent OR s.path != p OR length(s.text) + length(e.parts[0]) + 2 > {limit})))"
    state = lambda done, ids, text, parent, way: f"named_struct('done', {done}, 'ids', {ids}, 'text', {text}, 'parent', {parent}, 'path', {way})"
    empty = (NONE, "''", "cast(null AS string)", NONE)
    one = "named_struct('path', p, 'ids', array(e.id), 'text', e.parts[0], 'part_index', 1, 'part_count', 1)"
    many = "transform(e.parts, (t, k) -> named_struct('path', p, 'ids', array(e.id), 'text', t, 'part_index', k + 1, 'part_count', size(e.parts)))"
    step = f"""CASE WHEN e.type = 'heading' AND size(e.parts) = 1 THEN {state(f"concat({flushed}, array({one}))", *empty)}
      WHEN size(e.parts) != 1 THEN {state(f"concat({flushed}, {many})", *empty)}
      WHEN {apart} OR size(s.ids) = 0 THEN {state(flushed, "array(e.id)", "e.parts[0]", "e.parent_id", "p")}
      ELSE {state("s.done", "concat(s.ids, array(e.id))", "concat(s.text, '\\n\\n', e.parts[0])", "e.parent_id", "p")} END"""
    inner = f"transform(array({path}), p -> {step})[0]"
    chunks = f"aggregate(es, {state(f'cast(array() AS array<{chunk}>)', *empty)}, (s, e) -> {inner}, s -> {flushed})"
    out = d.select("doc_id", F.posexplode(F.expr(chunks)).alias("no", "c"))
    index = F.col("no") + 1
    return out.select("doc_id", F.format_string("chunk-%05d", index).alias("chunk_id"), index.alias("chunk_index"), F.col("c.part_index"), F.col("c.part_count"), F.col("c.path").alias("heading_path"), F.col("c.ids").alias("element_ids"), F.col("c.text"), F.length("c.text").alias("char_count"))


def with_context(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds context_prefix, context_truncated and embedding_text: whole context lines as far as the text leaves room.

    A line that is too long is left out, and a later, shorter one may still get in. Columns that a chunk table lacks count as empty.
    """
    have = set(chunks.columns)
    many = lambda c, joint: F.when(F.size(c) > 0, F.array_join(c, joint)) if c in have else F.lit(None).cast("string")
    one = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    fields = [("heading_path", many("heading_path", " > ")), ("section_element_id", one("section_element_id")), ("unit_element_id", one("unit_element_id")), ("relation_types", many("relation_types", ", ")), ("related_element_ids", many("related_element_ids", ", ")), ("layout_region_ids", many("layout_region_ids", ", "))]
    lines = F.filter(F.array(*(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"[{k}: "), v, F.lit("]"))) for k, v in fields)), lambda x: x.isNotNull())
    start = F.lit("")

    def step(prefix: Column, line: Column) -> Column:
        longer = F.when(prefix == "", line).otherwise(F.concat(prefix, F.lit("\n"), line))
        return F.when(F.length(longer) + 2 + F.length("text") <= limit, longer).otherwise(prefix)

    c = chunks.withColumn("__lines", lines).withColumn("__kept", F.aggregate("__lines", start, step))
    prefix = F.when(F.col("__kept") != "", F.concat("__kept", F.lit("\n\n"))).otherwise("")
    c = c.withColumn("context_prefix", prefix).withColumn("context_truncated", F.col("__kept") != F.array_join("__lines", "\n"))
    return c.withColumn("context_char_count", F.length("context_prefix")).withColumn("embedding_text", F.concat("context_prefix", "text")).withColumn("embedding_char_count", F.length("embedding_text")).drop("__lines", "__kept")


__all__ = ["LIMIT", "SPACE", "coalesced", "cut_line", "cut_pipe_table", "leaves", "split_plain", "split_text", "text_chunks", "with_context"]
