"""Column functions: escapes, normal forms, counters, addresses and predicates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids that are safe in file names, and what an edge may say.
SAFE_ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"
RELATIONS = ("caption_of", "captioned_by", "note_for", "has_note")
#: White space as Unicode has it; Java's own \s and trim() know only ASCII's.
SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def escape_pipe(c: Column) -> Column:
    """A cell for a pipe table: | gets a backslash, line ends become <br>."""
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", "<br>")


def escape_html(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def link_label(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), "[\r\n]", " ")
    return F.replace(F.replace(c, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def csv_field(c: Column) -> Column:
    """Quoted where a comma, a quote or a line end asks for it; null is empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


#: What full case folding does to characters that are lower case already, as the interpreter's Unicode tables have it.
FOLDS = {x: x.casefold() for x in map(chr, range(0x80, 0x1F000)) if x.lower() == x and x.casefold() != x}


#: The one of them that is common has a way of its own; where the others lie, roughly and in runs, which keeps the classes that every character is held against short.
SHARP_S = "\u00df"
RARE = sorted(set(FOLDS) - {SHARP_S})
ROUGHLY = "[\\x{b5}\\x{149}-\\x{10ffff}]"


def _runs(chars: list[str]) -> str:
    """A class of sorted characters, neighbours as ranges."""
    runs: list[list[int]] = []
    for x in map(ord, chars):
        if runs and x == runs[-1][1] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def folded(c: Column) -> Column:
    """Full case folding: lower case, and what folding does beyond it where a text has such a character."""
    low = F.lower(c)
    usual = F.replace(low, F.lit(SHARP_S), F.lit(FOLDS[SHARP_S]))
    one = [x for x in RARE if len(FOLDS[x]) == 1]
    each = F.translate(usual, "".join(one), "".join(FOLDS[x] for x in one))
    for x in RARE:
        if len(FOLDS[x]) > 1:
            each = F.replace(each, F.lit(x), F.lit(FOLDS[x]))
    return F.when(low.rlike(ROUGHLY) & low.rlike(_runs(RARE)), each).otherwise(usual)


def comparable(c: Column) -> Column:
    """White space collapsed and trimmed, case folded: what counts as the same text in a scorecard. Single blanks, which are most, are left alone."""
    return folded(F.trim(F.regexp_replace(c, r"(?U)(?: \s|[^\S ])\s*+", " ")))


def reviewable(c: Column) -> Column:
    """comparable(), without markup characters: what a reviewed text must still hold."""
    return comparable(F.regexp_replace(c, r"[`*_\[\]()<>|]", ""))


MOJIBAKE = "[�\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"


def mojibake_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MOJIBAKE))


TOKEN = r"https?://[^\s)\]>]+|\b\d{4}-\d{2}-\d{2}\b|\b\d{2,3}年\d{1,2}月\d{1,2}日|\btable-[A-Za-z0-9._-]+\b|\$[\d,]+(?:\.\d+)?|\b\d+(?:\.\d+)?%|\b\d+(?:\.\d+)?\b"
UNSAFE = r"(?i)<\s*/?\s*(?:script|iframe|object|embed|style|svg)\b|(?:javascript|vbscript|data)\s*:|\b(?:python|shell|bash|powershell|cmd|file)\s*[:(]|(?:\.\.?[/\\]|/etc/|file://)"


def protected_tokens(c: Column) -> Column:
    """URLs, dates, table ids, amounts, percentages and numbers, in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def unsafe(c: Column) -> Column:
    return c.rlike(UNSAFE)


def glued(c: Column) -> Column:
    """Whether words seem to have lost their spaces: a case change inside a long token, a very long one, capitals with digits, or two of medium length."""
    tokens = F.filter(F.split(c, SPACE), lambda t: t != "")
    cores = F.transform(tokens, lambda t: F.regexp_replace(t, "[^A-Za-z]", ""))
    changed = F.exists(cores, lambda t: (F.length(t) >= 6) & t.rlike("[a-z][A-Z]"))
    return changed | F.exists(cores, lambda t: F.length(t) >= 14) | F.exists(tokens, lambda t: t.rlike(r"\A[A-Z]{6,}\d+\z")) | (F.size(F.filter(cores, lambda t: F.length(t) >= 9)) >= 2)


def majority_latin(c: Column) -> Column:
    latin = F.regexp_count(c, F.lit("[A-Za-z]"))
    return latin > F.regexp_count(c, F.lit("[\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff\\u3040-\\u30ff\\uac00-\\ud7af]"))


def plausibility(c: Column) -> Column:
    """Share of plausible characters among the first 2000, less twice that of control characters; 0 for no text."""
    s = F.substring(c, 1, 2000)
    good = F.regexp_count(s, F.lit("[\\n\\r\\t\\x20-\\x7e\\u3000-\\u303f\\u4e00-\\u9fff\\u3400-\\u4dbf\\uff00-\\uffef\\u2018-\\u201f]"))
    bad = F.regexp_count(s, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"))
    return F.when(F.length(s) == 0, 0.0).otherwise((good - 2 * bad) / F.length(s))


def json_depth(c: Column) -> Column:
    """Depth of brackets outside strings, by source; closing ones never go below 0."""
    bare = F.regexp_replace(F.regexp_replace(c, r'"(?:[^"\\]++|\\.)*+(?:"|\z)', ""), r"[^\[\]{}]", "")
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        depth = F.when(x.isin("[", "{"), s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), F.greatest(s["most"], depth).alias("most"))

    return F.aggregate(F.filter(F.split(bare, ""), lambda x: x != ""), state, step, lambda s: s["most"])


def column_number(letters: Column) -> Column:
    """Base 26: A is 1."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def column_letters(n: Column) -> Column:
    """The inverse of column_number, up to seven letters."""
    state = F.struct(n.cast("int").alias("n"), F.lit("").alias("s"))

    def step(s: Column, _: Column) -> Column:
        low = F.pmod(s["n"] - 1, F.lit(26))
        more = s["n"] > 0
        return F.struct(F.when(more, F.floor((s["n"] - 1) / 26).cast("int")).otherwise(0).alias("n"), F.when(more, F.concat(F.char(low + 65), s["s"])).otherwise(s["s"]).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), state, step, lambda s: s["s"])


def a1_bounds(c: Column) -> Column:
    """(left, top, right, bottom) of a cell range, null if it is none."""
    pattern = r"\A\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?\z"
    g = [F.regexp_extract(c, pattern, k) for k in (1, 2, 3, 4)]
    right, bottom = F.when(g[2] != "", g[2]).otherwise(g[0]), F.when(g[3] != "", g[3]).otherwise(g[1])
    return F.when(c.rlike(pattern), F.struct(column_number(g[0]).alias("left"), g[1].cast("int").alias("top"), column_number(right).alias("right"), bottom.cast("int").alias("bottom")))


def a1_label(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.concat(column_letters(left), top.cast("string"), F.lit(":"), column_letters(right), bottom.cast("string"))


def span(c: Column) -> Column:
    """A whole number of at least 1, else 1."""
    n = c.try_cast("int")
    return F.when(n >= 1, n).otherwise(1)


def shared_area(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))


def overlap_ratio(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Area that two boxes share, of the first one's area (at least 1)."""
    return shared_area(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) / F.greatest((ax1 - ax0) * (ay1 - ay0), F.lit(1.0))


def cell_text(value: Column, number_format: Column) -> Column:
    """A date as ISO; its time only if the number format shows hours."""
    timed = F.coalesce(F.lower(number_format), F.lit("")).rlike("h|:")
    return F.when(timed, F.date_format(value, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.date_format(value, "yyyy-MM-dd"), F.lit("T"), F.date_format(value, "HH:mm:ss")))


def formula_text(formula: Column, cached: Column, link: Column) -> Column:
    """A cell's text: the cached value, or the formula with a mark where there is none; a hyperlink wraps it."""
    is_formula = F.coalesce(formula.startswith("="), F.lit(False))
    text = F.when(~is_formula | cached.isNotNull(), F.coalesce(cached, F.lit(""))).otherwise(F.concat(formula, F.lit(" <!-- formula result unavailable -->")))
    label = F.when(text != "", text).otherwise(link)
    return F.when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit("["), label, F.lit("]("), link, F.lit(")"))).otherwise(text)


def styled(text: Column, bold: Column, italic: Column) -> Column:
    marks = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    return F.when(blank(text), text).otherwise(F.concat(marks, text, marks))


def heading_level(style: Column) -> Column:
    """1 to 6 for a style named Heading n or Title, else null."""
    n = F.regexp_extract(F.lower(style), r"heading\s*(\d+)", 1)
    return F.when(F.lower(style) == "title", 1).when(n != "", F.least(F.greatest(n.cast("int"), F.lit(1)), F.lit(6)))


def inside(path: Column) -> Column:
    """A bundle-relative POSIX path with . and .. folded, null if it is absolute or leads out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.expr("cast(array() AS array<string>)").alias("kept"), F.lit(False).alias("out"))

    def step(s: Column, p: Column) -> Column:
        up, none = p == "..", F.size(s["kept"]) == 0
        kept = F.when(up & ~none, F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0)))).when(up, s["kept"]).otherwise(F.concat(s["kept"], F.array(p)))
        return F.struct(kept.alias("kept"), (s["out"] | (up & none)).alias("out"))

    folded_path = F.aggregate(parts, start, step, lambda s: F.when(~s["out"], F.array_join(s["kept"], "/")))
    return F.when(~path.rlike(r"\A(?:[/\\]|[A-Za-z]:)"), folded_path)


def attachment_base(name: Column) -> Column:
    """The last path part, odd characters as _, at most 200 characters."""
    base = F.regexp_replace(F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)\z", 1), "[^A-Za-z0-9._\\-\\u4e00-\\u9fff]", "_")
    return F.substring(F.when(base == "", "attachment.bin").otherwise(base), 1, 200)


def image_references(c: Column) -> Column:
    """(raw_target, normalized_target, line_number) of inline images in Markdown."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(r"(?<!\\)!\[[^\]]*\]\(([^\n]*)\)"), F.lit(1)),
        lambda d, i: F.struct(_target(d).alias("raw_target"), F.coalesce(F.try_url_decode(F.replace(_target(d), F.lit("+"), F.lit("%2B"))), _target(d)).alias("normalized_target"), _line(c, i).alias("line_number")),
    )


def _target(d: Column) -> Column:
    d = strip(d)
    quoted = F.regexp_extract(d, r"\A<([^>]*)>", 1)
    return F.when(d.rlike(r"\A<[^>]*>"), quoted).otherwise(strip(F.regexp_replace(d, r"(?s)\s+[\"'].*\z", "")))


def _line(c: Column, i: Column) -> Column:
    before = F.slice(F.split(c, r"(?<!\\)!\[[^\]]*\]\([^\n]*\)", -1), F.lit(1), i + 1)
    inside_matches = F.slice(F.regexp_extract_all(c, F.lit(r"(?<!\\)!\[[^\]]*\]\([^\n]*\)"), F.lit(0)), F.lit(1), i)
    count = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit("\n")))
    return count(before) + count(inside_matches) + 1


def locator_precision(fmt: Column, engine: Column, loc: Column) -> Column:
    """How exact a source locator is, from what evidence it has."""
    pdf = F.when(F.lower(F.coalesce(engine, F.lit(""))).contains("ocr") & loc["page_start"].isNotNull(), "derived").when(F.size(F.coalesce(loc["bboxes"], F.array())) > 0, "exact").when(loc["page_start"].isNotNull(), "page_only").otherwise("unknown")
    evidence = F.coalesce(
        F.when(fmt == "xlsx", loc["cell_range"].isNotNull()), F.when(fmt == "pptx", loc["shape_id"].isNotNull()), F.when(fmt == "csv", loc["row_start"].isNotNull()),
        F.when(fmt == "json", loc["json_path"].isNotNull()), F.when(fmt == "eml", loc["mime_part"].isNotNull()), F.when(fmt == "html", loc["element_index"].isNotNull()), F.lit(False),
    )
    return F.when(fmt == "pdf", pdf).when(fmt == "docx", "range").when(evidence, "exact").otherwise("unknown")


def canonical_json(*columns: str) -> Column:
    """Compact JSON with its keys in order."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
