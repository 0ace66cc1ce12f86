"""Line dedup by a deletion-neighbourhood join.

A line of a document is removed if an earlier one, by (doc_id, line number), is the same or, for lines of min_chars
code points or more, one edit away. Two lines within one edit share a half (their lengths then differ by one at most, so the
halves are those of a few lengths). Lines that share no half with another need no variants; the others emit a hash of
each variant with one character deleted, in the other half, and one of themselves. Equal variants meet: deletions at the same place
are a substitution, a deletion and a whole line an insertion. The earliest of those that meet removes the rest, once
the texts themselves have been compared. No pairs are made, so groups of any size cost what they have lines.

Defined results: null text stays null; blank lines always stay; a document whose lines all go has the empty text. Repeated
rows (one doc_id) are one document, and all get the same result. Documents without doc_id have no place in the order: they
stay as they are, and remove nothing. An empty table gives an empty result; very long texts and lines are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import free_name, lookup, stored

#: Shorter lines are only removed if an earlier one is the same.
MIN_CHARS = 20
#: Lines to look up are broadcast up to this number; more of them meet in a shuffle join.
BROADCAST_LINES = 1 << 18
#: A line number is below this.
LINES = 1 << 31


def exploded(docs: DataFrame) -> DataFrame:
    """at, line: the non-blank lines; at orders them by document and number."""
    d = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    d = d.filter(F.col("line").rlike(r"(?U)\S"))
    return d.select((F.col("doc_id").cast("decimal(20,0)") * F.lit(LINES) + F.col("no")).cast("decimal(31,0)").alias("at"), "line")


def digest(line: str) -> Column:
    return F.unhex(F.md5(line))


def halves(min_chars: int) -> list[Column]:
    """Hashes of the first and the last n/2 and (n+1)/2 characters of a line, null if there is nothing to compare."""
    n = F.length("line")
    low, high = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    long = n >= max(2, min_chars - 1)
    part = lambda side, c: F.xxhash64(F.lit(side), c, F.left("line", c) if side == "p" else F.right("line", c))
    return [
        F.when(long, part("p", low)).alias("p1"), F.when(long & (low != high), part("p", high)).alias("p2"),
        F.when(long, part("s", low)).alias("s1"), F.when(long & (low != high), part("s", high)).alias("s2"),
    ]


def values(docs: DataFrame, min_chars: int) -> DataFrame:
    """The distinct lines: h, the halves' hashes, and at, where the first is."""
    lines = exploded(docs).select("at", digest("line").alias("h"), *halves(min_chars))
    return lines.groupBy("h", "p1", "p2", "s1", "s2").agg(F.min("at").alias("at"))


def sharing(distinct: DataFrame) -> DataFrame:
    """h, at, prefix, suffix of the lines that share a first or a last half with another one."""
    each = F.explode(F.array(*(F.struct(F.lit(c < "q").alias("prefix"), F.col(c).alias("key")) for c in ("p1", "p2", "s1", "s2")))).alias("x")
    keys = distinct.select("h", "at", each).select("h", "at", "x.*").filter("key IS NOT NULL")
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("met", F.lit(True)), "shared")
    met = lookup(keys, shared, "key", F.col("h"), "inner")
    return met.groupBy("h", "at").agg(F.max("prefix").alias("prefix"), F.max(~F.col("prefix")).alias("suffix"))


_RANDOM = np.random.default_rng(20250101).integers(1, 1 << 63, size=(2, 1 << 16), dtype=np.uint64) | np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def deletions(line: str, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes each of the line and then of its variants without the character at first .. last - 1."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    out = []
    for k in range(2):
        with np.errstate(over="ignore"):
            v = _RANDOM[k][c & 0xFFFF] * (np.uint64(2) * (c >> 16).astype(np.uint64) + np.uint64(1))
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c), _BASE[k])]))[: len(c)]
            inverse = np.uint64(pow(int(_BASE[k]), -1, 1 << 64))
            before = np.concatenate([[np.uint64(0)], np.cumsum(v * power)])
            total = before[-1]
            one = before[first:last] + (total - before[first + 1 : last + 1]) * inverse
            n = np.concatenate([[len(c)], np.full(len(one), len(c) - 1)]).astype(np.uint64)
            out.append((np.concatenate([[total], one]) * (np.uint64(2) * n + np.uint64(1)) ^ n).view(np.int64))
    return out[0], out[1]


VARIANTS = "k1 long, k2 long, place int, h binary, at decimal(31,0)"


def variants(lines: DataFrame) -> DataFrame:
    """k1, k2, place (-1: the line itself), h, at from lines with line, prefix and suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            sizes = [len(r[0]) for r in rows]
            take = pa.array(np.repeat(np.arange(len(rows)), sizes))
            own = [pa.array([r[3] for r in rows], pa.binary()).take(take), pa.array([r[4] for r in rows], pa.decimal128(31, 0)).take(take)]
            return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([r[k] for r in rows])) for k in range(3)), *own], ["k1", "k2", "place", "h", "at"])

        rows, n = [], 0
        for b in batches:
            for line, prefix, suffix, h, at in zip(*(b.column(c).to_pylist() for c in ("line", "prefix", "suffix", "h", "at")), strict=True):
                size = len(line)
                first, last = (0 if suffix else size // 2), (size if prefix else (size + 1) // 2)
                k1, k2 = deletions(line, first, last)
                place = np.concatenate([[-1], np.arange(first, last)]).astype(np.int32)
                for s in range(0, len(k1), 1 << 17):
                    part = slice(s, s + (1 << 17))
                    rows.append((k1[part], k2[part], place[part], h, at))
                    n += len(k1[part])
                    if n >= 1 << 17:
                        yield batch(rows)
                        rows, n = [], 0
        if rows:
            yield batch(rows)

    return lines.select("line", "prefix", "suffix", "h", "at").mapInArrow(run, VARIANTS)


def beaten(met: DataFrame) -> DataFrame:
    """h and by: a line and the earliest line before it that one of its variants meets."""
    whole = F.col("place") < 0
    place, key = Window.partitionBy("k1", "k2", "place"), Window.partitionBy("k1", "k2")
    me = F.struct("at", "h")
    m = met.repartition("k1", "k2").select("*", F.min(me).over(place).alias("same"), F.min(F.when(whole, me)).over(key).alias("line"), F.min(F.when(~whole, me)).over(key).alias("cut"))
    best = F.when(whole, F.col("cut")).otherwise(F.least("same", "line"))
    m = m.select("h", "at", best.alias("by")).filter(F.col("by.at") < F.col("at"))
    return m.groupBy("h").agg(F.min("by").alias("by")).select("h", F.col("by.h").alias("by"))


def one_edit(a: str, b: str) -> bool:
    """Whether a becomes b by at most one insertion, deletion or substitution."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)  # the common prefix, by halving
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[:mid]) else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def verified(pairs: DataFrame) -> DataFrame:
    """h of those pairs (h, x, y) of which the texts x and y are one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([one_edit(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("h").filter(ok)], ["h"])

    return pairs.select("h", "x", "y").mapInArrow(run, "h binary")


def near(docs: DataFrame, distinct: DataFrame, min_chars: int) -> DataFrame:
    """h of the lines that an earlier line, one edit away, removes."""
    some = stored(sharing(distinct), "sharing")
    lines = exploded(docs).filter(F.length("line") >= min_chars).withColumn("h", digest("line"))
    few = some.count() <= BROADCAST_LINES
    on = [F.col("l.at") == F.col("s.at"), F.col("l.h") == F.col("s.h")]
    texts = lines.alias("l").join(F.broadcast(some.alias("s")) if few else some.alias("s"), on).select("s.*", "line")
    texts = stored(texts.dropDuplicates(["h"]), "texts")
    won = beaten(variants(texts)).alias("w")
    x, y = texts.select("h", F.col("line").alias("x")).alias("x"), texts.select("h", F.col("line").alias("y")).alias("y")
    pairs = won.join(x, F.col("w.h") == F.col("x.h")).join(y, F.col("w.by") == F.col("y.h")).select("w.h", "x", "y")
    return verified(pairs)


def kept_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, kept: the numbers of the non-blank lines that stay, in order; documents without any are missing."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    distinct = stored(values(docs, min_chars if max_edits else LINES), "lines")
    first = distinct.select("h", "at")
    if max_edits:
        first = first.join(near(docs, distinct, min_chars), "h", "left_anti")
    place = first.select(F.expr(f"cast(floor(at / {LINES}BD) AS bigint)").alias("doc_id"), F.expr(f"cast(pmod(at, {LINES}BD) AS int)").alias("no"))
    return place.groupBy("doc_id").agg(F.sort_array(F.collect_list("no")).alias("kept"))


def dedup(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, all columns whatever their names, with text as left by line dedup, and n_chars, where there is one, to match."""
    d, new, _, _ = _rebuilt(docs, max_edits, min_chars)
    columns = [F.col(new).alias(c) if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return d.select(*columns)


def _rebuilt(docs: DataFrame, max_edits: int, min_chars: int) -> tuple[DataFrame, str, str, str]:
    """docs with the new text, the number of lines and the number that stay, and the names of these columns, which docs has not."""
    key, kept, lines, new, n, stay = names = [free_name(x, *docs.columns) for x in ("kept_id", "kept", "lines", "new_text", "n_lines", "n_stay")]
    found = kept_lines(docs, max_edits, min_chars).select(F.col("doc_id").alias(key), F.col("kept").alias(kept))
    cut = F.split("text", "\n")
    known = docs.filter("doc_id IS NOT NULL").join(found, F.col("doc_id") == F.col(key), "left").withColumn(lines, cut)
    blank = F.expr(rf"filter(transform({lines}, (l, i) -> CASE WHEN NOT l rlike '(?U)\\S' THEN i END), i -> i IS NOT NULL)")
    left = F.sort_array(F.concat(F.coalesce(kept, F.expr("cast(array() AS array<int>)")), blank))
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    known = known.withColumn(new, text).select(*docs.columns, new, F.size(lines).alias(n), F.size(left).alias(stay))
    lost = docs.filter("doc_id IS NULL").select(*docs.columns, F.col("text").alias(new), F.size(cut).alias(n), F.size(cut).alias(stay))
    return (known.unionByName(lost), *names[3:])


def report(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, and text without the removed lines."""
    d, new, n, stay = _rebuilt(docs.select("doc_id", "text"), max_edits, min_chars)
    none = F.col("text").isNull()
    return d.select("doc_id", F.when(none, 0).otherwise(F.col(n)).cast("long").alias("n_lines"), F.when(none, 0).otherwise(F.col(n) - F.col(stay)).cast("long").alias("n_removed"), F.col(new).alias("text"))
