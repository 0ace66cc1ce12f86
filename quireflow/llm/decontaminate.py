"""Benchmark decontamination by suffix arrays over the training documents.

Each Arrow batch of documents is a shard. Its words become numbers (0 for words that no benchmark item
has, and after each document); the shard's suffix array sorts the positions at which a window can start.
Every suffix of every benchmark item is binary-searched in every shard's array, which gives all verbatim
matches of a window with their places, and by joining matches along a diagonal the longest ones.

Defined results: null text has no words; null item_id counts as the empty string; rows with one item_id
are one item; items without words match nothing; repeated documents get a row each; without items nothing is hit;
an empty table gives an empty result; of equally long matches the first in the text counts. A text is one shard at
least, so a very long one costs memory in proportion to itself. Columns of any name pass through decontaminate() unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.llm.common import free_name, stored

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Benchmark text beyond this many bytes is searched in several blocks, so that what is broadcast stays bounded.
BLOCK_BYTES = 2 << 20
#: Words of training text in a shard, but for a longer document.
SHARD_WORDS = 1 << 20


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of 0-9, a-z and non-ASCII characters."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Queries:
    """The windows of a block of benchmark items, as sorted byte keys over a private vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        tokens = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]) for name, text in items]
        tokens = [(name, t) for name, t in tokens if t]
        self.names = sorted({name for name, _ in tokens})
        number = {name: k for k, name in enumerate(self.names)}
        self.width = max((min(window, len(t)) for _, t in tokens), default=0)
        self.least = min((min(window, len(t)) for _, t in tokens), default=0)
        low, high, item, place, length, at = [], [], [], [], [], 0
        for name, t in tokens:
            w = min(window, len(t))
            for k in range(len(t) - w + 1):
                key = np.array(t[k : k + w], ">u4").tobytes()
                low.append(key)
                high.append(key + b"\xff" * (4 * (self.width - w) + 1))
                item.append(number[name])
                place.append(at + k)
                length.append(w)
            at += len(t) + 1
        self.low = np.array(low, f"S{4 * self.width + 1}") if low else np.array([], "S1")
        self.high = np.array(high, f"S{4 * self.width + 1}") if low else np.array([], "S1")
        self.item, self.place, self.length = (np.array(x, np.int64) for x in (item, place, length))


def suffix_array(tokens: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """The shard's positions from which enough benchmark words follow, in suffix order, and their keys of q.width words."""
    n = len(tokens)
    ends = np.where(tokens == 0, np.arange(n), n)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    at = np.flatnonzero(ends - np.arange(n) >= q.least)
    padded = np.concatenate([tokens, np.zeros(q.width, tokens.dtype)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, q.width)[at].astype(">u4")
    past = np.arange(q.width) >= (ends[at] - at)[:, None]
    rows[past] = 0
    keys = np.ascontiguousarray(rows).view(f"S{4 * q.width}").ravel().astype(f"S{4 * q.width + 1}")
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def shard_hits(tokens: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(positions, windows): where which window occurs."""
    none = np.array([], np.int64)
    if not len(q.low) or not len(tokens):
        return none, none
    at, keys = suffix_array(tokens, q)
    first, last = np.searchsorted(keys, q.low, "left"), np.searchsorted(keys, q.high, "right")
    n = np.maximum(last - first, 0)
    window = np.repeat(np.arange(len(n)), n)
    if not len(window):
        return none, none
    return at[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)], window


def longest(position: np.ndarray, place: np.ndarray, length: np.ndarray, doc: np.ndarray) -> dict[int, tuple[int, int]]:
    """Per document the longest verbatim match in words and where it starts (the first of equals)."""
    if not len(position):
        return {}
    diagonal = position - place
    order = np.lexsort((position, diagonal, doc))
    p, d, k, w = position[order], diagonal[order], doc[order], length[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (p[1:] - p[:-1] != 1)])
    start = np.flatnonzero(new)
    end = np.concatenate([start[1:], [len(p)]]) - 1
    size = p[end] + w[end] - p[start]
    best: dict[int, tuple[int, int]] = {}
    for doc_k, s, at in zip(k[start].tolist(), size.tolist(), p[start].tolist(), strict=True):
        if doc_k not in best or (s, -at) > (best[doc_k][0], -best[doc_k][1]):
            best[doc_k] = (s, at)
    return best


def shards(texts: Iterator[str | None], vocabulary: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, starts) of a shard: each document's numbers and a 0 after them; starts has one entry more."""
    get, part, starts, n = vocabulary.get, [], [0], 0
    for text in texts:
        t = words(text)
        part.append(np.fromiter((get(w, 0) for w in t), np.uint32, len(t)))
        part.append(np.zeros(1, np.uint32))
        n += len(t) + 1
        starts.append(n)
        if n >= SHARD_WORDS:
            yield np.concatenate(part), np.array(starts)
            part, starts, n = [], [0], 0
    if part:
        yield np.concatenate(part), np.array(starts)


def scan_texts(texts: Iterator[str | None], q: Queries) -> Iterator[dict]:
    """Per text: n_words, spans of hit words (start, end), item names, longest match and its start."""
    for tokens, starts in shards(texts, q.vocabulary):
        position, window = shard_hits(tokens, q)
        doc = np.searchsorted(starts, position, "right") - 1
        spans: dict[int, list[list[int]]] = {}
        items: dict[int, set[str]] = {}
        order = np.lexsort((position, doc))
        for k, p, w, i in zip(doc[order].tolist(), position[order].tolist(), q.length[window[order]].tolist(), q.item[window[order]].tolist(), strict=True):
            items.setdefault(k, set()).add(q.names[i])
            own, p = spans.setdefault(k, []), p - int(starts[k])
            if own and p <= own[-1][1]:
                own[-1][1] = max(own[-1][1], p + w)
            else:
                own.append([p, p + w])
        best = longest(position, q.place[window], q.length[window], doc)
        for k in range(len(starts) - 1):
            size, at = best.get(k, (0, int(starts[k])))
            yield {"n_words": int(starts[k + 1] - starts[k] - 1), "spans": spans.get(k, []), "items": sorted(items.get(k, ())), "longest": size, "at": at - int(starts[k]) if size else None}


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
        T.StructField("at", T.LongType()),
    ]
)
ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("at", pa.int64())])


def _joined(a: dict, b: dict) -> dict:
    spans: list[list[int]] = []
    for s, e in sorted(a["spans"] + b["spans"]):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    best = a if (a["longest"], -(a["at"] or 0)) >= (b["longest"], -(b["at"] or 0)) else b
    return {"n_words": a["n_words"], "spans": spans, "items": sorted({*a["items"], *b["items"]}), "longest": best["longest"], "at": best["at"]}


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Queries]:
    """The benchmark in blocks of about block_bytes, each collected by itself."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = b.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        own = b if n == 1 else b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Queries([(r[0], r[1]) for r in own.collect()], window)


def matches(docs: DataFrame, benchmark: DataFrame, column: str, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column of what scan_texts gives; docs has text. No shuffle, whatever the skew.

    One block is broadcast at a time: what it gives is stored before it is destroyed and the next one is built.
    """
    out, last = docs, None
    for k, q in enumerate(_blocks(benchmark, window, block_bytes)):
        if last is not None:
            out = stored(out, "matches")
            last.destroy()
        last = shared = docs.sparkSession.sparkContext.broadcast(vars(q))  # plain values: broadcasts are pickled by reference

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, again=k > 0) -> Iterator[pa.RecordBatch]:
            q = Queries.__new__(Queries)
            vars(q).update(shared.value)
            for batch in batches:
                found = list(scan_texts((x.as_py() for x in batch.column("text")), q))
                if again:
                    found = [_joined(a, b) for a, b in zip(batch.column(column).to_pylist(), found, strict=True)]
                columns = {n: batch.column(n) for n in batch.schema.names if n != column}
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(found, ARROW)], [*columns, column])

        out = out.mapInArrow(scan, T.StructType([f for f in out.schema.fields if f.name != column] + [T.StructField(column, FOUND)]))
    return out


def _n_hit(found: F.Column) -> F.Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), longest_match, match_start, items."""
    found = F.col("found")
    m = matches(docs.select("doc_id", "text"), benchmark, "found", window, block_bytes)
    m = m.select("doc_id", found["n_words"].alias("n_words"), _n_hit(found).alias("n_hit"), found["items"].alias("items"), found["longest"].alias("longest_match"), found["at"].alias("match_start"))
    return m.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest_match", "match_start", "items",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, without the affected ones.

    A document goes if it has a verbatim match of at least window words, however long it is, or if the words that
    matches hit are at least one of share. Items shorter than the window fall under the share alone: a few common
    words somewhere in a long text are no leak.
    """
    column = free_name("found", *docs.columns)
    found = F.col(column)
    n_hit = _n_hit(found)
    affected = (found["longest"] >= window) | ((n_hit > 0) & (share * n_hit >= found["n_words"]))
    return matches(docs, benchmark, column, window, block_bytes).filter(~affected).select(*docs.columns)
