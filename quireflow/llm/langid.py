"""Language identification by interpolated Kneser-Ney character models.

A model per language is learnt from a bounded sample of labelled documents, and kept in sorted arrays of 64-bit n-gram
hashes with log probabilities and back-off weights, a column per language. A text's letters, lower-cased, with a blank for
whatever is between them, are scored whole; the language with the lowest cross-entropy per character wins.
Rejection is calibrated on labelled documents kept apart, as they are and with their characters shuffled: a text is rejected if its
cross-entropy is nearer to what shuffled texts of its language have than to what real ones have, and too far off for its length to be chance.

Only text and non-null lang of documents whose crc32 of doc_id is not divisible by 5 are learnt from (a null doc_id counts as
empty text, whose crc32 is 0). Defined results: null text, or one without letters, is `und` with score 0, and rejected; without any
labelled document all are; an empty table gives an empty result; equal texts get equal results; of equally good languages
the first by code point wins; very long texts are scored whole. Columns of any name pass through accepted() unchanged.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.llm.common import free_name

ORDER = 4
#: About so many labelled documents of a language, chosen by hash, are learnt from; a quarter of them calibrate.
DOCS_PER_LANGUAGE = 1200
#: Characters scored at a time, and slots of the cache of n-grams looked up.
CHUNK, CACHE = 1 << 19, 1 << 18
#: A text's posterior counts at most so many characters, which are not independent.
EVIDENCE = 60
#: Nats above the mean, times the root of the number of characters (400 at most), up to which no text is rejected.
WIDTH = 12.0
START = "\x02"
B = 0x9E3779B97F4A7C15


def _letters() -> np.ndarray:
    """Per code point up to 0xFFFF: the lower-case letter, or a blank if it is none."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


class Letters:
    table: np.ndarray | None = None


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters of text, one blank between words and around all; empty if there is no letter."""
    if Letters.table is None:
        Letters.table = _letters()
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    low = Letters.table[np.minimum(c, 0xFFFF)]
    for k in np.flatnonzero(c > 0xFFFF).tolist():
        x = chr(int(c[k]))
        low[k] = ord(x.lower()[0]) if x.isalpha() else 32
    if not len(low) or (low == 32).all():
        return np.array([], np.uint32)
    low = np.concatenate([[np.uint32(32)], low, [np.uint32(32)]])
    return low[(low != 32) | np.concatenate([[True], low[:-1] != 32])]


def keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each row of n code points (codes has the shape (rows, n))."""
    out = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out * np.uint64(B) + codes[:, k].astype(np.uint64) + np.uint64(1)) ^ (out >> np.uint64(29))
    return out


def gram_keys(grams: list[str]) -> np.ndarray:
    n = len(grams[0]) if grams else 1
    return keys(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n), n)


class KneserNey:
    """The model of one language from counts of n-grams of the highest order."""

    def __init__(self, counts: dict[str, int], order: int, alphabet: int):
        self.order, self.alphabet = order, alphabet
        level: list[dict[str, int]] = [counts]
        for _ in range(order - 1):
            level.append(Counter(g[1:] for g in level[-1]))
        self.p: list[dict[str, float]] = [{}]
        self.gamma: list[dict[str, float]] = [{}]
        for n, c in enumerate(reversed(level), 1):
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = defaultdict(int), defaultdict(int)
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            gamma = {x: d * kinds[x] / t for x, t in total.items()}
            lower = self.p[-1]
            base = 1 / alphabet
            self.p.append({g: (v - d) / total[g[:-1]] + gamma[g[:-1]] * (lower.get(g[1:], base) if n > 1 else base) for g, v in c.items()})
            self.gamma.append(gamma)

    def prob(self, gram: str) -> float:
        n = len(gram)
        if not n:
            return 1 / self.alphabet
        found = self.p[n].get(gram)
        return found if found is not None else self.gamma[n].get(gram[:-1], 1.0) * self.prob(gram[1:])


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> dict:
    """Plain arrays for all languages: per order sorted keys with log probabilities, and contexts with log back-off weights."""
    names = sorted(counts)
    alphabet = len({c for grams in counts.values() for g in grams for c in g[-1:]}) + 1
    models = [KneserNey(counts[x], order, alphabet) for x in names]
    tables = []
    for n in range(1, order + 1):
        grams = sorted(set().union(*(m.p[n] for m in models))) if models else []
        contexts = sorted(set().union(*(m.gamma[n] for m in models))) if models else []
        p = np.log(np.array([[m.prob(g) for m in models] for g in grams]).reshape(len(grams), len(names)))
        g = np.log(np.array([[m.gamma[n].get(x, 1.0) for m in models] for x in contexts]).reshape(len(contexts), len(names)))
        kp, kg = gram_keys(grams), gram_keys(contexts) if n > 1 else np.zeros(len(contexts), np.uint64)
        a, b = np.argsort(kp), np.argsort(kg)
        tables.append((kp[a], p[a].astype(np.float32), kg[b], g[b].astype(np.float32)))
    return {"names": names, "order": order, "tables": tables, "base": float(np.log(1 / alphabet)), "calibration": {}}


def found(sorted_keys: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, k), max(len(sorted_keys) - 1, 0))
    return at, (sorted_keys[at] == k if len(sorted_keys) else np.zeros(len(k), bool))


def log_probs(model: dict, codes: np.ndarray) -> np.ndarray:
    """Log probabilities, a column per language, of the last of each row of model["order"] code points, by back-off."""
    out = np.zeros((len(codes), len(model["names"])), np.float32)
    todo = np.arange(len(codes))
    for n in range(model["order"], 0, -1):
        kp, p, kg, g = model["tables"][n - 1]
        part = codes[todo, model["order"] - n :]
        at, hit = found(kp, keys(part, n))
        out[todo[hit]] += p[at[hit]] if len(p) else 0
        todo, part = todo[~hit], part[~hit]
        if not len(todo):
            return out
        at, hit = found(kg, keys(part[:, :-1], n - 1) if n > 1 else np.zeros(len(todo), np.uint64))
        if hit.any():
            out[todo[hit]] += g[at[hit]]
    out[todo] += model["base"]
    return out


class Scorer:
    """Cross-entropies of texts; n-grams looked up before are kept in a cache of fixed size."""

    def __init__(self, model: dict):
        self.model, n = model, len(model["names"])
        self.key, self.value = np.zeros(CACHE, np.uint64), np.zeros((CACHE, n), np.float32)

    def __call__(self, texts: Iterator[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(characters, cross-entropy per language in nats a character) of each text."""
        part, size = [], 0
        for t in texts:
            part.append(letters(t))
            size += len(part[-1])
            if size >= CHUNK:
                yield from self.chunk(part)
                part, size = [], 0
        yield from self.chunk(part)

    def chunk(self, part: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        n, width = self.model["order"], len(self.model["names"])
        pad = np.full(n - 1, ord(START), np.uint32)
        ends = np.cumsum([0] + [len(x) + n - 1 for x in part])
        total = np.zeros((len(part), width))
        if ends[-1]:
            flat = np.concatenate([y for x in part for y in (pad, x)])
            rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, flat]), n)
            k = keys(rows, n)
            slot = (k >> np.uint64(64 - CACHE.bit_length() + 1)).astype(np.int64)
            miss = np.flatnonzero(self.key[slot] != k)
            if len(miss):
                _, first = np.unique(k[miss], return_index=True)
                at = miss[first]
                self.key[slot[at]], self.value[slot[at]] = k[at], log_probs(self.model, rows[at])
            value = self.value[slot]
            lost = np.flatnonzero(self.key[slot] != k)  # of two n-grams in one slot the last stays
            if len(lost):
                u, back = np.unique(k[lost], return_inverse=True)
                first = np.zeros(len(u), np.int64)
                first[back] = lost
                value[lost] = log_probs(self.model, rows[first])[back]
            # Each text is summed by itself, in its own order, so that equal texts have equal sums wherever they stand.
            value[(ends[:-1, None] + np.arange(n - 1)).ravel()] = 0
            some = np.flatnonzero(np.diff(ends))
            total[some] = np.add.reduceat(value.astype(np.float64), ends[some], axis=0)
        for x, t in zip(part, total, strict=True):
            yield len(x), (-t / len(x) if len(x) else t)


def decide(model: dict, size: int, h: np.ndarray) -> tuple[str, float, bool, float | None]:
    """lang_pred, score (the posterior for EVIDENCE characters at most), rejected, cross-entropy."""
    if not size or not len(h):
        return "und", 0.0, True, None
    best = int(np.argmin(h))
    score = float(1 / np.exp(-(h - h[best]) * min(size, EVIDENCE)).sum())
    mean, shuffled = model["calibration"].get(model["names"][best], (float("inf"), float("inf")))
    rejected = h[best] > (mean + shuffled) / 2 and (h[best] - mean) * min(size, 400) ** 0.5 > WIDTH
    return model["names"][best], score, bool(rejected), float(h[best])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, docs_per_language: int) -> DataFrame:
    """text, lang and calibrate of about so many labelled documents of each language, chosen by hash of doc_id and text."""
    d = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rates = d.groupBy(F.col("lang").alias("rated")).agg((F.lit(float(docs_per_language)) / F.count("*")).alias("rate"))
    h = F.xxhash64("doc_id", F.length("text"))
    d = d.join(F.broadcast(rates), F.col("lang") == F.col("rated")).filter(F.pmod(h, F.lit(1 << 40)) / float(1 << 40) < F.col("rate"))
    return d.select("text", "lang", (F.pmod(F.shiftright(h, 42), F.lit(4)) == 0).alias("calibrate"))


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """lang, gram, n over the texts of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                c = letters(text.as_py())
                if len(c):
                    t = START * (order - 1) + c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                    counts[lang].update(map("".join, zip(*(t[k:] for k in range(order)), strict=False)))
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def shuffled(text: str | None) -> str:
    """The text's letters and blanks in an order that depends on nothing but them."""
    c = letters(text)
    return np.random.default_rng(len(c)).permutation(c).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def calibrated(model: dict, rows: DataFrame) -> dict:
    """The model with the mean cross-entropy per language of real and of shuffled texts, from rows that were not learnt from.

    Only sums per language and batch leave the workers; a language without such rows rejects nothing.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        at = {x: k for k, x in enumerate(shared.value["names"])}
        sums = np.zeros((len(at), 3))
        for b in batches:
            langs = b.column("lang").to_pylist()
            for real in (True, False):
                texts = (t.as_py() if real else shuffled(t.as_py()) for t in b.column("text"))
                for lang, (n, h) in zip(langs, score(texts), strict=True):
                    if n and lang in at:
                        w = min(n, 400)
                        sums[at[lang]] += (w, w * h[at[lang]], 0) if real else (0, 0, w * h[at[lang]])
        yield pa.RecordBatch.from_arrays([pa.array(list(at)), *(pa.array(sums[:, k]) for k in range(3))], ["lang", "w", "real", "mixed"])

    sums = rows.select("text", "lang").mapInArrow(run, "lang string, w double, real double, mixed double").groupBy("lang").agg(F.sum("w").alias("w"), F.sum("real").alias("real"), F.sum("mixed").alias("mixed"))
    out = {r["lang"]: (round(r["real"] / r["w"], 6), round(r["mixed"] / r["w"], 6)) for r in sums.filter("w > 0").collect()}  # rounded: the order of the sums may differ
    return model | {"calibration": out}


def train(docs: DataFrame, order: int = ORDER, docs_per_language: int = DOCS_PER_LANGUAGE) -> dict:
    rows = sample(docs, docs_per_language)
    table = gram_counts(rows.filter("NOT calibrate"), order).toArrow()
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, n in zip(*(table.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        counts[lang][gram] = n
    model = fit(counts, order)
    return calibrated(model, rows.filter("calibrate")) if model["names"] else model


def identified(docs: DataFrame, model: dict, column: str) -> DataFrame:
    """docs with a struct column of lang, score, rejected and cross_entropy; docs has text. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for b in batches:
            rows = [dict(zip(("lang", "score", "rejected", "cross_entropy"), decide(shared.value, n, h), strict=True)) for n, h in score(t.as_py() for t in b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, fields)], [*b.schema.names, column])

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()), T.StructField("cross_entropy", T.DoubleType())])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, kind)]))


def predict(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred (a learnt language; und without letters), score, rejected, cross_entropy."""
    model = model or train(docs)
    x = F.col("found")
    d = identified(docs.select("doc_id", "text"), model, "found")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), x["lang"].alias("lang_pred"), x["score"].alias("score"), x["rejected"].alias("rejected"), x["cross_entropy"].alias("cross_entropy"))


def accepted(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs, all columns whatever their names, without those that are rejected."""
    column = free_name("found", *docs.columns)
    return identified(docs, model or train(docs), column).filter(~F.col(column)["rejected"]).select(*docs.columns)
