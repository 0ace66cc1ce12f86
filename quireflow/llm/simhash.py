"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most two bits, one
segment differs in at most one: each segment is indexed under its 32 one-wildcard variants, equal variants meet,
and the whole fingerprints are compared. Equal fingerprints are one node, so copies are never paired.

Defined results: null and blank texts have no words and the fingerprint zero, which links like any other;
repeated rows get a row each; component_id ignores null doc_ids and is null where there are no others; an empty table
gives an empty result; very long texts are hashed whole, in parts; dedup() breaks ties by doc_id, then by a hash of the
text, and passes columns of any name through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import components, free_name, lookup, stored

#: In a task, a bucket of more fingerprints than this is cut again, by the bits in which its fingerprints differ.
BUCKET = 512
#: A bucket of more fingerprints than this is cut by the other segment before it goes to a task.
HOT_BUCKET = 1 << 14
SHINGLE, SEED = 3, 42


def fingerprint(text: str | None) -> int:
    """64 bits: bit b is set if it is set in over half of the hashes of all three-word shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < SHINGLE:
        return digest(b" ".join(w), SEED)
    n = len(w) - SHINGLE + 1
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the memory for very long texts
        part = w[at : at + (1 << 16) + SHINGLE - 1]
        h = np.fromiter([digest(b"%b %b %b" % x, SEED) for x in zip(part, part[1:], part[2:], strict=False)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; with text_hash, a hash of the text, if hashed."""
    keys = ["doc_id", "text_hash"] if hashed else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py()) for x in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(b.column, keys), pa.array(fp)], [*keys, "fp"])

    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).select(*keys, "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {'text_hash long, ' if hashed else ''}fp long")


def segments(fps: DataFrame) -> DataFrame:
    """fp, side (0: the low 32 bits, 1: the high ones), segment: a row for each half of each fingerprint."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return fps.select("fp", F.posexplode(F.array(low, high)).alias("side", "segment"))


def wildcards(rows: DataFrame) -> DataFrame:
    """rows with key instead of side and segment: a row for each of the 32 variants of the segment that leave out one bit."""
    rest = [c for c in rows.columns if c not in ("side", "segment")]
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    number = F.shiftleft((F.col("side") * 32 + F.col("bit")).cast("long"), 32)
    return each.select(number.bitwiseOR(F.col("segment").bitwiseAND(F.expr("~shiftleft(1L, bit)"))).alias("key"), *rest)


def variants(fps: DataFrame) -> DataFrame:
    """key, fp: each fingerprint under the one-wildcard variants of its two segments (2 x 32 keys)."""
    return wildcards(segments(fps))


def forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges (member, root) that join what links of at most so many bits join among these fingerprints.

    Many fingerprints are cut by bits + 1 sets of the bits that vary among them: linked ones agree in one set at least.
    """
    if len(fp) > BUCKET:
        vary = [b for b in range(64) if int(np.bitwise_or.reduce(fp ^ fp[0])) >> b & 1]
        out = []
        for k in range(bits + 1):
            part = fp & np.uint64(sum(1 << b for b in vary[k :: bits + 1]))
            order = np.argsort(part, kind="stable")
            cut = [*np.flatnonzero(np.diff(part[order])) + 1]
            groups = [fp[g] for g in np.split(order, cut) if len(g) > 1]
            out += [e for g in groups if len(g) < len(fp) for e in forest(g, bits)] if len(groups) != 1 or len(groups[0]) < len(fp) else spanning(fp, bits)
        return out
    return spanning(fp, bits)


def spanning(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """forest() by comparing each fingerprint with all later ones."""
    root = np.arange(len(fp))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(fp) - 1):
        for j in (np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= bits) + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(int(fp[i]), int(fp[find(i)])) for i in range(len(fp)) if find(i) != i]


def bucket_links(rows: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) within the buckets of rows (key, fp), which are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.array([], np.int64), np.array([], np.int64)

        def edges(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else np.array([0])
            out = []
            for g in np.flatnonzero(np.diff(cut) > 1).tolist():
                out += forest(f[cut[g] : cut[g + 1]].view(np.uint64), bits)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for b in batches:
            k, f = np.concatenate([rest_k, b.column("key").to_numpy()]), np.concatenate([rest_f, b.column("fp").to_numpy()])
            if len(k):
                last = np.searchsorted(k, k[-1], "left")
                yield edges(k[:last], f[:last])
                rest_k, rest_f = k[last:], f[last:]
        yield edges(rest_k, rest_f)

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def cut(fps: DataFrame, bits: int, most: int = HOT_BUCKET) -> DataFrame:
    """variants(fps), but of buckets of over most fingerprints each comes once for each of bits + 1 parts of the other segment.

    Fingerprints of a bucket that differ in at most so many bits agree in one of the parts at least, so no link is lost.
    A bucket has the fingerprints of two segments, so only those with a segment that over half as many have need be counted.
    """
    rows = variants(fps)
    common = stored(segments(fps).groupBy("side", "segment").agg(F.count("*").alias("n")).filter(F.col("n") > most // 2), "common")
    if common.isEmpty():
        return rows
    sizes = wildcards(common).groupBy("key").agg(F.sum("n").alias("n"), F.lit(True).alias("hot"))
    marked = lookup(rows, stored(sizes, "hot"), "key", F.col("fp"))
    other = F.when(F.shiftrightunsigned("key", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    width = -(-32 // (bits + 1))
    parts = F.array(*(F.shiftrightunsigned(other, k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(bits + 1)))
    again = marked.filter("hot").select("key", "fp", F.posexplode(parts).alias("no", "part"))
    return marked.filter("hot IS NULL").select("key", "fp").unionByName(again.select(F.xxhash64("key", "no", "part").alias("key"), "fp"))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, whose components are those of all links of at most bits bits."""
    if not 0 <= bits <= 2:
        raise ValueError("two segments with one wildcard each find at most two differing bits")
    return bucket_links(cut(fps.select("fp"), bits), bits).distinct()


def near_duplicates(docs: DataFrame, bits: int = 2) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable), n_copies (documents with this fingerprint)."""
    fp = stored(fingerprints(docs), "fingerprints")
    unique = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "unique")
    comp = components(links(unique, bits))
    known = unique.join(comp, unique["fp"] == comp["node"]).select("fp", "first", "n", "comp")
    least = known.groupBy("comp").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    linked = lookup(known.select("fp", "comp"), least, "comp", F.col("fp")).select(F.col("fp").alias("node"), "least")
    each = unique.join(linked, unique["fp"] == linked["node"], "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.col("n").alias("n_copies"), "n")
    out = lookup(fp, each, "fp", F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def dedup(docs: DataFrame, bits: int = 2) -> DataFrame:
    """docs, all columns: one row of each component stays, the one with the least doc_id, nulls last, then the least hash of its text.

    Different texts under one doc_id, or under none, stay if they are of different components.
    """
    fp = stored(fingerprints(docs, hashed=True), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    unique = stored(fp.groupBy("fp").agg(first), "unique")
    comp = components(links(unique, bits))
    least = unique.join(comp, unique["fp"] == comp["node"], "left").groupBy(F.coalesce("comp", "fp").alias("comp")).agg(F.min("first").alias("first"))
    own, rank, kept_id, kept_hash = (free_name(n, *docs.columns) for n in ("text_hash", "row_rank", "kept_id", "kept_hash"))
    found = least.select(F.col("first.doc_id").alias(kept_id), F.col("first.text_hash").alias(kept_hash))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    kept = hashed.join(found, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_hash)), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", own).orderBy("text"))
    return kept.withColumn(rank, first).filter(F.col(rank) == 1).select(*docs.columns)
