import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.llm import common, simhash

from conftest import sentence


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, bits=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


@settings(max_examples=200, deadline=None)
@given(st.text("aB \t\x1cé\x0b\U0001f600", max_size=30))
def test_fingerprints(t):
    assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_hash_is_the_engine_s_own(spark):
    t = "one two three"
    assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] % 2**64 == xxhash.xxh64_intdigest(t.encode(), 42)


def test_links_and_components_against_brute_force(spark):
    rng = np.random.default_rng(5)
    fps = [0, 1, 3, 2**64 - 1, 2**63, 2**32, 2**32 + 2**31]
    for c in rng.integers(0, 2**64, 30, np.uint64).tolist():
        x = c
        for _ in range(8):  # chains: each link is near, the ends are far
            x ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            fps.append(x)
        fps.append(c ^ 7)
    fps = sorted({int(f) for f in fps}, key=lambda f: np.uint64(f).view(np.int64))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = {r.node: r.comp for r in common.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp LONG"))).collect()}
    want = roots(fps)
    assert {f: got.get(f, f) for f in signed} == {f: signed[r] for f, r in zip(signed, want, strict=True)}


def test_large_buckets_are_cut(monkeypatch):
    rng = np.random.default_rng(1)
    base = int(rng.integers(2**62))
    fp = np.unique(np.array([base ^ int(sum(1 << int(b) for b in rng.integers(0, 24, 6))) for _ in range(400)], np.uint64))
    whole = simhash.spanning(fp, 2)

    def groups(edges):
        root = {int(f): int(f) for f in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for f in root:
            out.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, out.values()))

    monkeypatch.setattr(simhash, "BUCKET", 16)
    assert groups(simhash.forest(fp, 2)) == groups(whole)


def test_hot_buckets_are_cut_before_they_meet(spark):
    """Fingerprints that all share a half: the same components when every bucket counts as hot."""
    rng = np.random.default_rng(9)
    fps = sorted({5 << 32 | int(x) for x in rng.integers(0, 1 << 32, 60)} | {5 << 32 | 1 << int(b) | 1 << int(c) for b, c in rng.integers(0, 32, (60, 2))})
    rows = spark.createDataFrame([(f,) for f in fps], "fp LONG")
    cut = simhash.cut(rows, 2, 3)
    assert cut.groupBy("key").count().agg(F.max("count")).first()[0] < len(fps) and simhash.cut(rows, 2).count() == 64 * len(fps)
    got = {r.node: r.comp for r in common.components(simhash.bucket_links(cut, 2).distinct()).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: fps[r] for f, r in zip(fps, roots(fps), strict=True)}


def test_hubs(spark, monkeypatch):
    """A node with very many edges, and chains behind it."""
    monkeypatch.setattr(common, "HUB", 1000)
    edges = [(0, k) for k in range(1, 2000)] + [(2000 + k, 2001 + k) for k in range(40)] + [(1999, 2040)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == dict.fromkeys(range(2041), 0)


def test_query_on_odd_rows(odd, empty):
    rows = [r for r in odd.collect()]
    fps = [brute_fingerprint(r.text) for r in rows]
    root = roots(fps)
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[k] = min(r.doc_id, least.get(k, r.doc_id))
    want = sorted(str((r.doc_id, f"{f:016x}", least.get(k))) for r, f, k in zip(rows, fps, root, strict=True))
    got = simhash.near_duplicates(odd).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.dedup(empty).count() == 0


def test_dedup_keeps_one_of_each(odd):
    kept = simhash.dedup(odd).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and set(ids) == {r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert simhash.dedup(odd).columns == odd.columns


def test_dedup_keeps_a_row_of_each_component(spark):
    """Texts without doc_id, and different texts under one, are kept apart; copies of a kept document go."""
    rows = [(None, sentence(k)) for k in range(10, 20) for _ in range(1 + k % 3)] + [(1, sentence(1)), (None, sentence(1)), (1, sentence(2)), (1, sentence(1)), (3, sentence(2)), (7, sentence(3)), (5, sentence(3)), (None, None), (None, " ")]
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = {}
    for row, k in zip(rows, roots(fps), strict=True):
        groups.setdefault(k, []).append(row)
    want = [min((i is None, i or 0) for i, _ in g) for g in groups.values()]
    got = simhash.dedup(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(want) and len(got) == 14
    at = {t: k for (_, t), k in zip(rows, roots(fps), strict=True)}
    assert sorted(at[r.text] for r in got) == sorted(groups)


def test_hot_keys_in_lookups(spark):
    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"))
    right = left.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v"))
    got = common.lookup(left, right, "k", F.col("id"))
    assert got.columns == ["id", "k", "v"] and got.count() == 5000
    assert got.filter("k IS NULL").agg(F.count("v")).first()[0] == 0 and got.filter("k = 7 AND v <> 4998").count() == 0
    assert common.lookup(left, right, "k", F.col("id"), "inner").count() == left.filter("k IS NOT NULL").count()
