import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quireflow.llm import mixing


def water(sizes):
    """Targets by sharing again and again; sizes in the order of sources."""
    w, total, out, open_ = [5, 2, 1], sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        level = left / sum(w[k % 3] for k in open_)
        full = {k for k in open_ if level * w[k % 3] > 3 * sizes[k]}
        if not full:
            for k in open_:
                out[k] = level * w[k % 3]
            return out
        for k in full:
            out[k] = 3.0 * sizes[k]
            left -= 3 * sizes[k]
        open_ -= full
    return out


def check(rows, slack=1.0):
    sizes, got, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        got[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for s, want in zip(order, water([sizes[s] for s in order]), strict=True):
        assert got[s] == pytest.approx(want) and abs(taken[s] - want) <= slack
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]


def test_odd_rows(odd):
    rows = mixing.mix(odd, block_words=16, shard_blocks=10).collect()
    assert len(rows) == odd.count()
    check(rows)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd.filter("doc_id IS NOT NULL").collect()}
    assert {r["doc_id"]: r["size"] for r in rows if r["doc_id"] is not None} == size


def test_empty(empty, spark):
    assert mixing.mix(empty).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id LONG, text STRING, source STRING")).collect()
    assert [(r["target"], r["taken"]) for r in none] == [(0.0, 0)] * 2


@pytest.mark.parametrize("sizes", [[1000], [1, 1000, 1000], [10, 20, 30, 4000, 5], [0, 7, 0, 9], [3, 3, 3, 3, 3, 3, 3]])
def test_targets(spark, sizes):
    s = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source STRING, source_size LONG")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(water(sizes))


def test_reruns_and_partitions_agree(odd, spark):
    a = sorted(map(repr, mixing.mix(odd).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(repr, mixing.mix(odd.repartition(5)).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_shards_are_exact_and_disjoint(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text"))
    placed, sources = mixing.placed(docs, bucket_docs=50)
    quotas, shards = mixing.shard_quotas(sources, 8, 64, 42)
    by, total = defaultdict(int), defaultdict(int)
    for r in quotas.collect():
        by[r.shard] += r.blocks
        total[r.number] += r.blocks
        assert r.blocks >= 0
    assert len(by) == shards > 8 and max(by.values()) - min(by.values()) <= 1
    assert dict(total) == {r.number: -(-r.quota // 8) for r in sources.collect()}
    p = mixing.pieces(placed, sources, 8, 64).collect()
    seen = set()
    for r in p:
        for k in range(r.word, r.word + r.words):
            assert (r.doc_id, r.turn, k) not in seen
            seen.add((r.doc_id, r.turn, k))
    assert len(seen) == sum(r.quota for r in sources.collect())
    texts = mixing.mixed_text(docs, mixing.pieces(placed, sources, 8, 64), placed)
    assert texts.agg(F.sum(F.regexp_count("text", F.lit("w")))).first()[0] == len(seen)


def test_draw_is_hypergeometric(spark):
    """Mean and variance of many draws."""
    n = spark.range(3000).select(F.col("id").alias("lo"), F.lit(10**6).cast("long").alias("hi"), F.expr("array(30L, 50L, 20L)").alias("q"), F.lit(40).cast("long").alias("draws"))
    x = n.select(F.expr(mixing._left(7)).alias("x")).select(*(F.col("x")[k].alias(f"x{k}") for k in range(3)))
    r = x.agg(*(F.avg(f"x{k}") for k in range(3)), *(F.variance(f"x{k}") for k in range(3)), F.min(F.col("x0") + F.col("x1") + F.col("x2")), F.max(F.col("x0") + F.col("x1") + F.col("x2"))).first()
    for k, own in enumerate((30, 50, 20)):
        var = 40 * (own / 100) * (1 - own / 100) * 60 / 99
        assert r[k] == pytest.approx(40 * own / 100, abs=4 * (var / 3000) ** 0.5) and r[3 + k] == pytest.approx(var, rel=0.15)
    assert r[6] == r[7] == 40


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 12345])
def test_permutation_is_a_bijection(spark, n):
    x = spark.range(n).select(*(F.expr(mixing.permuted("id", f"{n}L", f"{k}L")).alias(f"p{k}") for k in (1, 2))).collect()
    assert sorted(r.p1 for r in x) == sorted(r.p2 for r in x) == list(range(n))
    if n >= 1000:
        order = [r.p1 for r in x]
        assert order != [r.p2 for r in x] and sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < n / 20


def test_shards_draw_from_all_passes(spark):
    """A source taken three times over: its passes are spread over the shards, not one after the other."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "a").otherwise("b").alias("source"), F.repeat(F.lit("w "), 20).alias("text"))
    placed, sources = mixing.placed(docs, bucket_docs=50)
    p = mixing.pieces(placed, sources, 8, 64).filter("number = 0").groupBy("shard").agg(F.countDistinct("turn").alias("turns")).collect()
    assert len(p) > 8 and sum(r.turns == 3 for r in p) > len(p) / 2


def test_mixture_keeps_columns(odd):
    """Columns of docs with the names of the result's own come back under other names, with their values."""
    m = mixing.mixed(odd)
    assert m.columns == [c + "_" if c in ("size", "taken", "target") else c for c in odd.columns] + ["size", "source_size", "target", "taken"]
    rows = m.collect()
    assert rows and all((r["size_"], r["target_"], r["taken_"]) == ("x", "x", 1) for r in rows) and all(r["taken"] > 0 for r in rows)
