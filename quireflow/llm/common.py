"""What the operators of this subpackage share: skew-safe lookups and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.lineage import shared_dir, stored

__all__ = ["components", "free_name", "hot_keys", "lookup", "shared_dir", "stored"]

#: A key that holds at least this share of the rows is hot, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 1000
#: A node with so many edges is a hub.
HUB = 10_000


def free_name(name: str, *taken: str) -> str:
    """name, with underscores after it until no column is called so (case does not count)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def hot_keys(counts: DataFrame, n: str = "n") -> DataFrame:
    """Rows of counts whose n is at least a thousandth of the sum of n, and over one: at most HOT_PARTS rows."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return counts.filter((F.col(n) > 1) & (F.col(n) * HOT_PARTS >= total))


def lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left", n: str = "n") -> DataFrame:
    """left joined with right (one row a key) on the same-named column, whatever share of left a key holds.

    right has the number n of left's rows for each key. The at most HOT_PARTS keys with a thousandth
    of all rows are broadcast and their rows dealt out by the expression spread; all other keys meet in a shuffle join.
    Returns left's columns and right's other columns but n. Null keys match nothing and are dealt out too.
    """
    values = [c for c in right.columns if c not in (key, n)]
    hot = hot_keys(right, n).select(F.col(key).alias("__hot_key"), F.struct(*values).alias("__hot"))
    rest = right.select(F.struct(F.col(key).alias("k"), F.lit(0).alias("salt")).alias("__key"), F.struct(*values).alias("__rest"))
    marked = left.join(F.broadcast(hot), left[key] == F.col("__hot_key"), "left")
    odd = F.col("__hot").isNotNull() | F.col(key).isNull()
    salt = F.when(odd, 1 + F.pmod(F.xxhash64(spread), F.lit(100_003))).otherwise(0).cast("int")
    # One struct, not two columns: a salt that is 0 for all of right would be folded away.
    out = marked.withColumn("__salted", F.struct(F.col(key).alias("k"), salt.alias("salt"))).join(rest, F.col("__salted") == F.col("__key"), "left")
    found = F.coalesce(F.col("__hot"), F.col("__rest"))
    if how == "inner":
        out = out.filter(found.isNotNull())
    return out.select(*[left[c] for c in left.columns], *[found[v].alias(v) for v in values])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b long): a row (node, comp) per node, comp the least node reachable.

    Labels sink to the least neighbour's label and then to that label's own label, until nothing changes.
    Each round is written to the shared folder; a node with many edges, or a label that many nodes have, is looked up by broadcast.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp"), F.count("*").alias("degree")), "labels")
    degrees = labels.select("node", "degree")
    hubs = not labels.filter(F.col("degree") >= HUB).isEmpty()
    while True:
        known = labels.select(F.col("node").alias("b"), "comp")
        met = lookup(both, known.join(degrees.withColumnRenamed("node", "b"), "b"), "b", F.col("a"), "inner", "degree") if hubs else both.join(known, "b")
        near = met.groupBy("a").agg(F.min("comp").alias("near"))
        sunk = stored(labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was")), "sunk")
        sizes = sunk.groupBy(F.col("comp").alias("node")).agg(F.count("*").alias("n"))
        roots = sunk.join(sizes, "node").select(F.col("node").alias("comp"), F.col("comp").alias("up"), "n")
        after = stored(lookup(sunk, roots, "comp", F.col("node")).select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "was"), "labels")
        labels = after.select("node", "comp")
        if after.filter(F.col("comp") != F.col("was")).isEmpty():
            return labels
