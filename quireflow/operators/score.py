"""Scorecards of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.scalars import comparable
from quireflow.lineage import stored


def duplicates(chunks: DataFrame, *by: str) -> DataFrame:
    """Surplus chunks of equal comparable text, per group of by. Counts are pre-aggregated by hash before they meet."""
    texts = chunks.select(*by, comparable(F.col("text")).alias("t")).filter("t <> ''").groupBy(*by, F.sha2("t", 256).alias("h")).agg(F.count("*").alias("n"))
    return texts.groupBy(*by).agg(F.sum(F.col("n") - 1).alias("duplicate_chunks"))


def _share(part: Column, of: Column) -> Column:
    return part / F.nullif(of, F.lit(0))


def scorecard(chunks: DataFrame, *by: str, blanks: bool = False) -> DataFrame:
    """Counts, coverages (null if there is nothing to cover) and lengths: mean, nearest-rank 95th percentile and maximum.

    chunks may have context_prefix, related (how many elements), located and embedding_text; what it lacks counts as absent.
    Blank texts are copies of each other only with blanks. Texts are read once: they are counted by hash and length, and all figures are made of these counts.
    """
    have = set(chunks.columns)
    text = F.length("text")
    embedding = F.length("embedding_text") if "embedding_text" in have else text
    context = F.coalesce(F.col("context_prefix") != "", F.lit(False)) if "context_prefix" in have else F.lit(False)
    located = F.coalesce(F.col("located"), F.lit(False)) if "located" in have else F.lit(False)
    whole = lambda c: F.sum(c.cast("long"))
    same = comparable(F.col("text"))
    read = chunks.select(*by, (F.sha2(same, 256) if blanks else F.when(same != "", F.sha2(same, 256))).alias("__h"), text.alias("__size"), embedding.alias("__embedding"), context.alias("__context"), located.alias("__located"))
    counted = stored(read.groupBy(*by, "__h", "__size").agg(F.count("*").alias("__n"), whole(F.col("__context")).alias("__context"), whole(F.col("__located")).alias("__located"), F.max("__embedding").alias("__embedding"), whole(F.col("__embedding") > 2000).alias("__over")), "counted")
    texts = counted.groupBy(*by, "__h").agg(F.sum("__n").alias("__n"))
    copies = texts.groupBy(*by).agg(F.sum(F.when(F.col("__h").isNotNull(), F.col("__n") - 1).otherwise(0)).alias("duplicate_chunks"))
    sizes = counted.groupBy(*by, "__size").agg(F.sum("__n").alias("__n"))
    up_to = F.sum("__n").over(Window.partitionBy(*by).orderBy("__size"))
    of = F.sum("__n").over(Window.partitionBy(*by))
    p95 = sizes.withColumn("__up", up_to).withColumn("__of", of).filter("__up >= 0.95 * __of").groupBy(*by).agg(F.min("__size").cast("long").alias("text_p95"))
    total, mean = F.sum("__n"), F.sum(F.col("__n") * F.col("__size")) / F.sum("__n")
    card = counted.groupBy(*by).agg(
        total.alias("chunk_count"), F.sum("__context").alias("context_prefix_chunks"), _share(F.sum("__context"), total).alias("context_prefix_coverage"), _share(F.sum("__located"), total).alias("locator_coverage"), F.bround(mean, 2).alias("text_mean"),
        F.max("__size").cast("long").alias("text_max"), F.max("__embedding").cast("long").alias("embedding_max"), F.sum("__over").alias("hard_limit_violations"),
    )
    if not by:
        one = card.join(p95, F.lit(True), "left").join(copies, F.lit(True), "left")  # one row each
        return one.na.fill(0, ["chunk_count", "context_prefix_chunks", "hard_limit_violations"])
    null = [F.col(f"c.{b}").eqNullSafe(F.col(f"p.{b}")) for b in by]
    out = card.alias("c").join(p95.alias("p"), null, "left").select("c.*", "text_p95").alias("c")
    return out.join(copies.alias("p"), null, "left").select("c.*", F.coalesce("duplicate_chunks", F.lit(0)).alias("duplicate_chunks"))


def rollup(chunks: DataFrame, *by: str) -> DataFrame:
    """chunk_count, chars and mean length for each group and, with nulls, for the groups above it."""
    return chunks.rollup(*by).agg(F.count("*").alias("chunk_count"), F.sum(F.length("text")).alias("chars"), F.bround(F.avg(F.length("text")), 2).alias("text_mean"))
