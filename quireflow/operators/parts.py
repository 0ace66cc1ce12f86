"""Shuffles in as many parts as their rows need."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of rows, as the planner estimates them, that make one part.
PART_BYTES = 4 << 20
#: The planner estimates so much where it knows nothing.
UNKNOWN = 1 << 60


def parts(*frames: DataFrame) -> int:
    """How many parts rows that meet are dealt into: as many as the session shuffles into, or more if the planner's estimate of bytes asks for it."""
    sizes = [int(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for f in frames]
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(x for x in sizes if x < UNKNOWN) // PART_BYTES))


def dealt(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Rows in parts by their keys, for an aggregation or a join on them.

    Spark joins the parts of its own shuffles until they have some megabytes as written; ids that rise and words that repeat are written so small that one
    task then sorts or hashes tens of millions of rows. It leaves alone a number of parts that is given. Keys that are nearly all different also gain
    nothing from an aggregation before the shuffle, which holds all keys of a split; none takes place here.
    """
    return rows.repartition(n or parts(rows), *keys)
