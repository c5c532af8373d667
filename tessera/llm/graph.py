"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

#: Rows of one file of an edge table: a small graph isn't spread over all partitions.
FILE_ROWS = 200_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A staged table for a join: sent to all tasks if it has a file's rows at most (some MB), so that little work isn't dealt over all partitions."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FILE_ROWS else df


def _with_least(pairs: DataFrame, label: str, files: int) -> DataFrame:
    """pairs of (u, v), read from staged tables: adds m, the least of u and all its v. Both sides of the join are plain tables, so a hot u can be split; a small one is broadcast."""
    least = stage(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "_u").coalesce(files), label)
    return pairs.join(small(least), F.col("u") == F.col("_u")).drop("_u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs to (v, component): the least vertex of each component, for all vertices with an edge.

    Each round is a few aggregations and joins on edge tables, staged in the shared folder; components of n
    vertices need about log(n) rounds, and a star is done in one.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rows = now.count()
    for _ in range(rounds if rows else 0):
        files = 1 + rows // FILE_ROWS
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both, "large", files).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _with_least(stage(large.coalesce(files), "large"), "small", files)
        near = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = stage(near.where("a <> b").distinct().coalesce(files), "edges")
        # A fixed point is a set of stars: the same edges again.
        left, rows = rows, new.count()
        if rows == left and new.join(small(now, left), ["a", "b"], "left_anti").isEmpty():
            break
        now = new
    else:
        if rows:
            raise RuntimeError("components did not converge")
    tops = now.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct()
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "v").unionByName(tops)
