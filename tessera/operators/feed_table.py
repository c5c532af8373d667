"""Pages of a feed from a table that is kept in page order: a page reads the files it needs.

A feed table is rows dealt by ranges of the page order and sorted, a folder for each range (part), and a small table of bounds:
of each part its first and last place in the order and its number of rows. A place is two numbers that ascend along
the pages: for the timeline the negative time and id, with undated rows last; for the shuffled order its stored key and the id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators.feed import shuffle_key
from tessera.operators.filters import FeedRequest, clamp_limit
from tessera.session import shared_dir

#: Rows of a part, about.
PART_ROWS = 100_000
UNDATED = 2**63 - 1


def place(sort: str, seed: int, ts: Column, id_: Column) -> tuple[Column, Column]:
    """Where a row stands: two numbers that ascend along the pages."""
    if sort == "random":
        return shuffle_key(id_, seed), id_.cast("long")
    return F.coalesce(-F.unix_micros(ts.cast("timestamp")), F.lit(UNDATED)), -id_.cast("long")


@dataclass(frozen=True)
class FeedTable:
    """Where a feed has been written, and its order."""

    path: str
    sort: str
    seed: int
    ts: str
    id_: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def bounds(self, spark: SparkSession) -> DataFrame:
        """part, first and last (places as structs), n."""
        return spark.read.parquet(f"{self.path}/bounds")


def build(df: DataFrame, sort: str = "added", seed: int = 1337, ts: str = "captured_at", id_: str = "id", path: str | None = None, part_rows: int = PART_ROWS) -> FeedTable:
    """Write df, whose ids are unique, in page order."""
    spark = df.sparkSession
    table = FeedTable(path or f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}", sort, seed, ts, id_)
    a, b = place(sort, seed, F.col(ts), F.col(id_))
    rows = df.withColumns({"_a": a, "_b": b})
    parts = 1 + df.count() // part_rows
    dealt = rows.repartitionByRange(parts, "_a", "_b").withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("part", "_a", "_b").write.partitionBy("part").parquet(f"{table.path}/rows")
    at = F.struct("_a", "_b")
    # One file: a row for each part.
    if df.isEmpty():
        held = spark.createDataFrame([], "part int, first struct<_a: bigint, _b: bigint>, last struct<_a: bigint, _b: bigint>, n bigint")
    else:
        held = table.rows(spark).groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    held.coalesce(1).sortWithinPartitions("first").write.parquet(f"{table.path}/bounds")
    return table


def _after(at: tuple[int, int]) -> Column:
    return (F.col("_a") > at[0]) | ((F.col("_a") == at[0]) & (F.col("_b") > at[1]))


def cursor(spark: SparkSession, table: FeedTable, req: FeedRequest) -> tuple[int, int] | None:
    """The place of a request's cursor, whatever became of the row itself."""
    if req.cursor_id is None and req.cursor_captured_at is None:
        return None
    if req.cursor_id is None:
        raise ValueError("a cursor has an id")
    ts = F.lit(req.cursor_captured_at).cast("timestamp_ntz")
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(place(table.sort, table.seed, ts, F.lit(req.cursor_id)), "ab", strict=True)]).head()
    return row.a, row.b


def page(spark: SparkSession, table: FeedTable, req: FeedRequest, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[list[Row], bool, list[int]]:
    """The rows of a page in order, whether more follow, and the parts that were read.

    keep filters rows. Parts are taken in order from the one that the cursor is in: as many as hold enough rows, and where the
    filter leaves too few of them, twice as many of the next ones, and so on. What comes to the driver is a page.
    """
    limit, at = clamp_limit(req.limit), cursor(spark, table, req)
    found: list[Row] = []
    read: list[int] = []
    ahead, most, last = table.bounds(spark), 1, None
    if at is not None:
        ahead = ahead.where(F.col("last") > F.struct(F.lit(at[0]).cast("long").alias("_a"), F.lit(at[1]).cast("long").alias("_b")))
    while len(found) <= limit:
        left = ahead if last is None else ahead.where(F.col("first") > F.struct(F.lit(last[0]).cast("long").alias("_a"), F.lit(last[1]).cast("long").alias("_b")))
        parts = left.orderBy("first").limit(most).collect()
        if not parts:
            break
        rows = table.rows(spark).where(F.col("part").isin([p.part for p in parts]))
        rows = rows if at is None else rows.where(_after(at))
        rows = rows if keep is None else keep(rows)
        found += rows.orderBy("_a", "_b").limit(limit + 1 - len(found)).drop("part").collect()
        read += [p.part for p in parts]
        last, most = (parts[-1].last._a, parts[-1].last._b), 2 * most
    return found[:limit], len(found) > limit, read
