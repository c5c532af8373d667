"""Pages from a table in page order: the rows of the whole feed, and few parts read."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import feed, feed_table
from tessera.operators.filters import FeedRequest

ROWS = 4000


@pytest.fixture(scope="module")
def rows(spark):
    at = datetime(2020, 1, 1)
    made = [(i, None if i % 10 == 3 else at + timedelta(hours=i * 7919 % 500), i % 40 == 0) for i in range(ROWS)]
    return spark.createDataFrame(made, "id long, captured_at timestamp_ntz, rare boolean").repartition(5).cache()


@pytest.fixture(scope="module", params=["added", "random"])
def table(spark, rows, request):
    return feed_table.build(rows, request.param, part_rows=200)


def after(row, table, limit):
    return FeedRequest(sort=table.sort, limit=limit, cursor_id=row.id, cursor_captured_at=row.captured_at if table.sort == "added" else None)


def test_pages_are_those_of_the_feed(spark, rows, table):
    """From the first page on, each from the cursor before; and after every so many rows."""
    order = feed.timeline_order() if table.sort == "added" else [feed.shuffle_key(F.col("id"), 1337), F.col("id")]
    every = [r.id for r in rows.orderBy(*order).collect()]
    req, got = FeedRequest(sort=table.sort, limit=150), []
    for _ in range(4):
        own, follows, read = feed_table.page(spark, table, req)
        got += [r.id for r in own]
        assert follows and len(read) <= 3
        req = after(own[-1], table, 150)
    assert got == every[:600]
    by_id = {r.id: r for r in rows.collect()}
    for at in (0, 777, 1999, 3600, ROWS - 30, ROWS - 1):
        own, follows, read = feed_table.page(spark, table, after(by_id[every[at]], table, 40))
        assert [r.id for r in own] == every[at + 1 : at + 41] and follows == (at + 41 < ROWS) and len(read) <= 3


def test_parts(spark, table):
    """Bounds don't overlap, parts are about even, and a page's scan is of its parts alone."""
    held = table.bounds(spark).orderBy("first").collect()
    assert len(held) == 21 and sum(r.n for r in held) == ROWS and max(r.n for r in held) < 500
    assert all(tuple(a.last) < tuple(b.first) for a, b in zip(held, held[1:], strict=False))
    plan = table.rows(spark).where(F.col("part").isin([3, 4]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and "IN (3,4)" in plan


def test_a_filter_reads_on(spark, rows, table):
    """One row in forty: parts are read until the page is full, not all; a filter that keeps nothing reads all once."""
    order = feed.timeline_order() if table.sort == "added" else [feed.shuffle_key(F.col("id"), 1337), F.col("id")]
    want = [r.id for r in rows.where("rare").orderBy(*order).collect()]
    own, follows, read = feed_table.page(spark, table, FeedRequest(sort=table.sort, limit=20), lambda df: df.where("rare"))
    assert [r.id for r in own] == want[:20] and follows and 4 <= len(read) <= 15
    own, follows, read = feed_table.page(spark, table, FeedRequest(sort=table.sort, limit=20), lambda df: df.where("id < 0"))
    assert own == [] and not follows and sorted(read) == list(range(21))


def test_odd(spark):
    """No rows; a cursor of a row that is gone; all undated."""
    empty = feed_table.build(spark.createDataFrame([], "id long, captured_at timestamp_ntz"))
    assert feed_table.page(spark, empty, FeedRequest())[:2] == ([], False)
    undated = feed_table.build(spark.range(100).withColumn("captured_at", F.lit(None).cast("timestamp_ntz")).where("id <> 50"), part_rows=30)
    own, follows, _ = feed_table.page(spark, undated, FeedRequest(sort="added", limit=5, cursor_id=50))
    assert [r.id for r in own] == [49, 48, 47, 46, 45] and follows
