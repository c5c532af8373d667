"""The library's tables as views over the input tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

NOW = "1998-08-01 00:00:00"
#: Lines of an order whose tags a task groups.
TAG_LINES = 250_000


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def assets(spark: SparkSession, sf: str, undated: bool = False) -> DataFrame:
    """Orders as assets; undated leaves every seventh without a date."""
    o = table(spark, sf, "orders")
    ts = F.col("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        (F.when(F.col("o_orderkey") % 7 != 0, ts) if undated else ts).alias("captured_at"),
        F.when(F.col("o_orderstatus") == "O", F.round(F.col("o_totalprice") / 1000, 2)).alias("duration_seconds"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_favorite"),
        F.when(F.col("o_orderkey") % 10 == 3, ts + F.expr("interval 3 days")).alias("deleted_at"),
        F.col("o_orderpriority").alias("city"),
        F.col("o_orderstatus").alias("camera_model"),
        F.concat(F.lit("t/"), F.col("o_orderkey").cast("string")).alias("thumb_path"),
        F.col("o_totalprice").alias("price"),
    )


def assets_sql(undated: bool = False) -> str:
    ts = "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END" if undated else "o_orderdate"
    return f"""(SELECT o_orderkey AS id, o_custkey AS user_id, {ts} AS captured_at,
        CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice / 1000, 2) END AS duration_seconds,
        o_orderpriority = '1-URGENT' AS is_favorite,
        CASE WHEN o_orderkey % 10 = 3 THEN o_orderdate + INTERVAL 3 DAY END AS deleted_at,
        o_orderpriority AS city, o_orderstatus AS camera_model, 't/' || o_orderkey AS thumb_path, o_totalprice AS price FROM orders)"""


def folders(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files in a tree of region, nation and segment."""
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("c_custkey").alias("id"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("folder_path"), F.col("c_name").alias("thumb_path"), F.col("c_acctbal").alias("score")
    )


FOLDERS_SQL = """(SELECT c_custkey AS id, r_name || '/' || n_name || '/' || c_mktsegment AS folder_path, c_name AS thumb_path, c_acctbal AS score
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def asset_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of an order's parts as its tags, once each with the greatest confidence."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    named = li.select("l_orderkey", "l_partkey", "l_discount").join(p.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    # Nearly all keys are unique: they are dealt before they are grouped, to as many tasks as the lines ask for.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), li.count() // TAG_LINES)
    named = named.select("l_orderkey", "p_brand", "l_discount").repartition(parts, "l_orderkey", "p_brand")
    return named.groupBy(F.col("l_orderkey").alias("asset_id"), F.col("p_brand").alias("name")).agg(F.max("l_discount").alias("confidence"))


ASSET_TAGS_SQL = """(SELECT l_orderkey AS asset_id, p_brand AS name, max(l_discount) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def faces(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as faces: the supplier is the person, line price the score."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_suppkey").alias("person_id"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("face_id"), F.col("l_quantity").alias("bbox_x")
    )


FACES_SQL = """(SELECT l_orderkey AS asset_id, l_suppkey AS person_id, l_extendedprice AS score, l_orderkey * 100000 + l_partkey AS face_id, l_quantity AS bbox_x FROM lineitem)"""


def persons(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as persons; every fifth is hidden, every third without a name."""
    s = table(spark, sf, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name"))
    return s.select(F.col("s_suppkey").alias("person_id"), name.alias("name"), (F.col("s_suppkey") % 5 == 0).alias("is_hidden"))


PERSONS_SQL = """(SELECT s_suppkey AS person_id, CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE s_name END AS name, s_suppkey % 5 = 0 AS is_hidden FROM supplier)"""
