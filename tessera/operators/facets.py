"""Facets over a filtered set: one pass for all of them, and each by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import time_of_day


def summary(filtered: DataFrame) -> DataFrame:
    """Total, photos, videos and the range of dates."""
    return filtered.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("duration_seconds").isNull()).alias("photos"),
        F.count_if(F.col("duration_seconds").isNotNull()).alias("videos"),
        F.min("captured_at").alias("min_date"),
        F.max("captured_at").alias("max_date"),
    )


def timeline(filtered: DataFrame, ts: str = "captured_at") -> DataFrame:
    """Months with their counts and newest date."""
    t = F.col(ts)
    groups = filtered.where(t.isNotNull()).groupBy(F.year(t).alias("year"), F.month(t).alias("month_number"))
    out = groups.agg(F.count("*").alias("count"), F.max(t).alias("newest"))
    return out.select("year", F.lpad(F.col("month_number").cast("string"), 2, "0").alias("month"), F.date_format("newest", "MMM").alias("month_name"), "count", "newest")


def by_value(filtered: DataFrame, value: Column, limit: int | None = None) -> DataFrame:
    """Counts of a value, nulls and blanks left out; the most frequent ones, ties by value."""
    out = filtered.select(value.alias("value")).where("value is not null and value <> ''").groupBy("value").agg(F.count("*").alias("count"))
    return out if limit is None else out.orderBy(F.desc("count"), "value").limit(limit)


def times_of_day(filtered: DataFrame, hour: Column) -> DataFrame:
    counts = filtered.select(time_of_day(hour).alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("count"))
    return counts.select(F.lower("label").alias("value"), "label", "count")


def by_bridge(filtered: DataFrame, bridge: DataFrame, bridge_key: str, dim: DataFrame, dim_key: str, label: str, limit: int, id_: str = "id") -> DataFrame:
    """Counts of bridge rows of the filtered ids by a dimension, the most frequent first: value, label, count.

    Counts are made by key before the dimension's labels are joined, so the join is with groups, not rows.
    """
    ids = filtered.select(F.col(id_).alias(bridge_key))
    counts = bridge.join(ids, bridge_key, "left_semi").groupBy(dim_key).agg(F.count("*").alias("count"))
    named = counts.join(dim.select(dim_key, F.col(label).alias("label")).where(F.btrim("label") != ""), dim_key)
    return named.select(F.col(dim_key).cast("string").alias("value"), "label", "count").orderBy(F.desc("count"), "label", "value").limit(limit)


def long_form(filtered: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """Several facets in one pass and one aggregation: facet, value, count."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value")) for name, value in facets.items()])
    rows = filtered.select(F.explode(pairs).alias("x")).select("x.facet", "x.value").where("value is not null and value <> ''")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("count"))


def nested(long: DataFrame) -> DataFrame:
    """Each facet's values as one array, most frequent first."""
    entry = F.struct((-F.col("count")).alias("order"), "value", "count")
    rows = long.groupBy("facet").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    return rows.select("facet", F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("values"))


def map_cells(points: DataFrame, lat: str, lng: str, cell: float) -> DataFrame:
    """Grid cells with counts and bounds."""
    at = [F.floor(F.col(lat) / cell).alias("row"), F.floor(F.col(lng) / cell).alias("col")]
    bounds = [f(x).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a, x in (("lat", lat), ("lng", lng))]
    return points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).groupBy(*at).agg(F.count("*").alias("count"), *bounds)
