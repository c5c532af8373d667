"""The folder tree in path strings, and albums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import prefixes


def children(assets: DataFrame, path: str, newest: Column, cover: str = "thumb_path", folder: str = "folder_path") -> DataFrame:
    """Direct sub-folders of a path with the number of rows below and the newest row's cover: name, full_path, media_count, cover_thumb.

    newest orders rows ascending; the greatest is the cover's. At the root, empty paths and root are left out.
    """
    at = path.strip().strip("/")
    c = F.col(folder)
    if at:
        rows, name = assets.where(c.startswith(at + "/")), F.split_part(c, F.lit("/"), F.lit(at.count("/") + 2))
    else:
        rows, name = assets.where((c != "") & (c != "root")), F.split_part(c, F.lit("/"), F.lit(1))
    groups = rows.withColumn("name", name).where("name <> ''").groupBy("name")
    out = groups.agg(F.count("*").alias("media_count"), F.max_by(cover, newest).alias("cover_thumb"))
    return out.select("name", F.concat(F.lit(f"{at}/" if at else ""), "name").alias("full_path"), "media_count", "cover_thumb")


def name_order(name: str = "name") -> list[Column]:
    """By name whatever its case, which decides between equal names."""
    return [F.lower(name), F.col(name)]


def by_name(df: DataFrame, name: str = "name") -> DataFrame:
    return df.orderBy(*name_order(name))


def suggestions(folders: DataFrame, titles: DataFrame, query: str | None = None) -> DataFrame:
    """All folders and album titles and every ancestor of them, once each, those that contain the query."""
    every = folders.toDF("path").unionByName(titles.toDF("path")).where("path <> ''").distinct()
    out = every.select(F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    return out if not query else out.where(F.lower("path").contains(query.lower()))


def direct_children(paths: DataFrame, path: str = "path") -> DataFrame:
    """For each parent (the root is empty) its direct children, with the number of rows deeper than the child."""
    parts = F.split(F.col(path), "/")
    levels = F.sequence(F.lit(1), F.size(parts))
    rows = paths.select(F.size(parts).alias("depth"), parts.alias("parts"), F.explode(levels).alias("i"))
    rows = rows.select(
        F.array_join(F.slice("parts", F.lit(1), F.col("i") - 1), "/").alias("parent"), F.element_at("parts", F.col("i")).alias("name"), (F.col("depth") > F.col("i")).alias("deeper")
    )
    return rows.groupBy("parent", "name").agg(F.count_if("deeper").alias("descendants"))


def albums_with_covers(albums: DataFrame, members: DataFrame, assets: DataFrame) -> DataFrame:
    """Albums with their counts of live members and cover: the chosen one, else that of the newest member.

    albums: album_id, title, cover_asset_id; members: album_id, asset_id; assets: id, thumb_path, captured_at.
    """
    live = members.join(assets, members["asset_id"] == assets["id"])
    stats = live.groupBy("album_id").agg(F.count("*").alias("asset_count"), F.max_by("thumb_path", F.struct("captured_at", "id")).alias("newest_thumb"))
    chosen = assets.select(F.col("id").alias("cover_asset_id"), F.col("thumb_path").alias("chosen_thumb"))
    out = albums.join(stats, "album_id", "left").join(chosen, "cover_asset_id", "left")
    return out.select("album_id", "title", F.coalesce("asset_count", F.lit(0)).alias("asset_count"), F.coalesce("chosen_thumb", "newest_thumb").alias("cover_thumb"))


def album_ancestors(albums: DataFrame, title: str = "title") -> DataFrame:
    """Titles that albums with these titles need: all ancestors and the titles."""
    return albums.select(F.explode(prefixes(F.col(title))).alias("title")).distinct()


def folder_albums(assets: DataFrame, id_: str = "id", folder: str = "folder_path") -> DataFrame:
    """Every asset in the album of each ancestor of its folder: album title, asset id."""
    return assets.where((F.col(folder) != "") & (F.col(folder) != "root")).select(F.explode(prefixes(F.col(folder))).alias("title"), F.col(id_).alias("asset_id"))


def uncollected(albums: DataFrame, members: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Trashed albums to be removed: those without members, or trashed long enough ago."""
    held = members.select("album_id").distinct().withColumn("held", F.lit(True))
    old = F.col("deleted_at") <= now - F.make_interval(days=F.lit(days))
    return albums.where("deleted_at is not null").join(held, "album_id", "left").where(F.col("held").isNull() | old).drop("held")
