"""Changes of tables as new states: what a table is after an update, delete or upsert.

Nothing is written here. To publish a new state, write it to a new path and switch readers to that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import LITERAL_IDS
from tessera.operators.folders import folder_albums, uncollected


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows that satisfy where with new values, the others as they are."""
    return df.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()})


def listed(df: DataFrame, name: str, ids: Sequence[object]) -> DataFrame:
    """With _hit: whether the value of name is in the list. A long list is joined, not put in the plan."""
    if len(ids) <= LITERAL_IDS:
        return df.withColumn("_hit", F.coalesce(F.col(name).isin(list(ids)), F.lit(False)))
    rows = df.sparkSession.createDataFrame([(x,) for x in set(ids)], df.select(F.col(name).alias("_k")).schema)
    return df.join(rows, F.col(name) == F.col("_k"), "left").withColumn("_hit", F.col("_k").isNotNull()).drop("_k")


def toggled_favorites(assets: DataFrame, ids: Sequence[object], user_id: object) -> DataFrame:
    hit = F.col("_hit") & (F.col("user_id") == F.lit(user_id))
    return updated(listed(assets, "id", ids), hit, is_favorite=~F.col("is_favorite")).drop("_hit")


def toggled_trash(assets: DataFrame, where: Column, now: Column) -> DataFrame:
    """Live rows go to the trash, trashed ones come back."""
    return updated(assets, where, deleted_at=F.when(F.col("deleted_at").isNull(), now))


def expired(df: DataFrame, now: Column, days: int = 30) -> Column:
    return F.col("deleted_at").isNotNull() & (F.col("deleted_at") <= now - F.make_interval(days=F.lit(days)))


def purged(assets: DataFrame, children: dict[str, tuple[DataFrame, str]], now: Column, days: int = 30) -> dict[str, DataFrame]:
    """The tables after expired rows and their child rows are gone. children: name to (table, foreign key)."""
    doomed = assets.where(expired(assets, now, days)).select("id")
    left = {"assets": assets.where(~F.coalesce(expired(assets, now, days), F.lit(False)))}
    return left | {n: t.join(doomed.withColumnRenamed("id", k), k, "left_anti") for n, (t, k) in children.items()}


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key isn't there; of new rows with one key any one."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], values: dict[str, Column] | None = None) -> DataFrame:
    """Old rows updated from new ones with the same key, and the other new rows. new has one row for each key.

    values gives updated columns from old (o.name) and new (n.name) ones; without it new columns replace old ones.
    """
    names = [c for c in old.columns if c not in keys]
    joined = old.select(*keys, F.struct(*names).alias("o")).join(new.select(*keys, F.struct(*names).alias("n")), keys, "full")
    pick = lambda c: (values[c] if values and c in values else F.col(f"n.{c}")) if not values or c in values else F.col(f"o.{c}")
    out = [F.when(F.col("o").isNull(), F.col(f"n.{c}")).when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(pick(c)).alias(c) for c in names]
    return joined.select(*keys, *out)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*keys, *[f"_r.{c}" for c in rest])


def tags_upserted(tags: DataFrame, used: DataFrame) -> DataFrame:
    """Tag table after one more use of each name in used (name, category, source): counts go up, new names come in with one."""
    return upserted(tags, used.withColumn("usage_count", F.lit(1).cast("long")), ["name"], {"usage_count": F.col("o.usage_count") + 1})


def links_upserted(links: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Tag links after an upsert that keeps the greater confidence."""
    return upserted(links, new, keys, {"confidence": F.greatest("o.confidence", "n.confidence")})


def appended_positions(members: DataFrame, album_id: object, ids: Sequence[object]) -> DataFrame:
    """An album's members after more are added behind: given order, known ones stay where they are."""
    kind = members.schema["asset_id"].dataType.simpleString()
    spark = members.sparkSession
    listed = spark.createDataFrame([(list(ids),)], f"ids array<{kind}>").select(F.posexplode("ids").alias("position", "asset_id"))
    own = members.where(F.col("album_id") == F.lit(album_id))
    top = own.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("_top"))
    new = listed.join(own.select("asset_id"), "asset_id", "left_anti").join(F.broadcast(top)).withColumn("position", F.col("position") + F.col("_top"))
    row = new.select(F.lit(album_id).cast(members.schema["album_id"].dataType).alias("album_id"), "asset_id", F.col("position").cast(members.schema["position"].dataType).alias("position"))
    return members.select("album_id", "asset_id", "position").unionByName(row)


def reordered(members: DataFrame, album_id: object, ids: Sequence[object]) -> DataFrame:
    """Positions of an album's members by a given order; members that aren't listed keep theirs."""
    kind = members.schema["asset_id"].dataType.simpleString()
    listed = members.sparkSession.createDataFrame([(list(ids),)], f"ids array<{kind}>").select(F.posexplode("ids").alias("_p", "_a"))
    return positions_set(members, listed.select(F.lit(album_id).cast(members.schema["album_id"].dataType).alias("album_id"), F.col("_a").alias("asset_id"), F.col("_p").alias("position")))


def positions_set(members: DataFrame, order: DataFrame) -> DataFrame:
    """Members with the positions that order (album_id, asset_id, position) gives; the others keep theirs."""
    new = order.select("album_id", "asset_id", F.col("position").alias("_p"))
    out = members.join(new, ["album_id", "asset_id"], "left")
    return out.withColumn("position", F.coalesce("_p", "position").cast(members.schema["position"].dataType)).select(*members.columns)


def members_removed(albums: DataFrame, members: DataFrame, album_id: object, ids: Sequence[object]) -> tuple[DataFrame, DataFrame]:
    """Albums and members after a removal: a cover that was removed is cleared."""
    hit = (F.col("album_id") == F.lit(album_id)) & F.col("_hit")
    left = listed(members, "asset_id", ids).where(~hit).drop("_hit")
    kind = albums.schema["cover_asset_id"].dataType
    return updated(listed(albums, "cover_asset_id", ids), F.coalesce(hit, F.lit(False)), cover_asset_id=F.lit(None).cast(kind)).drop("_hit"), left


def linked_to_folders(members: DataFrame, albums: DataFrame, assets: DataFrame) -> DataFrame:
    """Members after every asset is in the album of each ancestor folder; rows that are there stay."""
    made = folder_albums(assets).join(albums.select("title", "album_id"), "title").select("album_id", "asset_id")
    return inserted(members.select("album_id", "asset_id"), made, ["album_id", "asset_id"])


def albums_collected(albums: DataFrame, members: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return albums.join(uncollected(albums, members, now, days).select("album_id"), "album_id", "left_anti")


def merged_persons(faces: DataFrame, source: object, target: object) -> DataFrame:
    return updated(faces, F.col("person_id") == F.lit(source), person_id=F.lit(target).cast(faces.schema["person_id"].dataType))


def valid_references(rows: DataFrame, name: str, known: DataFrame, key: str) -> DataFrame:
    """References to unknown rows become null."""
    ids = known.select(F.col(key).alias("_k")).distinct()
    return rows.join(ids, F.col(name) == F.col("_k"), "left").withColumn(name, F.col("_k")).drop("_k")


def items_orphaned(items: DataFrame, deleted: DataFrame) -> DataFrame:
    """Scraped items after assets are deleted: without asset, skipped."""
    gone = deleted.select(F.col("id").alias("_gone")).distinct()
    out = items.join(gone, F.col("asset_id") == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull()
    return updated(out, hit, asset_id=F.lit(None).cast(items.schema["asset_id"].dataType), status=F.lit("skipped")).drop("_gone")


def backup_pending(assets: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a mirror lacks or has in an older state, and what it must delete: id, sha256, is_deleted."""
    live = assets.where("deleted_at is null")
    both = live.join(ledger.select(F.col("asset_id").alias("id"), "synced_sha256"), "id", "left")
    new = both.where("synced_sha256 is null or synced_sha256 <> sha256").select("id", "sha256", F.lit(False).alias("is_deleted"))
    orphans = ledger.join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_anti")
    return new.unionByName(orphans.select(F.col("asset_id").alias("id"), F.lit("").alias("sha256"), F.lit(True).alias("is_deleted")))


def unique_paths(files: DataFrame, path: str, order: str) -> DataFrame:
    """Files with the path that a mirror gives them: the first of equal paths keeps it, the n-th after becomes stem_n.ext.

    Numbers are dealt within groups of equal paths; a made path that another file has by itself is counted on by
    verified_paths() in a second pass over the few that clash.
    """
    nth = F.row_number().over(Window.partitionBy(path).orderBy(order)) - 1
    has = F.col(path).contains(".")
    stem = F.when(has, F.regexp_extract(path, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(F.col(path))
    ext = F.when(has, F.concat(F.lit("."), F.regexp_extract(path, r"(?s)^.*\.([^.]*)$", 1))).otherwise(F.lit(""))
    return files.withColumn("_n", nth).withColumn("unique_path", F.when(F.col("_n") == 0, F.col(path)).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))).drop("_n")


def verified_paths(files: DataFrame, path: str, order: str, rounds: int = 20) -> DataFrame:
    """unique_paths() again and again for made paths that clash, until none does."""
    out = unique_paths(files, path, order)
    for _ in range(rounds):
        clash = out.groupBy("unique_path").agg(F.count("*").alias("n")).where("n > 1")
        if clash.isEmpty():
            return out
        made = F.col("unique_path") != F.col(path)
        again = out.withColumn("_order", F.struct(made.alias("m"), F.col(order).alias("o")))
        out = unique_paths(again.withColumn("_path", F.col("unique_path")).drop("unique_path"), "_path", "_order").drop("_path", "_order")
    raise RuntimeError("paths still clash")
