"""Persons, their faces and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.media import sane_confidence


def overview(persons: DataFrame, faces: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Visible persons with their number of live faces and the thumbnail of the best one.

    persons: person_id, name, is_hidden; faces: person_id, asset_id, face_id, score; assets restricts to ids.
    """
    live = faces if assets is None else faces.join(assets.select(F.col("id").alias("asset_id")).distinct(), "asset_id", "left_semi")
    stats = live.groupBy("person_id").agg(F.count("*").alias("face_count"), F.max_by("face_id", F.struct("score", "face_id")).alias("cover_face_id"))
    return persons.where("not is_hidden").join(stats, "person_id").select("person_id", "name", "face_count", "cover_face_id")


def faces_of(faces: DataFrame, persons: DataFrame, asset_id: object) -> DataFrame:
    """Faces of an asset with names, from left to right."""
    own = faces.where(F.col("asset_id") == F.lit(asset_id))
    return own.join(persons.select("person_id", "name"), "person_id", "left").orderBy("bbox_x", "face_id")


def directory(persons: DataFrame) -> DataFrame:
    return persons.where((F.btrim("name") != "") & ~F.col("is_hidden"))


def tags_of(asset_tags: DataFrame, tags: DataFrame, asset_id: object) -> DataFrame:
    return asset_tags.where(F.col("asset_id") == F.lit(asset_id)).join(tags, "tag_id").select("tag_id", "name", "category", "confidence")


def deduplicated_tags(tags: DataFrame, keys: list[str], name: str = "name", confidence: str = "confidence", order: str = "pos", carry: tuple[str, ...] = ()) -> DataFrame:
    """One tag of each lower-cased trimmed name: the most confident one with its other columns, the first of equals."""
    named = tags.withColumn("_name", F.lower(F.btrim(name))).withColumn("_conf", sane_confidence(F.col(confidence))).where("_name <> ''")
    best = F.max_by(F.struct("_conf", *carry), F.struct("_conf", (-F.col(order)).alias("o")))
    out = named.groupBy(*keys, "_name").agg(best.alias("b"))
    return out.select(*keys, F.col("_name").alias(name), F.col("b._conf").alias(confidence), *[F.col(f"b.{c}").alias(c) for c in carry])


def link_source(source: Column) -> Column:
    return F.when(source == "scraped", "SCRAPE").when(source == "manual", "USER").otherwise("AI")


def pooled_tags(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Highest confidence of each tag over the frames of a clip."""
    return frames.groupBy(*keys, "name").agg(F.max("confidence").alias("confidence"))
