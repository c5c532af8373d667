"""Changes of several tables together, as new states: faces and persons, albums, and what a finished job commits.

Changes come as tables too, one row for each thing to be changed, so any number of them is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import prefixes
from tessera.operators.folders import folder_albums
from tessera.operators.mutations import inserted, latest, links_upserted, valid_references
from tessera.operators.vectors import centroids

FACE_CHANGES = ("delete", "unlink", "verify", "reassign", "split")


# --- faces and persons ---


def faces_changed(faces: DataFrame, changes: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces after changes (face_id, change, target): deleted, unlinked from their person, verified, reassigned to a known person, or split off to a new one.

    faces has face_id, person_id and is_verified. A reassignment to a person that isn't there changes nothing;
    the target of a split is the new person's id.
    """
    known = persons.select(F.col("person_id").alias("target"), F.lit(True).alias("_known"))
    asked = changes.join(known, "target", "left").where((F.col("change") != "reassign") | F.col("_known")).select("face_id", "change", "target")
    out = faces.join(asked, "face_id", "left").where(F.coalesce(F.col("change") != "delete", F.lit(True)))
    kind = faces.schema["person_id"].dataType
    person = F.when(F.col("change") == "unlink", F.lit(None).cast(kind)).when(F.col("change").isin("reassign", "split"), F.col("target").cast(kind)).otherwise(F.col("person_id"))
    verified = F.col("is_verified") | F.coalesce(F.col("change").isin("verify", "reassign", "split"), F.lit(False))
    return out.withColumns({"person_id": person, "is_verified": verified}).select(*faces.columns)


def membership_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Persons that lost or gained a face: person_id."""
    old, new = (t.select("face_id", F.col("person_id").alias(n)) for t, n in ((before, "_old"), (after, "_new")))
    moved = old.join(new, "face_id", "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return moved.select(F.explode(F.array("_old", "_new")).alias("person_id")).where("person_id is not null").distinct()


def persons_recomputed(persons: DataFrame, faces: DataFrame, affected: DataFrame) -> DataFrame:
    """Persons after the affected ones got their centroid and number of faces anew; those without faces go, unknown ones come in without a name.

    persons: person_id, name, face_count, centroid; faces: person_id, embedding.
    """
    made = centroids(faces.join(affected, "person_id", "left_semi"), "person_id", "embedding")
    made = made.join(persons.select("person_id", "name"), "person_id", "left").select("person_id", "name", F.col("n").alias("face_count"), "centroid")
    return persons.join(affected, "person_id", "left_anti").select("person_id", "name", "face_count", "centroid").unionByName(made)


def valid_merges(persons: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges (source, target) of two different persons that are both there."""
    ids = merges.select("source", "target", F.explode(F.array_distinct(F.array("source", "target"))).alias("person_id"))
    counted = ids.join(persons.select("person_id").distinct(), "person_id").groupBy("source", "target").agg(F.count("*").alias("n"))
    return counted.where("n >= 2").select("source", "target")


def persons_merged(faces: DataFrame, merges: DataFrame) -> DataFrame:
    """Faces after all merges; a source is merged once."""
    out = faces.join(merges.select(F.col("source").alias("person_id"), "target"), "person_id", "left")
    return out.withColumn("person_id", F.coalesce("target", "person_id")).select(*faces.columns)


def persons_renamed(persons: DataFrame, names: DataFrame) -> DataFrame:
    """Persons with new names (person_id, new_name), trimmed."""
    return persons.join(names, "person_id", "left").withColumn("name", F.coalesce(F.btrim("new_name"), "name")).drop("new_name")


def persons_deleted(persons: DataFrame, faces: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons and faces after persons are deleted: their faces stay, without a person."""
    left = persons.join(gone, "person_id", "left_anti")
    return left, valid_references(faces, "person_id", left, "person_id")


# --- albums ---


def albums_created(albums: DataFrame, wanted: DataFrame) -> DataFrame:
    """Albums after those in wanted (title, description) and all their ancestors are there: title, description.

    Titles lose outer slashes and spaces and empty segments; empty ones make nothing. Albums that are there are
    used again; a description goes to the last segment only, if one is given. Of equal titles one is used.
    """
    clean = F.array_join(F.filter(F.split(F.btrim("title"), "/"), lambda s: s != ""), "/")
    leaves = wanted.select(clean.alias("title"), "description").where("title <> ''")
    every = leaves.select(F.explode(prefixes(F.col("title"))).alias("title")).distinct()
    given = leaves.groupBy("title").agg(F.max("description").alias("_given"))
    old = albums.select("title", "description").join(given, "title", "left")
    new = every.join(albums.select("title"), "title", "left_anti").join(given, "title", "left").select("title", F.col("_given").alias("description"))
    return old.select("title", F.coalesce("_given", "description").alias("description")).unionByName(new)


def albums_deleted(albums: DataFrame, members: DataFrame, assets: DataFrame, gone: DataFrame, now: Column, with_media: bool) -> dict[str, DataFrame]:
    """albums, members and assets after albums are deleted.

    With their media: albums and the live assets in them go to the trash. Without: albums and memberships are gone
    for good and assets stay.
    """
    if not with_media:
        return {"albums": albums.join(gone, "album_id", "left_anti"), "members": members.join(gone, "album_id", "left_anti"), "assets": assets}
    mark = gone.select("album_id", F.lit(True).alias("_gone"))
    inside = members.join(gone, "album_id", "left_semi").select(F.col("asset_id").alias("id"), F.lit(True).alias("_gone")).distinct()
    trashed = F.when(F.col("_gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))
    again = F.when(F.col("_gone"), now).otherwise(F.col("deleted_at"))
    return {
        "albums": albums.join(mark, "album_id", "left").withColumn("deleted_at", again).drop("_gone"),
        "members": members,
        "assets": assets.join(inside, "id", "left").withColumn("deleted_at", trashed).drop("_gone"),
    }


def sub_albums(albums: DataFrame, path: str, order: str) -> DataFrame:
    """Albums below a path, the first of each direct sub-name; at the root, albums of one segment. Adds sub_name."""
    clean = F.btrim("title", F.lit("/"))
    at = path.strip("/")
    if not at:
        return albums.withColumn("sub_name", clean).where(~F.col("sub_name").contains("/"))
    below = albums.withColumn("_clean", clean).where(F.col("_clean").startswith(at + "/"))
    below = below.withColumn("sub_name", F.split_part("_clean", F.lit("/"), F.lit(at.count("/") + 2))).drop("_clean")
    best = below.groupBy("sub_name").agg(F.min_by(F.struct(*[c for c in below.columns if c != "sub_name"]), order).alias("_b"))
    return best.select("_b.*", "sub_name")


def album_patches(albums: DataFrame, patches: DataFrame) -> DataFrame:
    """Albums with patches (album_id, new_title, new_description, new_cover, new_thumb, n_removed) on them; what a patch leaves null stays, and counts don't fall below 0."""
    out = albums.join(patches, "album_id", "left")
    new = {n: F.coalesce(p, n) for n, p in (("title", "new_title"), ("description", "new_description"), ("cover_asset_id", "new_cover"), ("cover_thumb", "new_thumb"))}
    new["media_count"] = F.greatest(F.col("media_count") - F.coalesce("n_removed", F.lit(0)), F.lit(0).cast("long"))
    return out.withColumns(new).select(*albums.columns)


def upload_progress(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes loaded of all files and the share in percent, of rows with part, total_parts and size for each file that is under way."""
    share = F.col("part") / F.col("total_parts")
    loaded = F.least(F.col("size").cast("double"), share * F.col("size"))
    return parts.groupBy(*keys).agg(F.sum(loaded).alias("loaded"), F.sum("size").alias("size"), F.max(F.least(F.lit(100), F.round(share * 100))).cast("int").alias("most_percent"))


# --- commits of finished jobs ---


def base_committed(state: dict[str, DataFrame], jobs: DataFrame) -> dict[str, DataFrame]:
    """assets, members, tags and items after finished jobs are committed.

    jobs: asset_id, sha256, folder_path, captured_at, hashtags (array), author, item_id. An asset that is there
    stays; new ones are put in the albums of all their ancestor folders, get their hashtags and author as tags
    ("unknown" and "web" are no authors), and the scraped items they came from are downloaded.
    """
    new = latest(jobs, ["asset_id"], ["sha256"])
    assets = inserted(state["assets"], new.select("asset_id", "sha256", "folder_path", "captured_at"), ["asset_id"])
    folders = folder_albums(new, "asset_id").select("title", "asset_id").distinct()
    tags = new.select("asset_id", F.explode(F.concat(F.col("hashtags"), F.when(F.col("author").isin("", "unknown", "web") | F.col("author").isNull(), F.array().cast("array<string>")).otherwise(F.array("author")))).alias("name"))
    tags = tags.select("asset_id", F.lower(F.btrim("name")).alias("name"), F.lit(1.0).alias("confidence")).where("name <> ''").distinct()
    done = new.where("item_id is not null").groupBy("item_id").agg(F.min("asset_id").alias("_asset"))
    items = state["items"].join(done, "item_id", "left")
    items = items.withColumns({"status": F.when(F.col("_asset").isNotNull(), "downloaded").otherwise(F.col("status")), "asset_id": F.coalesce("_asset", "asset_id")}).drop("_asset")
    return {"assets": assets, "members": inserted(state["members"], folders, ["title", "asset_id"]), "tags": links_upserted(state["tags"], tags, ["asset_id", "name"]), "items": items}


def enrichment_committed(state: dict[str, DataFrame], found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """assets, persons, faces, poses and tags after what was found in assets is committed. Findings for assets that aren't there are dropped.

    found: vectors (asset_id, embedding), persons (person_id, centroid, cover_face_id), clusters (person_id, centroid,
    face_count), faces (face_id, asset_id, person_id, score), poses (asset_id, pose_id, score), tags (asset_id, name,
    confidence). New persons that are there stay as they are; a face of an unknown person has none; a cover is set only
    if its face is there; new poses replace all of their asset; tags keep the greater confidence.
    """
    there = state["assets"].select("asset_id")
    own = {n: t.join(there, "asset_id", "left_semi") if "asset_id" in t.columns else t for n, t in found.items()}
    persons = inserted(state["persons"], own["persons"].select("person_id", F.lit(1).cast("long").alias("face_count"), "centroid", F.lit(None).cast("long").alias("cover_face_id")), ["person_id"])
    moved = own["clusters"].select("person_id", F.col("centroid").alias("_c"), F.col("face_count").cast("long").alias("_n"))
    persons = persons.join(moved, "person_id", "left").withColumns({"centroid": F.coalesce("_c", "centroid"), "face_count": F.coalesce("_n", "face_count")}).drop("_c", "_n")
    faces = inserted(state["faces"], valid_references(own["faces"], "person_id", persons, "person_id"), ["face_id"])
    covers = own["persons"].where("cover_face_id is not null").select("person_id", F.col("cover_face_id").alias("_f"))
    covers = covers.join(faces.select(F.col("face_id").alias("_f")), "_f", "left_semi")
    persons = persons.join(covers, "person_id", "left").withColumn("cover_face_id", F.coalesce("_f", "cover_face_id")).drop("_f")
    poses = state["poses"].join(own["poses"].select("asset_id").distinct(), "asset_id", "left_anti").unionByName(own["poses"])
    flags = {"clip_processed": own["vectors"].where("embedding is not null"), "face_processed": own["faces"], "tags_processed": own["tags"]}
    assets = state["assets"]
    for name, rows in flags.items():
        hit = rows.select("asset_id").distinct().withColumn("_hit", F.lit(True))
        assets = assets.join(hit, "asset_id", "left").withColumn(name, F.col(name) | F.coalesce("_hit", F.lit(False))).drop("_hit")
    return {"assets": assets, "persons": persons, "faces": faces, "poses": poses, "tags": links_upserted(state["tags"], own["tags"], ["asset_id", "name"])}
