"""Queries of table changes that touch several tables, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import commits, detect, filters, folders, mutations, snapshots, vectors
from tessera.plans import views
from tessera.plans.views import ASSET_TAGS_SQL, FOLDERS_SQL, NOW, assets_sql
from tessera.session import shared_dir, table
from tessera.sources import uploads

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- faces and persons ---

LABELS = "(SELECT DISTINCT label FROM embeddings)"
NEXT = f"(label + 1 IN (SELECT label FROM {LABELS}))"
CHANGED = f"""(SELECT vec_id AS face_id, CAST(CASE vec_id % 50 WHEN 1 THEN NULL WHEN 3 THEN CASE WHEN {NEXT} THEN label + 1 ELSE label END WHEN 4 THEN 1000000 + vec_id ELSE label END AS INTEGER) AS person_id,
    vec_id % 11 = 0 OR vec_id % 50 IN (2, 4) OR (vec_id % 50 = 3 AND {NEXT}) AS is_verified, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 <> 0)"""


def _persons(spark, sf):
    cents = vectors.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return cents.select(F.col("label").alias("person_id"), F.concat(F.lit("p"), "label").alias("name"), F.col("n").alias("face_count"), "centroid")


def _known(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").alias("person_id")).distinct()


def _faces(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("face_id"), F.col("label").alias("person_id"), (F.col("vec_id") % 11 == 0).alias("is_verified"), "embedding")


def _changed(spark, sf):
    m = F.col("vec_id") % 50
    what = F.element_at(F.array(*map(F.lit, commits.FACE_CHANGES)), (m + 1).cast("int"))
    target = F.when(m == 3, F.col("label") + 1).when(m == 4, F.col("vec_id") + 1000000)
    asked = table(spark, sf, "embeddings").where("vec_id % 50 < 5").select(F.col("vec_id").alias("face_id"), what.alias("change"), target.alias("target"))
    return commits.faces_changed(_faces(spark, sf), asked, _known(spark, sf))


@query(f"SELECT face_id, person_id, is_verified FROM {CHANGED}")
def faces_changed(spark, sf):
    return _changed(spark, sf).select("face_id", "person_id", "is_verified")


@query(f"""SELECT person_id, CASE WHEN person_id < 1000000 THEN 'p' || person_id END AS name, n AS face_count, round(x / greatest(nrm, 1e-6), 6) AS first FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY person_id)) AS nrm FROM
    (SELECT person_id, pos, avg(x) AS x, count(*) AS n FROM (SELECT person_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM {CHANGED} WHERE person_id IS NOT NULL) GROUP BY person_id, pos)) WHERE pos = 0""")
def persons_after_changes(spark, sf):
    after = _changed(spark, sf)
    out = commits.persons_recomputed(_persons(spark, sf), after, commits.membership_changed(_faces(spark, sf), after))
    return out.select("person_id", "name", "face_count", F.round(F.get("centroid", F.lit(0)), 6).alias("first"))


MERGES = f"(SELECT label AS source, label + 1 AS target FROM {LABELS} WHERE label % 2 = 0 AND {NEXT})"


@query(f"SELECT vec_id AS face_id, coalesce(target, label) AS person_id FROM embeddings LEFT JOIN {MERGES} ON source = label")
def persons_merged_valid(spark, sf):
    known = _known(spark, sf)
    wanted = known.where("person_id % 2 = 0").select(F.col("person_id").alias("source"), (F.col("person_id") + 1).alias("target"))
    wanted = wanted.unionByName(known.select(F.col("person_id").alias("source"), F.col("person_id").alias("target")))
    return commits.persons_merged(_faces(spark, sf), commits.valid_merges(known, wanted)).select("face_id", "person_id")


@query(f"SELECT label AS person_id, CASE WHEN label % 3 = 1 THEN 'New ' || label ELSE 'p' || label END AS name FROM {LABELS} WHERE label % 5 <> 0")
def persons_renamed_deleted(spark, sf):
    known = _known(spark, sf).withColumn("name", F.concat(F.lit("p"), "person_id"))
    named = known.where("person_id % 3 = 1").select("person_id", F.concat(F.lit("  New "), "person_id", F.lit(" ")).alias("new_name"))
    gone = known.where("person_id % 5 = 0").select("person_id")
    return commits.persons_deleted(commits.persons_renamed(known, named), _faces(spark, sf), gone)[0]


@query("SELECT vec_id AS face_id, CASE WHEN label % 5 <> 0 THEN label END AS person_id FROM embeddings")
def faces_of_deleted_persons(spark, sf):
    known = _known(spark, sf)
    return commits.persons_deleted(known, _faces(spark, sf), known.where("person_id % 5 = 0"))[1].select("face_id", "person_id")


# --- albums ---

STEPS = f"(SELECT DISTINCT folder_path, i, array_to_string(list_slice(string_split(folder_path, '/'), 1, i), '/') AS title FROM (SELECT folder_path, unnest(range(1, 4)) AS i FROM {FOLDERS_SQL}))"


@query(f"SELECT DISTINCT title, CASE WHEN i = 1 THEN CASE WHEN title = 'ASIA' THEN 'All of it' ELSE 'old' END WHEN i = 3 AND title LIKE '%BUILDING' THEN 'd ' || title END AS description FROM {STEPS}")
def albums_created(spark, sf):
    f = views.folders(spark, sf).select("folder_path").distinct()
    old = f.select(F.split_part("folder_path", F.lit("/"), F.lit(1)).alias("title"), F.lit("old").alias("description")).distinct()
    wanted = f.select(F.concat(F.lit(" /"), F.replace("folder_path", F.lit("/"), F.lit("//")), F.lit("/ ")).alias("title"), F.when(F.col("folder_path").endswith("BUILDING"), F.concat(F.lit("d "), "folder_path")).alias("description"))
    asia = old.where("title = 'ASIA'").select("title", F.lit("All of it").alias("description"))
    return commits.albums_created(old, wanted.unionByName(asia).unionByName(old.limit(1).select(F.lit(" // ").alias("title"), "description")))


def _albums(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("album_id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))


def _members(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("album_id"), F.col("o_orderkey").alias("asset_id"))


def _deleted(spark, sf, with_media):
    gone = _albums(spark, sf).where("album_id % 4 = 1").select("album_id")
    left = commits.albums_deleted(_albums(spark, sf), _members(spark, sf), views.assets(spark, sf), gone, views.now(), with_media)
    none = F.lit(None).cast("timestamp_ntz").alias("deleted_at")
    rows = left["albums"].select(F.lit("album").alias("kind"), F.col("album_id").alias("id"), "deleted_at")
    rows = rows.unionByName(left["members"].select(F.lit("member").alias("kind"), F.col("asset_id").alias("id"), none))
    return rows.unionByName(left["assets"].select(F.lit("asset").alias("kind"), "id", "deleted_at"))


@query(f"""SELECT 'album' AS kind, c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN TIMESTAMP '{NOW}' END AS deleted_at FROM customer UNION ALL SELECT 'member', o_orderkey, NULL FROM orders
    UNION ALL SELECT 'asset', id, CASE WHEN user_id % 4 = 1 AND user_id IN (SELECT c_custkey FROM customer) THEN coalesce(deleted_at, TIMESTAMP '{NOW}') ELSE deleted_at END FROM {assets_sql()}""")
def albums_deleted_with_media(spark, sf):
    return _deleted(spark, sf, True)


@query(f"""SELECT 'album' AS kind, c_custkey AS id, CAST(NULL AS TIMESTAMP) AS deleted_at FROM customer WHERE c_custkey % 4 <> 1 UNION ALL
    SELECT 'member', o_orderkey, NULL FROM orders WHERE NOT (o_custkey % 4 = 1 AND o_custkey IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'asset', id, deleted_at FROM {assets_sql()}""")
def albums_deleted_only(spark, sf):
    return _deleted(spark, sf, False)


@query(f"SELECT split_part(folder_path, '/', 2) AS sub_name, min(id) AS album_id FROM {FOLDERS_SQL} WHERE folder_path LIKE 'ASIA/%' GROUP BY 1")
def sub_albums_of_path(spark, sf):
    a = views.folders(spark, sf).select(F.col("id").alias("album_id"), F.concat(F.lit("/"), "folder_path", F.lit("/")).alias("title"))
    return commits.sub_albums(a, "ASIA", "album_id").select("sub_name", "album_id")


@query("SELECT r_name AS sub_name, CAST(r_regionkey AS BIGINT) AS album_id FROM region")
def sub_albums_of_root(spark, sf):
    a = views.folders(spark, sf).select(F.col("id").alias("album_id"), F.col("folder_path").alias("title"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("album_id"), F.concat("r_name", F.lit("/")).alias("title"))
    return commits.sub_albums(a.unionByName(r), "", "album_id").select("sub_name", "album_id")


@query("""SELECT c_custkey AS album_id, CASE WHEN c_custkey % 3 = 0 THEN 'Renamed' ELSE c_name END AS title, CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE c_mktsegment END AS description, CAST(CASE WHEN c_custkey % 3 = 1 THEN 7 ELSE c_nationkey END AS BIGINT) AS cover_asset_id,
    c_phone AS cover_thumb, CAST(CASE WHEN c_custkey % 3 < 2 THEN greatest(c_nationkey - 10, 0) ELSE c_nationkey END AS BIGINT) AS media_count FROM customer""".replace("c_phone", "c_name"))
def album_patches(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    cols = [k.alias("album_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("description"), F.col("c_nationkey").cast("long").alias("cover_asset_id"), F.col("c_name").alias("cover_thumb"), F.col("c_nationkey").cast("long").alias("media_count")]
    new = [k.alias("album_id"), F.when(k % 3 == 0, "Renamed").alias("new_title"), F.when(k % 6 == 0, "new").alias("new_description"), F.when(k % 3 == 1, 7).cast("long").alias("new_cover"), F.lit(None).cast("string").alias("new_thumb"), F.lit(10).cast("long").alias("n_removed")]
    return commits.album_patches(c.select(*cols), c.where("c_custkey % 3 < 2").select(*new))


@query("SELECT user_id, round(sum(least(s, p / 80 * s)), 4) AS loaded, CAST(sum(s) AS BIGINT) AS size, CAST(max(least(100, round(p / 80 * 100))) AS INTEGER) AS most_percent FROM (SELECT user_id, event_id % 100 AS p, event_id * 7 % 1000 AS s FROM events) GROUP BY user_id")
def upload_progress(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 100).alias("part"), F.lit(80).alias("total_parts"), (F.col("event_id") * 7 % 1000).alias("size"))
    return commits.upload_progress(e, ["user_id"]).select("user_id", F.round("loaded", 4).alias("loaded"), "size", "most_percent")




@query(f"SELECT DISTINCT title, id AS asset_id FROM {FOLDERS_SQL} f JOIN {STEPS} s ON s.folder_path = f.folder_path")
def folder_members_linked(spark, sf):
    """The upsert into members: rows that are there stay, every ancestor's album gets the asset once."""
    f = views.folders(spark, sf)
    titles = folders.album_ancestors(f.select(F.col("folder_path").alias("title")))
    albums = titles.select("title", F.col("title").alias("album_id"))
    old = f.where("id % 3 = 0").select(F.split_part("folder_path", F.lit("/"), F.lit(1)).alias("album_id"), F.col("id").alias("asset_id"))
    out = mutations.linked_to_folders(old, albums, f)
    return out.select(F.col("album_id").alias("title"), "asset_id")


@query("SELECT c_custkey AS album_id FROM customer WHERE NOT (c_custkey % 3 = 0 AND (c_custkey % 2 = 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders)))")
def albums_after_collection(spark, sf):
    old = F.when(F.col("album_id") % 2 == 0, views.now() - F.expr("interval 40 days")).otherwise(views.now())
    a = _albums(spark, sf).withColumn("deleted_at", F.when(F.col("album_id") % 3 == 0, old))
    return mutations.albums_collected(a, _members(spark, sf), views.now()).select("album_id")


TITLES = "CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN upper(c_mktsegment) ELSE c_mktsegment || ' ' || c_custkey % 7 END"


@query(f"SELECT id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(title), title, id) AS INTEGER) AS place FROM (SELECT c_custkey AS id, c_nationkey, {TITLES} AS title FROM customer)")
def albums_by_name(spark, sf):
    """The place of each album in its nation by name, whatever its case, which decides between equal names."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.expr(TITLES).alias("title"))
    return c.select("id", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*folders.name_order("title"), "id")).alias("place"))


@query("""SELECT o_orderkey AS id, '?sort=' || CASE WHEN o_orderkey % 2 = 0 THEN 'random&seed=' || o_orderkey ELSE 'date' END || CASE WHEN o_orderstatus <> 'F' THEN '&camera_model=' || o_orderstatus ELSE '' END || '&city=' || replace(url_encode(o_orderpriority), '%20', '+') AS q FROM orders""")
def filter_query_string(spark, sf):
    odd = F.col("o_orderkey") % 2 == 1
    params = {"sort": F.when(odd, "date").otherwise("random"), "seed": F.when(~odd, F.col("o_orderkey")), "album_id": F.lit(""), "camera_model": F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), "city": F.col("o_orderpriority")}
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), filters.query_string(params).alias("q"))


# --- commits of finished jobs ---

FOLDER = "lang || '/' || source"
AUTHOR = "CASE doc_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'Someone ' || lang END"


def published(spark, state, change):
    """The tables after a commit: both states are published, the second as made from the first."""
    store = snapshots.Snapshots(spark, f"{shared_dir(spark)}/library-{uuid.uuid4().hex}")
    store.commit(0, state)
    store.change(change)
    return store.tables()


@query(f"""SELECT 'asset' AS kind, doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE md5(text) END AS value FROM documents
    UNION ALL SELECT 'member', doc_id, lang FROM documents UNION ALL SELECT 'member', doc_id, {FOLDER} FROM documents
    UNION ALL SELECT 'tag', doc_id, lang || '=1.0' FROM documents UNION ALL SELECT 'tag', doc_id, 'h-' || lower(source) || '=1.0' FROM documents
    UNION ALL SELECT 'tag', doc_id, 'someone ' || lang || '=1.0' FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 'tag', doc_id, 'kept=0.5' FROM documents WHERE doc_id % 4 = 0
    UNION ALL SELECT 'item', doc_id, CASE WHEN doc_id % 2 = 0 THEN 'downloaded ' || doc_id ELSE 'pending ' END FROM documents""")
def base_commit(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    none = F.lit(None).cast("timestamp_ntz").alias("captured_at")
    jobs = d.select(i.alias("asset_id"), F.md5("text").alias("sha256"), F.expr(FOLDER).alias("folder_path"), none, F.array("lang", F.concat(F.lit(" H-"), F.upper("source"))).alias("hashtags"), F.expr(AUTHOR).alias("author"), F.when(i % 2 == 0, i).alias("item_id"))
    old = d.where("doc_id % 4 = 0")
    tags = old.select(i.alias("asset_id"), F.lit("kept").alias("name"), F.lit(0.5).alias("confidence")).unionByName(old.select(i.alias("asset_id"), F.col("lang").alias("name"), F.lit(0.5).alias("confidence")))
    state = {
        "assets": old.select(i.alias("asset_id"), F.lit("old").alias("sha256"), F.expr(FOLDER).alias("folder_path"), none),
        "members": old.select(F.col("lang").alias("title"), i.alias("asset_id")),
        "tags": tags,
        "items": d.select(i.alias("item_id"), F.lit("pending").alias("status"), F.lit(None).cast("long").alias("asset_id")),
    }
    new = published(spark, state, lambda now: commits.base_committed(now, jobs))
    rows = new["assets"].select(F.lit("asset").alias("kind"), F.col("asset_id").alias("id"), F.col("sha256").alias("value"))
    rows = rows.unionByName(new["members"].select(F.lit("member").alias("kind"), F.col("asset_id").alias("id"), F.col("title").alias("value")))
    rows = rows.unionByName(new["tags"].select(F.lit("tag").alias("kind"), F.col("asset_id").alias("id"), F.concat_ws("=", "name", F.col("confidence").cast("string")).alias("value")))
    item = F.concat(F.col("status"), F.lit(" "), F.coalesce(F.col("asset_id").cast("string"), F.lit("")))
    return rows.unionByName(new["items"].select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), item.alias("value")))


THERE = "vec_id % 3 <> 0"
FACES_AFTER = f"""(SELECT vec_id AS face_id, label AS person_id FROM embeddings WHERE vec_id % 10 = 0 UNION ALL SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label END FROM embeddings WHERE vec_id % 5 = 1 AND {THERE})"""


@query(f"""SELECT 'asset' AS kind, vec_id AS id, CAST(vec_id % 7 <> 0 AS VARCHAR) || ' ' || CAST(vec_id % 5 < 2 AS VARCHAR) || ' ' || CAST(vec_id % 6 IN (1, 2) AS VARCHAR) AS value FROM embeddings WHERE {THERE}
    UNION ALL SELECT 'person', label, CASE WHEN label % 4 = 0 THEN '99 2.0' WHEN label % 2 = 0 THEN '10 0.0' ELSE '1 1.0' END || ' ' || coalesce(CAST(c AS VARCHAR), '') FROM (SELECT label, CASE WHEN max(vec_id) IN (SELECT face_id FROM {FACES_AFTER}) THEN max(vec_id) END AS c FROM embeddings GROUP BY label)
    UNION ALL SELECT 'face', face_id, coalesce(CAST(person_id AS VARCHAR), '') FROM {FACES_AFTER}
    UNION ALL SELECT 'pose', vec_id, CAST(vec_id * 10 AS VARCHAR) FROM embeddings WHERE vec_id % 4 = 0 AND NOT (vec_id % 8 = 0 AND {THERE}) UNION ALL SELECT 'pose', vec_id, CAST(vec_id * 10 + 1 AS VARCHAR) FROM embeddings WHERE vec_id % 8 = 0 AND {THERE}
    UNION ALL SELECT 'tag', vec_id, 't' || label || CASE WHEN vec_id % 6 = 1 THEN CASE WHEN {THERE} AND vec_id % 2 = 1 THEN '=0.75' ELSE '=0.5' END ELSE '=0.25' END FROM embeddings WHERE vec_id % 6 = 1 OR (vec_id % 6 = 2 AND {THERE})""")
def enrichment_commit(spark, sf):
    e, i, lab = table(spark, sf, "embeddings"), F.col("vec_id"), F.col("label")
    asset, no = i.alias("asset_id"), F.lit(False)
    one = lambda x: F.array(F.lit(float(x))).alias("centroid")
    people = e.groupBy(lab.alias("person_id")).agg(F.max(i).alias("cover_face_id"))
    tag = lambda c: [asset, F.concat(F.lit("t"), lab).alias("name"), c.alias("confidence")]
    state = {
        "assets": e.where(THERE).select(asset, no.alias("clip_processed"), (i % 5 == 0).alias("face_processed"), no.alias("tags_processed")),
        "persons": people.where("person_id % 2 = 0").select("person_id", F.lit(10).cast("long").alias("face_count"), one(0), F.lit(None).cast("long").alias("cover_face_id")),
        "faces": e.where("vec_id % 10 = 0").select(i.alias("face_id"), asset, lab.alias("person_id"), F.lit(0.5).alias("score")),
        "poses": e.where("vec_id % 4 = 0").select(asset, (i * 10).alias("pose_id"), F.lit(0.1).alias("score")),
        "tags": e.where("vec_id % 6 = 1").select(*tag(F.lit(0.5))),
    }
    found = {
        "vectors": e.select(asset, F.when(i % 7 != 0, F.col("embedding")).alias("embedding")),
        "persons": people.select("person_id", one(1), "cover_face_id"),
        "clusters": people.where("person_id % 4 = 0").select("person_id", one(2), F.lit(99).alias("face_count")),
        "faces": e.where("vec_id % 5 = 1").select(i.alias("face_id"), asset, (lab + i % 2 * 1000000).alias("person_id"), F.lit(0.9).alias("score")),
        "poses": e.where("vec_id % 8 = 0").select(asset, (i * 10 + 1).alias("pose_id"), F.lit(0.2).alias("score")),
        "tags": e.where("vec_id % 6 in (1, 2)").select(*tag(F.lit(0.25) + i % 2 * 0.5)),
    }
    new = published(spark, state, lambda now: commits.enrichment_committed(now, found))
    text = lambda *c: F.concat_ws(" ", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c]).alias("value")
    rows = new["assets"].select(F.lit("asset").alias("kind"), F.col("asset_id").alias("id"), text("clip_processed", "face_processed", "tags_processed"))
    persons = new["persons"].withColumn("c", F.get("centroid", F.lit(0)))
    rows = rows.unionByName(persons.select(F.lit("person").alias("kind"), F.col("person_id").alias("id"), text("face_count", "c", "cover_face_id")))
    rows = rows.unionByName(new["faces"].select(F.lit("face").alias("kind"), F.col("face_id").alias("id"), text("person_id")))
    rows = rows.unionByName(new["poses"].select(F.lit("pose").alias("kind"), F.col("asset_id").alias("id"), text("pose_id")))
    return rows.unionByName(new["tags"].select(F.lit("tag").alias("kind"), F.col("asset_id").alias("id"), F.concat_ws("=", "name", F.col("confidence").cast("string")).alias("value")))


# --- clips ---


@query()
def cluster_video(spark, sf):
    """Faces of clips: frames of two faces each, clips of ten frames, known persons from the labels."""
    e = table(spark, sf, "embeddings")
    faces = e.select(F.floor(F.col("vec_id") / 20).alias("clip"), F.floor(F.col("vec_id") % 20 / 2).alias("frame"), "vec_id", "embedding", (F.col("vec_id") * 7919 % 1000 / 1000).alias("score"))
    return vectors.cluster_clips(faces, vectors.centroids(e, "label", "embedding"), "clip", "frame", "vec_id", "embedding", "label", seen=0.4, match=0.3)


# --- upserts of scraped posts, jobs, ledgers and users ---


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'new ' || role ELSE 'old' END AS caption, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 <> 0 THEN 'fresh' ELSE 'kept' END AS first_seen FROM conversations WHERE turn = 0 AND (conv_id % 2 = 0 OR conv_id % 3 = 0)""")
def scraped_posts_upserted(spark, sf):
    """Posts scraped again get a new caption; when they were first seen stays; unknown ones come in."""
    c = table(spark, sf, "conversations").where("turn = 0")
    old = c.where("conv_id % 2 = 0").select("conv_id", F.lit("old").alias("caption"), F.lit("kept").alias("first_seen"))
    new = c.where("conv_id % 3 = 0").select("conv_id", F.concat(F.lit("new "), "role").alias("caption"), F.lit("fresh").alias("first_seen"))
    return mutations.upserted(old, new, ["conv_id"], {"caption": F.col("n.caption")})


@query("SELECT url, min(CASE WHEN page_id % 2 = 0 THEN 'old' ELSE 'new' END) AS found FROM (SELECT page_id % 40 AS k, 'https://x.org/' || (page_id % 40) AS url, page_id FROM pages) GROUP BY url".replace("min(CASE WHEN page_id % 2 = 0 THEN 'old' ELSE 'new' END)", "CASE WHEN bool_or(page_id % 2 = 0) THEN 'old' ELSE 'new' END"))
def discovered_links_kept(spark, sf):
    """Links found again stay as they are."""
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://x.org/"), F.col("page_id") % 40).alias("url"))
    old = p.where("page_id % 2 = 0").select("url", F.lit("old").alias("found")).distinct()
    return mutations.inserted(old, p.where("page_id % 2 <> 0").select("url", F.lit("new").alias("found")), ["url"])


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'new/' || user_id ELSE 'old' END AS disk_path, CASE WHEN event_id % 3 = 0 THEN props ELSE '{}' END AS payload, CASE WHEN event_id % 3 = 0 THEN 'pending' ELSE 'failed' END AS status,
    CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS attempts FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0""")
def jobs_enqueued_again(spark, sf):
    """A job that is enqueued again gets path, payload and status; its attempts stay."""
    e = table(spark, sf, "events")
    old = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.lit("old").alias("disk_path"), F.lit("{}").alias("payload"), F.lit("failed").alias("status"), F.lit(2).alias("attempts"))
    new = e.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.concat(F.lit("new/"), "user_id").alias("disk_path"), F.col("props").alias("payload"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return mutations.upserted(old, new, ["id"], {c: F.col(f"n.{c}") for c in ("disk_path", "payload", "status")})


@query("SELECT doc_id AS asset_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE 'old' END AS synced_sha256, CASE WHEN doc_id % 3 = 0 THEN 'r/' || lang ELSE 'r/old' END AS remote_path FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 7 <> 0")
def ledger_synced(spark, sf):
    """The mirror's ledger after files were synced and others were deleted there."""
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("asset_id"), F.lit("old").alias("synced_sha256"), F.lit("r/old").alias("remote_path"))
    new = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("asset_id"), F.md5("text").alias("synced_sha256"), F.concat(F.lit("r/"), "lang").alias("remote_path"))
    gone = d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("asset_id"))
    return mutations.upserted(old, new, ["asset_id"]).join(gone, "asset_id", "left_anti")


@query("SELECT c_custkey AS id, c_name AS username FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier WHERE lower(replace(s_name, 'Supplier', 'Customer')) NOT IN (SELECT lower(c_name) FROM customer) OR s_suppkey % 2 = 0")
def users_created(spark, sf):
    """New users come in unless their name is taken, whatever its case."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), name.alias("username"), F.lower(name).alias("_name"))
    return mutations.inserted(old.withColumn("_name", F.lower("username")), new, ["_name"]).select("id", "username")


@query("SELECT l_orderkey AS asset_id, count(*) AS n, count(*) FILTER (WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)) AS with_person FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0) GROUP BY 1")
def deletes_cascaded(spark, sf):
    """Rows of deleted assets go, references to deleted persons become null."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_suppkey").alias("person_id"))
    assets = table(spark, sf, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("asset_id"))
    kept = mutations.valid_references(lines.join(assets, "asset_id", "left_semi"), "person_id", table(spark, sf, "supplier").where("s_suppkey % 4 <> 0"), "s_suppkey")
    return kept.groupBy("asset_id").agg(F.count("*").alias("n"), F.count("person_id").alias("with_person"))


# --- expressions and decoders over whole tables ---


@query(f"SELECT id FROM {assets_sql()} WHERE deleted_at IS NULL AND user_id = 100 AND duration_seconds IS NULL")
def filter_tenant(spark, sf):
    """The live photos of one user."""
    return filters.apply_filters(views.assets(spark, sf), filters.FeedRequest(user_id=100, media_type="photos", trash=bool(filters.lenient_bool("0")))).select("id")


@query(f"SELECT id FROM {assets_sql()} WHERE deleted_at IS NULL AND id IN (SELECT asset_id FROM {ASSET_TAGS_SQL} WHERE lower(name) IN ('brand#1', 'brand#2') GROUP BY asset_id HAVING count(DISTINCT lower(name)) = 2)")
def filter_tags_of_a_list(spark, sf):
    """Tags as a parameter gives them: with blanks, in any case, with an empty one."""
    tags = views.asset_tags(spark, sf).withColumn("name", F.lower("name"))
    req = filters.FeedRequest(tags=filters.csv_names(" Brand#1, ,BRAND#2,"))
    return filters.apply_filters(views.assets(spark, sf), req, tags=tags).select("id")


VECTORS = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"""SELECT vec_id, round(CASE WHEN vec_id % 5 < 2 THEN 0.0 ELSE list_dot_product(v, list_reverse(v)) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(list_reverse(v), list_reverse(v)))) END, 6) AS similarity FROM {VECTORS}""")
def cosine_of_any_lengths(spark, sf):
    """Vectors with their mirror image, with one of another length, and with none."""
    v, i = F.col("embedding"), F.col("vec_id") % 5
    other = F.when(i == 0, F.slice(v, 1, F.size(v) - 1)).when(i == 1, F.slice(v, 1, 0)).otherwise(F.reverse(v))
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.cosine(v, other), 6).alias("similarity"))


@query(f"SELECT vec_id, pos, round(x / sqrt(list_dot_product(u, u)), 6) AS x FROM (SELECT vec_id, u, unnest(u) AS x, unnest(range(len(u))) AS pos FROM (SELECT vec_id, list_transform(list_zip(v, list_reverse(v)), lambda p: p[1] * (vec_id % 10 + 1) + p[2]) AS u FROM {VECTORS}))")
def centroids_moved(spark, sf):
    """A centroid of some vectors after one more."""
    moved = vectors.moved_centroid(F.col("embedding"), F.col("vec_id") % 10 + 1, F.reverse("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(moved).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""WITH t AS (SELECT vec_id, list_transform(v, lambda x: abs(x) * 3) AS scores, list_transform(range(256), lambda j: abs(v[CAST(j % 64 + 1 AS INTEGER)]) * 40) AS boxes, 0.5 + vec_id % 3 * 0.25 AS scale FROM {VECTORS}),
    c AS (SELECT vec_id, scale, boxes, unnest(scores) AS score, unnest(range(64)) AS cell FROM t),
    b AS (SELECT vec_id, cell, score, (cell // 2 % 8 * 8 - boxes[cell * 4 + 1] * 8 - 4) / scale AS x1, (cell // 2 // 8 * 8 - boxes[cell * 4 + 2] * 8 - 2) / scale AS y1, (cell // 2 % 8 * 8 + boxes[cell * 4 + 3] * 8 - 4) / scale AS x2, (cell // 2 // 8 * 8 + boxes[cell * 4 + 4] * 8 - 2) / scale AS y2 FROM c WHERE score >= 0.6)
    SELECT vec_id, CAST(cell AS INTEGER) AS cell, round(score, 6) AS score, round(least(greatest(x1 / 640, 0), 1), 6) AS x, round(least(greatest(y1 / 480, 0), 1), 6) AS y, round((x2 - x1) / 640, 6) AS w, round((y2 - y1) / 480, 6) AS h FROM b WHERE x2 - x1 >= 12 AND y2 - y1 >= 12""")
def anchors_decoded(spark, sf):
    """Boxes of a detector's output level of 8 x 4 spots with two anchors, made from each vector's entries."""
    v = vectors.doubles(F.col("embedding"))
    boxes = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda j: F.abs(F.get(v, j % 64)) * 40)
    sizes = [F.lit(float(x)).alias(n) for x, n in ((4, "pad_x"), (2, "pad_y"), (640, "img_w"), (480, "img_h"))]
    tensors = table(spark, sf, "embeddings").select("vec_id", F.transform(v, lambda x: F.abs(x) * 3).alias("scores"), boxes.alias("boxes"), (F.col("vec_id") % 3 * 0.25 + 0.5).alias("scale"), *sizes)
    out = detect.decoded_anchors(tensors, "vec_id", 8, 8, 0.6)
    return out.select("vec_id", "cell", *[F.round(c, 6).alias(c) for c in ("score", "x", "y", "w", "h")])


@query(f"""WITH p AS (SELECT vec_id, v[i * 4 + 1] AS x, v[i * 4 + 2] AS y, v[i * 4 + 3] AS u, v[i * 4 + 4] AS w FROM (SELECT vec_id, v, CAST(unnest(range(5)) AS INTEGER) AS i FROM {VECTORS})),
    m AS (SELECT *, x - avg(x) OVER q AS dx, y - avg(y) OVER q AS dy, u - avg(u) OVER q AS du, w - avg(w) OVER q AS dw FROM p WINDOW q AS (PARTITION BY vec_id)),
    s AS (SELECT vec_id, sum(dx * du + dy * dw) / sum(dx * dx + dy * dy) AS a, sum(dx * dw - dy * du) / sum(dx * dx + dy * dy) AS b, avg(x) AS x, avg(y) AS y, avg(u) AS u, avg(w) AS w FROM m GROUP BY vec_id)
    SELECT vec_id, round(a, 6) AS a, round(b, 6) AS b, round(u - a * x + b * y, 6) AS tx, round(w - b * x - a * y, 6) AS ty FROM s""")
def faces_aligned(spark, sf):
    """The similarity that takes five points to five others, in each vector's entries."""
    at = lambda k: F.get(vectors.doubles(F.col("embedding")), F.col("i") * 4 + k)
    points = table(spark, sf, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("vec_id", *[at(k).alias(c) for k, c in enumerate("xyuv")])
    return detect.similarity_transform(points, ["vec_id"]).select("vec_id", *[F.round(c, 6).alias(c) for c in ("a", "b", "tx", "ty")])


@query("SELECT p_partkey || ' ' || p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_size AS INTEGER) END AS category FROM part WHERE p_partkey % 7 <> 0")
def vocabulary_read(spark, sf):
    """A vocabulary written as CSV: some rows are short, some categories no numbers."""
    path = f"{shared_dir(spark)}/vocabulary-{uuid.uuid4().hex}"
    key = F.col("p_partkey")
    name = F.replace(F.concat_ws("_", key.cast("string"), "p_name"), F.lit(" "), F.lit("_"))
    line = F.concat_ws(",", name, F.when(key % 3 == 0, "none").otherwise(F.col("p_size").cast("string")), F.when(key % 7 != 0, "12"))
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return uploads.vocabulary(spark, path)
