"""Queries of vectors, folders, albums, people, tags, posts, backups and text search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.functions.text import words
from tessera.operators import ann, detect, folders, items, jobs, mutations, name_index, people, search, text_index, vectors
from tessera.plans import views
from tessera.plans.views import ASSET_TAGS_SQL, FACES_SQL, FOLDERS_SQL, PERSONS_SQL, assets_sql
from tessera.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- vectors ---

EMB = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
DOT = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query(f"SELECT vec_id, round(s, 4) AS similarity FROM (SELECT e.vec_id, {DOT.format(a='e.v', b='t.v')} AS s FROM {EMB} e, {EMB} t WHERE t.vec_id = 0 AND e.vec_id <> 0) WHERE s >= 0.24 ORDER BY s DESC, vec_id LIMIT 12")
def similar_by_id(spark, sf):
    out = vectors.similar_to_id(table(spark, sf, "embeddings"), 0, "vec_id", "embedding", least=0.24)
    return out.select("vec_id", F.round("similarity", 4).alias("similarity"))


@query(f"SELECT vec_id, round(s, 4) AS similarity FROM (SELECT vec_id, {DOT.format(a='v', b='q')} AS s FROM {EMB}, (SELECT list_transform(range(64), lambda i: CAST(CASE WHEN i % 3 = 0 THEN 1 ELSE -0.5 END AS DOUBLE)) AS q)) WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 200")
def search_by_vector(spark, sf):
    q = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
    return vectors.similar_to(table(spark, sf, "embeddings"), q, "vec_id", "embedding", 0.1, 200).select("vec_id", F.round("similarity", 4).alias("similarity"))


PAIRS = f"(SELECT q.vec_id AS query_id, e.vec_id, {DOT.format(a='e.v', b='q.v')} AS s FROM {EMB} e, {EMB} q WHERE q.vec_id % 100 = 0)"


@query(f"SELECT query_id, vec_id, round(s, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM {PAIRS} WHERE s >= 0.24) WHERE r <= 50")
def search_by_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.similar_to_each(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.24, 50).select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


@query()
def search_by_vector_index(spark, sf):
    e = table(spark, sf, "embeddings")
    index, asked = ann.build(e, "vec_id", "embedding"), e.where("vec_id % 100 = 0")
    breadth = ann.fitted_breadth(e, index, asked.orderBy("vec_id").limit(64), 12, 0.24)
    return ann.search(index, asked, 12, 0.24, breadth)


MEANS = f"(SELECT label, pos, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM {EMB}) GROUP BY label, pos)"
CENTS = f"(SELECT label, max(n) AS n, list(x / greatest(nrm, 1e-6) ORDER BY pos) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS nrm FROM {MEANS}) GROUP BY label)"


@query(f"SELECT label, n, pos, round(x, 6) AS x FROM (SELECT label, n, unnest(c) AS x, unnest(range(len(c))) AS pos FROM {CENTS})")
def centroids(spark, sf):
    out = vectors.centroids(table(spark, sf, "embeddings"), "label", "embedding").select("label", "n", F.posexplode("centroid").alias("pos", "x"))
    return out.select("label", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"SELECT label, arg_max(vec_id, (s, -vec_id)) AS cover_id, max(s) AS similarity FROM (SELECT e.label, vec_id, round(list_dot_product(v, c), 9) AS s FROM {EMB} e JOIN {CENTS} k USING (label)) GROUP BY label".replace("max(s) AS", "round(max(s), 6) AS"))
def cluster_cover(spark, sf):
    e = table(spark, sf, "embeddings")
    out = vectors.covers(e, vectors.centroids(e, "label", "embedding"), "label", "vec_id", "embedding")
    return out.select("label", "cover_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT label, vec_id, rank FROM (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id % 3 = 0 DESC, embedding[1] DESC, vec_id) AS INTEGER) AS rank FROM embeddings) WHERE rank <= 5")
def exemplars_top5(spark, sf):
    order = [(F.col("vec_id") % 3 == 0).desc(), F.get("embedding", F.lit(0)).desc(), F.col("vec_id")]
    return vectors.exemplars(table(spark, sf, "embeddings"), "label", order).select("label", "vec_id", "rank")


@query(f"SELECT vec_id, arg_max(label, (s, -label)) AS label, round(max(s), 4) AS similarity FROM (SELECT vec_id, k.label, round(list_dot_product(v, c), 9) AS s FROM {EMB} e, {CENTS} k) WHERE s >= 0.3 GROUP BY vec_id")
def cluster_assign(spark, sf):
    e = table(spark, sf, "embeddings")
    out = vectors.assigned(e, vectors.centroids(e, "label", "embedding"), "label", "vec_id", "embedding", 0.3)
    return out.select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


@query(f"SELECT grp, pos, round(x, 6) AS x FROM (SELECT vec_id // 10 AS grp, pos, avg(x) AS x FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM {EMB}) GROUP BY 1, 2)")
def pool_mean_embedding(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("grp", F.floor(F.col("vec_id") / 10))
    out = vectors.mean_vectors(e, ["grp"], "embedding").select("grp", F.posexplode("mean").alias("pos", "x"))
    return out.select("grp", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * 3 / (3 * sqrt(list_dot_product(v, v))))), 6) AS total FROM {EMB}")
def normalize_l2(spark, sf):
    tripled = F.transform(vectors.doubles(F.col("embedding")), lambda x: x * 3)
    total = F.aggregate(vectors.normalized(tripled), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(total, 6).alias("total"))


@query(f"SELECT vec_id, round(list_sum(list_transform(u, lambda x: x / sqrt(list_dot_product(u, u)))), 6) AS total FROM (SELECT vec_id, list_transform(list_zip(v, list_reverse(v)), lambda p: p[1] + p[2]) AS u FROM {EMB})")
def two_view_embedding(spark, sf):
    both = vectors.normalized(vectors.added(F.col("embedding"), F.reverse("embedding")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query()
def cluster_online(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("user_id", F.floor(F.col("vec_id") / 400))
    return vectors.cluster_online(e, "user_id", ["vec_id"], "vec_id", "embedding", match=0.3, diverse=0.5)


# --- folders and albums ---

CHILD = "SELECT name, {full} AS full_path, count(*) AS media_count, arg_max(thumb_path, (score, id)) AS cover_thumb FROM (SELECT *, split_part(folder_path, '/', {n}) AS name FROM " + FOLDERS_SQL + "{where}) WHERE name <> '' GROUP BY name"


@query(CHILD.format(full="name", n=1, where=" WHERE folder_path NOT IN ('', 'root')"))
def folder_children_root(spark, sf):
    return folders.children(views.folders(spark, sf), "", F.struct("score", "id"))


@query(CHILD.format(full="'ASIA/' || name", n=2, where=" WHERE folder_path LIKE 'ASIA/%'"))
def folder_children_path(spark, sf):
    return folders.children(views.folders(spark, sf), " /ASIA/ ", F.struct("score", "id"))


PATHS = f"(SELECT DISTINCT array_to_string(list_slice(string_split(folder_path, '/'), 1, i), '/') AS path FROM (SELECT DISTINCT folder_path, unnest(range(1, 4)) AS i FROM {FOLDERS_SQL}))"


@query(f"SELECT path FROM {PATHS} WHERE contains(lower(path), 'nation_1')")
def folder_suggestions(spark, sf):
    f = views.folders(spark, sf).select("folder_path")
    return folders.suggestions(f, f.where("folder_path like 'ASIA%'"), "Nation_1")


@query(f"SELECT path FROM {PATHS}")
def folder_prefix_expand(spark, sf):
    return views.folders(spark, sf).select(F.explode(paths.prefixes(F.col("folder_path"))).alias("path")).distinct()


@query(f"SELECT id, string_agg(name || '=' || path, ',' ORDER BY i) AS crumbs FROM (SELECT id, i, split_part(folder_path, '/', i) AS name, array_to_string(list_slice(string_split(folder_path, '/'), 1, i), '/') AS path FROM (SELECT id, folder_path, unnest(range(1, 4)) AS i FROM {FOLDERS_SQL})) GROUP BY id")
def breadcrumbs(spark, sf):
    crumbs = F.transform(paths.breadcrumbs(F.concat(F.lit("/"), "folder_path", F.lit("/"))), lambda c: F.concat(c["name"], F.lit("="), c["path"]))
    return views.folders(spark, sf).select("id", F.array_join(crumbs, ",").alias("crumbs"))


@query(f"""SELECT parent, name, count(*) FILTER (WHERE i < 3) AS descendants FROM (SELECT i, split_part(folder_path, '/', i) AS name, coalesce(array_to_string(list_slice(string_split(folder_path, '/'), 1, i - 1), '/'), '') AS parent
    FROM (SELECT folder_path, CAST(unnest(range(1, 4)) AS INTEGER) AS i FROM {FOLDERS_SQL})) GROUP BY parent, name""")
def folder_direct_children_counts(spark, sf):
    return folders.direct_children(views.folders(spark, sf), "folder_path")


@query(f"SELECT id, CASE WHEN len(p) > 0 THEN array_to_string(p, '/') ELSE 'root' END AS folder FROM (SELECT id, list_filter(list_transform(string_split(folder_path || '/ .. // x ', '/'), lambda s: trim(s)), lambda s: s <> '' AND s <> '..') AS p FROM {FOLDERS_SQL})")
def sanitize_folder(spark, sf):
    return views.folders(spark, sf).select("id", paths.sanitized(F.concat(F.lit("/"), "folder_path", F.lit("/ .. // x "))).alias("folder"))


ALBUMS = "(SELECT c_custkey AS album_id, c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 10 + 1 END AS cover_asset_id FROM customer)"
LIVE = f"(SELECT * FROM {assets_sql()} WHERE deleted_at IS NULL)"
ALBUM_LIST = f"""SELECT album_id, title, coalesce(n, 0) AS asset_count, coalesce(c.thumb_path, t) AS cover_thumb FROM {ALBUMS} a LEFT JOIN (SELECT user_id, count(*) AS n, arg_max(thumb_path, (captured_at, id)) AS t FROM {LIVE} GROUP BY user_id) s
    ON user_id = album_id LEFT JOIN {LIVE} c ON c.id = cover_asset_id"""


def _albums(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(key.alias("album_id"), F.col("c_name").alias("title"), F.when(key % 4 == 0, key * 10 + 1).alias("cover_asset_id"))


def _album_list(spark, sf):
    live = views.assets(spark, sf).where("deleted_at is null")
    return folders.albums_with_covers(_albums(spark, sf), live.select(F.col("user_id").alias("album_id"), F.col("id").alias("asset_id")), live.select("id", "thumb_path", "captured_at"))


@query(ALBUM_LIST)
def album_list(spark, sf):
    return _album_list(spark, sf)


@query(ALBUM_LIST + " WHERE album_id = 100")
def album_detail(spark, sf):
    return _album_list(spark, sf).where("album_id = 100")


@query(f"SELECT album_id FROM {ALBUMS} WHERE album_id % 3 = 0 AND (album_id NOT IN (SELECT user_id FROM {LIVE} WHERE id % 5 = 0) OR album_id % 2 = 0)")
def albums_gc(spark, sf):
    old = F.when(F.col("album_id") % 2 == 0, views.now() - F.expr("interval 40 days")).otherwise(views.now())
    a = _albums(spark, sf).withColumn("deleted_at", F.when(F.col("album_id") % 3 == 0, old))
    members = views.assets(spark, sf).where("deleted_at is null and id % 5 = 0").select(F.col("user_id").alias("album_id"))
    return folders.uncollected(a, members, views.now()).select("album_id")


@query("SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS has_urgent FROM customer")
def exists_flag(spark, sf):
    keys = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(keys, "id", "left").select("id", F.col("hit").isNotNull().alias("has_urgent"))


# --- people and tags ---

OVERVIEW = f"SELECT person_id, any_value(name) AS name, count(*) AS face_count, arg_max(face_id, (score, face_id)) AS cover_face_id FROM {PERSONS_SQL} JOIN {FACES_SQL} USING (person_id) WHERE NOT is_hidden"


@query(OVERVIEW + " GROUP BY person_id")
def people_overview(spark, sf):
    return people.overview(views.persons(spark, sf), views.faces(spark, sf))


@query(OVERVIEW + f" AND asset_id IN (SELECT id FROM {LIVE}) GROUP BY person_id")
def people_overview_album(spark, sf):
    live = views.assets(spark, sf).where("deleted_at is null")
    return people.overview(views.persons(spark, sf), views.faces(spark, sf), live)


@query(f"SELECT face_id, f.person_id, name, bbox_x FROM {FACES_SQL} f LEFT JOIN {PERSONS_SQL} p ON p.person_id = f.person_id WHERE asset_id = 7 ORDER BY bbox_x, face_id")
def faces_by_asset(spark, sf):
    return people.faces_of(views.faces(spark, sf), views.persons(spark, sf), 7).select("face_id", "person_id", "name", "bbox_x")


@query(f"SELECT person_id, name FROM {PERSONS_SQL} WHERE trim(name) <> '' AND NOT is_hidden")
def name_directory(spark, sf):
    return people.directory(views.persons(spark, sf)).select("person_id", "name")


@query(f"SELECT name, confidence FROM {ASSET_TAGS_SQL} WHERE asset_id = 7")
def tags_by_asset(spark, sf):
    tags = views.asset_tags(spark, sf).select("asset_id", F.col("name").alias("tag_id"), "confidence")
    names = table(spark, sf, "part").select(F.col("p_brand").alias("tag_id"), F.col("p_brand").alias("name"), F.lit(0).alias("category")).distinct()
    return people.tags_of(tags, names, 7).select("name", "confidence")


@query("""SELECT l_orderkey AS asset_id, lower(trim(p_type)) AS name, max(l_discount) AS confidence, arg_max(p_brand, (l_discount, -(l_partkey * 1000000 + l_suppkey * 100 + l_linenumber), -l_quantity)) AS brand
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def tag_dedup_max(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    pos = F.struct((F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("a"), F.col("l_quantity").alias("b"))
    rows = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("asset_id"), F.concat(F.lit(" "), F.upper("p_type")).alias("name"), F.col("l_discount").alias("confidence"), F.col("p_brand").alias("brand"), pos.alias("p"))
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy("asset_id").orderBy("p")))
    return people.deduplicated_tags(ranked, ["asset_id"], carry=("brand",))


@query(f"SELECT p_brand AS name, count(*) + CASE WHEN p_brand < 'Brand#30' THEN 1 ELSE 0 END AS usage_count FROM part WHERE p_brand > 'Brand#20' GROUP BY p_brand UNION ALL SELECT DISTINCT p_brand, CAST(1 AS BIGINT) FROM part WHERE p_brand <= 'Brand#20'")
def tag_upsert(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("name"))
    row = [F.lit(0).alias("category"), F.lit("model").alias("source")]
    old = p.where("name > 'Brand#20'").groupBy("name").agg(F.count("*").alias("usage_count")).select("name", "usage_count", *row)
    new = p.where("name < 'Brand#30'").distinct().select("name", *row)
    return mutations.tags_upserted(old, new).select("name", "usage_count")


@query(f"SELECT asset_id, name, max(confidence) AS confidence FROM {ASSET_TAGS_SQL} GROUP BY ALL")
def tag_link_upsert(spark, sf):
    t = views.asset_tags(spark, sf)
    low = t.where("asset_id % 2 = 0").withColumn("confidence", F.col("confidence") / 2)
    return mutations.links_upserted(low, t, ["asset_id", "name"])


@query("SELECT l_orderkey // 10 AS clip, p_brand AS name, max(l_discount) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def tag_pool_frames(spark, sf):
    return people.pooled_tags(views.asset_tags(spark, sf).withColumn("clip", F.floor(F.col("asset_id") / 10)), ["clip"])


# --- posts and items ---


@query("SELECT conv_id, turn, n, coalesce(urls, '') AS urls FROM (SELECT conv_id, turn FROM conversations) LEFT JOIN (SELECT conv_id, turn, count(*) AS k, string_agg(w, ',' ORDER BY -len(w), w) AS urls FROM (SELECT conv_id, turn, unnest(list_slice(string_split(text, ' '), 1, 3)) AS w FROM conversations WHERE turn % 2 = 0) GROUP BY ALL) USING (conv_id, turn), (SELECT 1) t(n)".replace(", n,", ",").replace(", (SELECT 1) t(n)", ""))
def post_items_with_variants(spark, sf):
    c = table(spark, sf, "conversations").withColumn("item_id", F.concat_ws("-", "conv_id", "turn"))
    words = c.where("turn % 2 = 0").select("item_id", F.explode(F.slice(F.split("text", " "), 1, 3)).alias("url"))
    v = words.select("item_id", "url", F.char_length("url").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("label"))
    out = items.with_variants(c.select("item_id", "conv_id", "turn"), v, "item_id")
    return out.select("conv_id", "turn", F.array_join(F.transform("variants", lambda x: x["url"]), ",").alias("urls"))


@query("SELECT c.conv_id, c.turn, coalesce(CASE WHEN c.turn % 3 = 0 THEN c.role END, p.role) AS caption FROM conversations c LEFT JOIN (SELECT conv_id, role FROM conversations WHERE turn = 1) p USING (conv_id)")
def item_context_coalesce(spark, sf):
    c = table(spark, sf, "conversations")
    own = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("caption"))
    return items.inherited(own, c.where("turn = 1").select("conv_id", F.col("role").alias("caption")), "conv_id", ["caption"])


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS item_index, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations")
def item_index_total(spark, sf):
    return items.indexed(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn")


# --- backups and duplicates ---

SHA = "(SELECT doc_id AS id, sha256(text) AS sha256 FROM documents)"


def _shas(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))


@query(f"SELECT id, sha256, false AS is_deleted FROM {SHA} WHERE id % 6 <> 5 AND NOT (id % 2 = 0 AND id % 8 <> 0)")
def backup_pending(spark, sf):
    a = _shas(spark, sf).withColumn("deleted_at", F.when(F.col("id") % 6 == 5, views.now()))
    ledger = _shas(spark, sf).where("id % 2 = 0").select(F.col("id").alias("asset_id"), F.when(F.col("id") % 8 == 0, "old").otherwise(F.col("sha256")).alias("synced_sha256"))
    return mutations.backup_pending(a, ledger)


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def backup_orphans(spark, sf):
    ledger = _shas(spark, sf).where("id % 5 = 0").select(F.col("id").alias("asset_id"), F.col("sha256").alias("synced_sha256"))
    a = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("").alias("sha256"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return mutations.backup_pending(a, ledger).where("is_deleted").select("id")


@query("SELECT p_partkey AS id, CASE WHEN n = 0 THEN p_name || '.jpg' ELSE p_name || '_' || n || '.jpg' END AS unique_path FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)")
def backup_collision_rename(spark, sf):
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".jpg")).alias("path"))
    return mutations.verified_paths(files, "path", "id").select("id", "unique_path")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dup_by_sha256(spark, sf):
    rows = _shas(spark, sf).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    return jobs.duplicates(rows, ["sha256"]).select("sha256", "n", "first_id")


@query("SELECT message, count(*) AS n FROM (SELECT CASE WHEN bool_and(doc_id % 3 = 0) THEN 'Already exists in trash' ELSE 'Already exists in library' END AS message FROM documents GROUP BY text HAVING count(*) > 1) GROUP BY message")
def dup_status_message(spark, sf):
    rows = _shas(spark, sf).withColumn("deleted_at", F.when(F.col("id") % 3 == 0, views.now()))
    return jobs.duplicates(rows, ["sha256"]).groupBy("message").agg(F.count("*").alias("n"))


# --- text search ---

_made: dict[tuple, object] = {}


def once(rows, make, *what):
    """An index of a table, made once in an application for the files that the table has now."""
    key = (rows.sparkSession.sparkContext.applicationId, tuple(sorted(rows.inputFiles())), what)
    if key not in _made:
        _made[key] = make(rows)
    return _made[key]


def documents_index(spark, sf, **fields):
    """The text index of documents."""
    return once(table(spark, sf, "documents"), lambda d: text_index.build(d, "doc_id", {c: F.col(name) for c, name in fields.items()}), *fields.items())


WHOLE = {"A": "source", "C": "text", "D": "lang"}
TOKENS = "(SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents)"


@query(f"SELECT doc_id FROM {TOKENS} WHERE list_contains(t, 'the') AND list_contains(t, 'with') AND list_contains(t, 'was')")
def fts_match_and(spark, sf):
    return text_index.search(spark, documents_index(spark, sf, A="text"), "The with, was")


@query(f"SELECT doc_id FROM {TOKENS} WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the and ') AND NOT list_contains(t, 'have')".replace("of the and", "in the"))
def fts_match_phrase(spark, sf):
    return text_index.search(spark, documents_index(spark, sf, A="text"), '"in the" -have')


@query(f"SELECT doc_id FROM {TOKENS} WHERE (list_contains(t, 'und') AND list_contains(t, 'von')) OR (list_contains(t, 'avec') AND NOT list_contains(t, 'dans'))")
def fts_match_or_not(spark, sf):
    return text_index.search(spark, documents_index(spark, sf, A="text"), "und von OR avec -dans")


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _rank(fields: dict[str, str], wanted: tuple[str, ...]) -> str:
    """The rank's SQL: weights of wanted words over the fields, over 1 + the number of words."""
    hit = " OR ".join(f"w = '{w}'" for w in wanted)
    score = " + ".join(f"len(list_filter({_words(x)}, lambda w: {hit})) * {search.WEIGHTS[c]}" for c, x in fields.items())
    return f"({score}) / (1 + {' + '.join(f'len({_words(x)})' for x in fields.values())})"


@query(f"SELECT doc_id, rank FROM (SELECT doc_id, round({_rank({'A': 'source', 'C': 'text', 'D': 'lang'}, ('the', 'with', 'src3'))}, 6) AS rank FROM documents) WHERE rank > 0 ORDER BY rank DESC, doc_id LIMIT 100")
def fts_rank(spark, sf):
    return text_index.best(spark, documents_index(spark, sf, **WHOLE), "the with src3", 100, matched=False)


@query("SELECT p_partkey AS id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT p_partkey, list_distinct(list_transform(range(1, len(x) - 1), lambda i: substr(x, i, 3))) AS a, list_distinct(list_transform(range(1, len(y) - 1), lambda i: substr(y, i, 3))) AS b FROM (SELECT p_partkey, '  ' || lower(p_brand) || ' ' AS x, '  brand#1 ' AS y FROM part)) WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.7")
def tag_autocomplete_trigram(spark, sf):
    index = once(table(spark, sf, "part"), lambda d: name_index.build(d, "p_partkey", "p_brand"), "p_brand")
    return name_index.named_alike(spark, index, "Brand#1", 0.7).select(F.col("p_partkey").alias("id"), F.round("similarity", 6).alias("similarity"))


GRAMS = "SELECT DISTINCT w, substr(x, i, 3) AS g FROM (SELECT w, x, unnest(range(1, len(x) - 1)) AS i FROM (SELECT DISTINCT w, '  ' || w || ' ' AS x FROM (SELECT unnest(" + _words("text") + ") AS w FROM benchmark)))"


@query(f"""WITH g AS ({GRAMS}), n AS (SELECT w, count(*) AS n FROM g GROUP BY w), c AS (SELECT x.w AS a, y.w AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.w < y.w GROUP BY ALL)
    SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM c JOIN n x ON x.w = a JOIN n y ON y.w = b WHERE c / (x.n + y.n - c) >= 0.3""")
def names_alike(spark, sf):
    """Words of the benchmark that are spelt alike."""
    spelt = lambda d: d.select("item_id", F.explode(words(F.col("text"))).alias("word"))
    index = once(table(spark, sf, "benchmark"), lambda d: name_index.build(spelt(d), "item_id", "word"), "words")
    return name_index.pairs_alike(spark, index, 0.3).withColumn("similarity", F.round("similarity", 6))


@query("SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(t) AS term FROM " + TOKENS + ") GROUP BY term")
def fts_index_terms(spark, sf):
    index = search.inverted_index(table(spark, sf, "documents"), "doc_id", {"A": F.col("text")})
    return index.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"SELECT p_partkey AS id, round({_rank({'A': 'p_name', 'B': 'p_brand', 'C': 'p_type', 'D': 'CAST(p_size AS VARCHAR)'}, ('small', 'brand', 'economy', '11'))}, 6) AS rank FROM part")
def fts_rank_four_classes(spark, sf):
    """A document of four weighted fields for each part."""
    fields = {"A": F.col("p_name"), "B": F.col("p_brand"), "C": F.col("p_type"), "D": F.col("p_size").cast("string")}
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(search.rank(fields, "small brand economy 11"), 6).alias("rank"))


@query()
def fts_cover_density(spark, sf):
    """All matches with their rank by cover density; a page is the first rows by falling rank and id."""
    return text_index.cover_density(spark, documents_index(spark, sf, **WHOLE), "the with OR und von").withColumn("rank", F.round("rank", 6))


HYBRID = "at supplier#000000004 the SUPPLIER#000000002 beach"


@query(f"""WITH w AS (SELECT word, CAST(row_number() OVER () AS BIGINT) AS i FROM (SELECT unnest(string_split('{HYBRID}', ' ')) AS word)), m AS (SELECT person_id, i FROM {PERSONS_SQL} p JOIN w ON lower(w.word) = lower(p.name) WHERE trim(name) <> '' AND NOT is_hidden ORDER BY person_id, i LIMIT 1)
    SELECT DISTINCT asset_id, (SELECT string_agg(word, ' ' ORDER BY i) FROM w WHERE i <> (SELECT i FROM m)) AS rest FROM {FACES_SQL} WHERE person_id = (SELECT person_id FROM m)""")
def search_hybrid_names(spark, sf):
    who = search.persons_named(spark, HYBRID, people.directory(views.persons(spark, sf)))
    return views.faces(spark, sf).join(who, "person_id").select("asset_id", "rest").distinct()


# --- boxes ---

BOXES = "(SELECT l_orderkey AS image, l_partkey * 100 + l_suppkey % 100 AS box, max(l_discount * 5) AS x, max(l_tax * 5) AS y, max(0.2 + l_quantity / 200) AS w, max(0.3) AS h, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL)"


def _boxes(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = [F.col("l_orderkey").alias("image"), (F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("box")]
    m = {"x": F.col("l_discount") * 5, "y": F.col("l_tax") * 5, "w": F.lit(0.2) + F.col("l_quantity") / 200, "h": F.lit(0.3), "score": F.col("l_extendedprice")}
    return li.groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in m.items()])


@query(f"""SELECT image, a, b, round(i / u, 6) AS iou FROM (SELECT p.image, p.box AS a, q.box AS b, greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) AS i,
    p.w * p.h + q.w * q.h - i AS u FROM {BOXES} p JOIN {BOXES} q ON p.image = q.image AND p.box < q.box) WHERE i / u > 0.2""")
def iou_pairs(spark, sf):
    return detect.iou_pairs(_boxes(spark, sf), "image", "box", 0.2).select("image", "a", "b", F.round("iou", 6).alias("iou"))


NMS = f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box) AS k FROM {BOXES}),
r AS (SELECT image, 1 AS k, [struct_pack(box := box, score := score, x := x, y := y, w := w, h := h)] AS kept FROM b WHERE k = 1 UNION ALL
  SELECT r.image, r.k + 1, CASE WHEN len(list_filter(r.kept, lambda p: greatest(0, least(p.x + p.w, b.x + b.w) - greatest(p.x, b.x)) * greatest(0, least(p.y + p.h, b.y + b.h) - greatest(p.y, b.y))
    / (p.w * p.h + b.w * b.h - greatest(0, least(p.x + p.w, b.x + b.w) - greatest(p.x, b.x)) * greatest(0, least(p.y + p.h, b.y + b.h) - greatest(p.y, b.y))) > 0.35)) > 0 THEN r.kept
    ELSE list_append(r.kept, struct_pack(box := b.box, score := b.score, x := b.x, y := b.y, w := b.w, h := b.h)) END FROM r JOIN b ON b.image = r.image AND b.k = r.k + 1)
SELECT image, p.box AS box, p.score AS score, p.x AS x, p.y AS y, p.w AS w, CAST(p.h AS DOUBLE) AS h FROM (SELECT image, unnest(kept) AS p FROM (SELECT image, arg_max(kept, k) AS kept FROM r GROUP BY image))"""


@query(NMS)
def nms_boxes(spark, sf):
    return detect.nms(_boxes(spark, sf), "image", "box", 0.35)


@query("SELECT p_partkey AS id, CAST(round(greatest(0.0, least((0.3 + 0.2) * p_size * 40 - s / 2, p_size * 40 - s))) AS INTEGER) AS x, CAST(round(s) AS INTEGER) AS side FROM (SELECT *, least(greatest(0.4 * p_size * 40, 0.5 * 600) * 1.35, p_size * 40, 600) AS s FROM part)")
def face_chips(spark, sf):
    w = F.col("p_size") * 40.0
    chip = detect.face_chip(w, F.lit(600.0), F.lit(0.3), F.lit(0.2), F.lit(0.4), F.lit(0.5))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), chip["x"].alias("x"), chip["side"].alias("side"))
