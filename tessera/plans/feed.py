"""Queries of feeds, filters and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import days_remaining
from tessera.operators import facets, feed, feed_table, filters
from tessera.operators.filters import FeedRequest, apply_filters
from tessera.plans import views
from tessera.plans.views import ASSET_TAGS_SQL, FACES_SQL, NOW, PERSONS_SQL, assets_sql
from tessera.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LIVE = f"{assets_sql()} WHERE deleted_at IS NULL"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def live(spark: SparkSession, sf: str, **more) -> DataFrame:
    return apply_filters(views.assets(spark, sf), FeedRequest(**more))


@query(f"SELECT id, captured_at FROM {LIVE} ORDER BY captured_at DESC NULLS LAST, id DESC LIMIT 51")
def feed_timeline(spark, sf):
    return feed.page(live(spark, sf), FeedRequest()).select("id", "captured_at")


@query(f"SELECT id, captured_at FROM {LIVE} AND (captured_at < TIMESTAMP '1996-03-05' OR (captured_at = TIMESTAMP '1996-03-05' AND id < 5000)) ORDER BY captured_at DESC NULLS LAST, id DESC LIMIT 61")
def feed_timeline_cursor(spark, sf):
    req = FeedRequest(limit=60, cursor_captured_at="1996-03-05 00:00:00", cursor_id=5000)
    return feed.page(live(spark, sf), req).select("id", "captured_at")


@query(f"SELECT id FROM {assets_sql(True)} WHERE deleted_at IS NULL AND captured_at IS NULL AND id < 9000 ORDER BY id DESC LIMIT 51")
def feed_undated_cursor(spark, sf):
    rows = apply_filters(views.assets(spark, sf, True), FeedRequest())
    return feed.page(rows, FeedRequest(sort="added", cursor_id=9000)).select("id")


SHUFFLE = "CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END"
HASHED = f"(SELECT *, {SHUFFLE} AS shuffle FROM (SELECT *, CAST('0x' || substr(md5(id || '1337'), 1, 8) AS BIGINT) AS h FROM {LIVE}))"


@query(f"SELECT id, shuffle FROM {HASHED} ORDER BY shuffle, id LIMIT 51")
def feed_random(spark, sf):
    return feed.page(live(spark, sf), FeedRequest(sort="random")).select("id", "shuffle")


@query(f"SELECT id, shuffle FROM {HASHED} WHERE (shuffle, id) > (SELECT ({SHUFFLE}, 400) FROM (SELECT CAST('0x' || substr(md5('400' || '1337'), 1, 8) AS BIGINT) AS h)) ORDER BY shuffle, id LIMIT 51".replace(
    "(shuffle, id) > (SELECT", "row(shuffle, id) > (SELECT row"
))
def feed_random_cursor(spark, sf):
    return feed.page(live(spark, sf), FeedRequest(sort="random", cursor_id=400)).select("id", "shuffle")


SECTIONS = f"""(SELECT coalesce('section-' || strftime(d, '%Y-%m-%d'), 'section-undated') AS section_id,
    coalesce(strftime(d, '%A') || ', ' || day(d) || CASE WHEN day(d) BETWEEN 11 AND 13 THEN 'th' WHEN day(d) % 10 = 1 THEN 'st' WHEN day(d) % 10 = 2 THEN 'nd'
      WHEN day(d) % 10 = 3 THEN 'rd' ELSE 'th' END || strftime(d, ' %B %Y'), 'Undated') AS title, strftime(d, '%b') AS month, strftime(d, '%Y') AS year,
    strftime(d, '%Y-%m-%d') AS date_iso, count(*) AS n_items, max(id) AS first_id FROM (SELECT id, CAST(captured_at AS DATE) AS d FROM {assets_sql(True)} WHERE deleted_at IS NULL) GROUP BY d)"""


@query(f"SELECT * FROM {SECTIONS}")
def feed_sections(spark, sf):
    return feed.sections(apply_filters(views.assets(spark, sf, True), FeedRequest()))


@query(f"SELECT month, year, max(section_id) AS section_id FROM {SECTIONS} WHERE date_iso IS NOT NULL GROUP BY month, year")
def scrub_markers(spark, sf):
    return feed.scrub_markers(feed.sections(apply_filters(views.assets(spark, sf, True), FeedRequest())))


@query("""SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""".replace("sum(new)", "CAST(sum(new)").replace("event_id) AS run", "event_id) AS BIGINT) AS run"))
def section_runs(spark, sf):
    rows = feed.runs(table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type"))
    return rows.select("event_id", "user_id", "run")


@query(f"SELECT id, coalesce(lag(id) OVER w, -1) AS prev_id, coalesce(lead(id) OVER w, -1) AS next_id FROM {LIVE} WINDOW w AS (PARTITION BY captured_at ORDER BY id)")
def feed_neighbours(spark, sf):
    return feed.neighbours(live(spark, sf), ["captured_at"], [F.col("id")]).select("id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("prev_id", "next_id")])


@query(f"SELECT id FROM {LIVE} AND (id % 3 = 0 OR id % 5 = 0)")
def merge_pages(spark, sf):
    rows = live(spark, sf).select("id")
    return feed.merge_page(rows.where("id % 3 = 0"), rows.where("id % 5 = 0"))


DIVISION = "id IN (SELECT asset_id FROM {bridge} WHERE {col} IN ({values}) GROUP BY asset_id HAVING count(DISTINCT {col}) = {n})"


@query(f"SELECT id, captured_at FROM {LIVE} AND " + DIVISION.format(bridge=ASSET_TAGS_SQL, col="name", values="'Brand#11', 'Brand#22'", n=2))
def filter_division_tags(spark, sf):
    req = FeedRequest(tags=["Brand#11", "Brand#22"])
    return apply_filters(views.assets(spark, sf), req, tags=views.asset_tags(spark, sf)).select("id", "captured_at")


@query(f"SELECT id FROM {LIVE} AND " + DIVISION.format(bridge=FACES_SQL, col="person_id", values="3, 7", n=2))
def filter_division_persons(spark, sf):
    return apply_filters(views.assets(spark, sf), FeedRequest(person_ids=[3, 7]), faces=views.faces(spark, sf)).select("id")


@query(f"SELECT id FROM {LIVE} AND false")
def filter_division_repeated(spark, sf):
    return apply_filters(views.assets(spark, sf), FeedRequest(tags=["Brand#11", "Brand#11"]), tags=views.asset_tags(spark, sf)).select("id")


@query(f"SELECT id, city FROM {LIVE} AND id BETWEEN 1 AND 2500 AND id % 2 = 1")
def filter_candidates_semi(spark, sf):
    return live(spark, sf, candidate_ids=list(range(1, 2501, 2))).select("id", "city")


@query(f"SELECT id FROM {LIVE} AND false")
def filter_candidates_empty(spark, sf):
    return live(spark, sf, candidate_ids=[]).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 12")
def filter_bbox(spark, sf):
    box = filters.bounding_box("c_acctbal", "c_nationkey", 0.0, 5000.0, 3, 12)
    return table(spark, sf, "customer").where(box).select(F.col("c_custkey").alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey BETWEEN 3 AND 12")
def filter_bbox_one_axis(spark, sf):
    return table(spark, sf, "customer").where(filters.bounding_box("c_acctbal", "c_nationkey", 0.0, None, 3, 12)).select(F.col("c_custkey").alias("id"))


@query(f"SELECT id, duration_seconds FROM {LIVE} AND duration_seconds IS NOT NULL")
def filter_media_type(spark, sf):
    return live(spark, sf, media_type="videos").select("id", "duration_seconds")


@query(f"SELECT id FROM {LIVE} AND is_favorite")
def filter_favorite(spark, sf):
    return live(spark, sf, favorite=True).select("id")


@query(f"SELECT id, deleted_at, CAST(greatest(30 - floor((epoch(TIMESTAMP '{NOW}') - epoch(deleted_at)) / 86400), 0) AS INTEGER) AS days_remaining FROM {assets_sql()} WHERE deleted_at IS NOT NULL")
def filter_trash(spark, sf):
    rows = apply_filters(views.assets(spark, sf), FeedRequest(trash=True))
    left = days_remaining(F.col("deleted_at").cast("timestamp"), views.now().cast("timestamp"))
    return rows.select("id", "deleted_at", left.alias("days_remaining"))


@query(f"SELECT id FROM {LIVE} AND captured_at >= TIMESTAMP '1995-01-01' AND captured_at <= TIMESTAMP '1995-06-30' AND city = '2-HIGH' AND camera_model = 'F'")
def filter_dates_places(spark, sf):
    ts = [F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1995-06-30")]
    return live(spark, sf, date_from=ts[0], date_to=ts[1], city="2-HIGH", camera="F").select("id")


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS n, count(*) FILTER (WHERE toxic) AS n_toxic FROM (SELECT coalesce(quality, -1) AS label, toxic = 1 AS toxic FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY label")
def sparse_flags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy(F.coalesce("quality", F.lit(-1)).cast("long").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE duration_seconds IS NULL) AS photos, count(*) FILTER (WHERE duration_seconds IS NOT NULL) AS videos, min(captured_at) AS min_date, max(captured_at) AS max_date FROM {LIVE}")
def facet_summary(spark, sf):
    return facets.summary(live(spark, sf))


@query(f"""SELECT CAST(year(captured_at) AS INTEGER) AS year, lpad(CAST(month(captured_at) AS VARCHAR), 2, '0') AS month, any_value(strftime(captured_at, '%b')) AS month_name, count(*) AS count, max(captured_at) AS newest
    FROM {LIVE} GROUP BY 1, 2""")
def facet_timeline(spark, sf):
    return facets.timeline(live(spark, sf))


@query("""SELECT lower(label) AS value, label, count(*) AS count FROM (SELECT CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'Afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS label FROM events) GROUP BY label""")
def facet_time_of_day(spark, sf):
    return facets.times_of_day(table(spark, sf, "events"), F.hour("ts"))


def _top(value: str, n: int, source: str = LIVE) -> str:
    return f"SELECT {value} AS value, count(*) AS count FROM {source} GROUP BY 1 ORDER BY count DESC, value LIMIT {n}"


@query(_top("city", 20))
def facet_city(spark, sf):
    return facets.by_value(live(spark, sf), F.col("city"), 20)


@query(_top("p_brand", 15, "part"))
def facet_camera(spark, sf):
    return facets.by_value(table(spark, sf, "part"), F.col("p_brand"), 15)


@query(_top("folder_path", 20, views.FOLDERS_SQL + " WHERE folder_path <> 'root'"))
def facet_folder(spark, sf):
    return facets.by_value(views.folders(spark, sf).where("folder_path <> 'root'"), F.col("folder_path"), 20)


@query(f"SELECT name AS value, name AS label, count(*) AS count FROM {ASSET_TAGS_SQL} WHERE asset_id IN (SELECT id FROM {LIVE}) GROUP BY name ORDER BY count DESC, label LIMIT 40")
def facet_tags(spark, sf):
    tags = views.asset_tags(spark, sf).select("asset_id", F.col("name").alias("tag"))
    names = table(spark, sf, "part").select(F.col("p_brand").alias("tag")).distinct().withColumn("name", F.col("tag"))
    return facets.by_bridge(live(spark, sf), tags, "asset_id", names, "tag", "name", 40)


@query(f"SELECT CAST(person_id AS VARCHAR) AS value, name AS label, count(*) AS count FROM {FACES_SQL} JOIN {PERSONS_SQL} USING (person_id) WHERE trim(name) <> '' AND asset_id IN (SELECT id FROM {LIVE}) GROUP BY 1, 2 ORDER BY count DESC, label LIMIT 30")
def facet_people(spark, sf):
    return facets.by_bridge(live(spark, sf), views.faces(spark, sf), "asset_id", views.persons(spark, sf), "person_id", "name", 30)


@query(f"""SELECT 'city' AS facet, city AS value, count(*) AS count FROM {LIVE} GROUP BY city UNION ALL SELECT 'camera', camera_model, count(*) FROM {LIVE} GROUP BY camera_model
    UNION ALL SELECT 'year', CAST(year(captured_at) AS VARCHAR), count(*) FROM {LIVE} GROUP BY 2""")
def facets_long(spark, sf):
    return facets.long_form(live(spark, sf), {"city": F.col("city"), "camera": F.col("camera_model"), "year": F.year("captured_at")})


@query(f"SELECT 'city' AS facet, string_agg(value || '=' || count, ',' ORDER BY count DESC, value) AS vals FROM (SELECT city AS value, count(*) AS count FROM {LIVE} GROUP BY city)")
def facets_nested(spark, sf):
    rows = facets.nested(facets.long_form(live(spark, sf), {"city": F.col("city")}))
    return rows.select("facet", F.array_join(F.transform("values", lambda v: F.concat(v["value"], F.lit("="), v["count"].cast("string"))), ",").alias("vals"))


@query("""SELECT CAST(floor(c_acctbal / 500) AS BIGINT) AS row, CAST(floor(c_nationkey / 5.0) AS BIGINT) AS col, count(*) AS count, min(c_acctbal) AS min_lat, max(c_acctbal) AS max_lat,
    min(c_nationkey) AS min_lng, max(c_nationkey) AS max_lng FROM customer GROUP BY 1, 2""")
def map_clusters(spark, sf):
    cells = facets.map_cells(table(spark, sf, "customer").withColumn("lng", F.col("c_nationkey") * 100.0), "c_acctbal", "lng", 500.0)
    back = [(F.col(f"{a}_lng") / 100).cast("int").alias(f"{a}_lng") for a in ("min", "max")]
    return cells.select("row", "col", "count", "min_lat", "max_lat", *back)


# --- pages from a table in page order ---


def _pages(spark, sf, sort: str, count: int, keep=None, **more) -> DataFrame:
    """The rows of the first pages, one after the other, each from the last row of the one before."""
    rows = views.assets(spark, sf, True)
    held = feed_table.build(apply_filters(rows, FeedRequest()).select("id", "captured_at", "is_favorite"), sort, part_rows=2_000)
    out, req = [], FeedRequest(sort=sort, **more)
    for n in range(count):
        own, follows, _ = feed_table.page(spark, held, req, keep)
        out += [(n, r.id, r.captured_at) for r in own]
        if not follows:
            break
        req = FeedRequest(sort=sort, cursor_id=own[-1].id, cursor_captured_at=own[-1].captured_at, **more)
    return spark.createDataFrame(out, "page int, id long, captured_at timestamp_ntz")


PAGES_SQL = "SELECT CAST((r - 1) // {n} AS INTEGER) AS page, id, captured_at FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM (SELECT *, {shuffle} AS shuffle FROM (SELECT *, CAST('0x' || substr(md5(id || '1337'), 1, 8) AS BIGINT) AS h FROM {assets} WHERE deleted_at IS NULL{where}))) WHERE r <= {n} * 4"


@query(PAGES_SQL.format(n=50, order="captured_at DESC NULLS LAST, id DESC", shuffle=SHUFFLE, assets=assets_sql(True), where=""))
def feed_pages_by_parts(spark, sf):
    return _pages(spark, sf, "added", 4)


@query(PAGES_SQL.format(n=70, order="shuffle, id", shuffle=SHUFFLE, assets=assets_sql(True), where=" AND is_favorite"))
def feed_pages_shuffled_by_parts(spark, sf):
    return _pages(spark, sf, "random", 4, lambda rows: rows.where("is_favorite"), limit=70)
