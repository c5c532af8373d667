"""Traps of the semantics on a few rows, and properties of what SQL can't express."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dates, media, paths, text, urls
from tessera.operators import detect, feed, filters, folders, items, jobs, mutations, people, search, vectors
from tessera.operators.filters import FeedRequest
from tessera.plans import ingest, library, views
from tessera.sources import pages, social, uploads

ASSETS = "id string, user_id int, captured_at timestamp_ntz, duration_seconds double, deleted_at timestamp_ntz, folder_path string, is_favorite boolean, city string, camera_model string"
T = dt.datetime
ROWS = [
    ("a1", 1, T(2024, 5, 1, 10), None, None, "Trips/Rome", False, None, None),
    ("a2", 1, T(2024, 5, 1, 10), 3.5, None, "Trips/Rome/Day2", True, "Rome", "X"),
    ("a3", 1, None, None, None, "root", False, None, None),
    ("a4", 1, T(2023, 12, 11, 4), None, T(2024, 5, 20), "Trips", False, None, None),
    ("a5", 1, T(2024, 5, 12, 12), None, None, "", False, None, None),
]


@pytest.fixture(scope="module")
def assets(spark):
    return spark.createDataFrame(ROWS, ASSETS).cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_timeline_and_unreachable_undated(assets):
    live = filters.apply_filters(assets, FeedRequest(user_id=1))
    assert ids(feed.page(live, FeedRequest())) == ["a5", "a2", "a1", "a3"]
    rows, more, cursor = feed.paged(live, FeedRequest(limit=2))
    assert [r.id for r in rows] == ["a5", "a2"] and more and cursor.id == "a2"
    rest = feed.page(live, FeedRequest(limit=2, cursor_captured_at=cursor.captured_at, cursor_id=cursor.id))
    assert ids(rest) == ["a1"]
    with pytest.raises(ValueError):
        FeedRequest(cursor_id="a1")


def test_sections(assets):
    live = filters.apply_filters(assets, FeedRequest())
    got = {r.section_id: (r.title, r.n_items) for r in feed.sections(live).collect()}
    assert got == {"section-2024-05-12": ("Sunday, 12th May 2024", 1), "section-2024-05-01": ("Wednesday, 1st May 2024", 2), "section-undated": ("Undated", 1)}


def test_empty_candidates_and_none(assets):
    assert ids(filters.apply_filters(assets, FeedRequest(candidate_ids=[]))) == []
    assert len(ids(filters.apply_filters(assets, FeedRequest(candidate_ids=None)))) == 4
    long = [f"x{i}" for i in range(filters.LITERAL_IDS)] + ["a1"]
    assert ids(filters.apply_filters(assets, FeedRequest(candidate_ids=long))) == ["a1"]


def test_division_counts_repeats(spark, assets):
    tags = spark.createDataFrame([("a1", "beach"), ("a1", "sun"), ("a2", "beach")], "asset_id string, name string")
    wanted = lambda *t: sorted(ids(filters.apply_filters(assets, FeedRequest(tags=t), tags=tags)))
    assert wanted("beach", "sun") == ["a1"] and wanted("beach", "beach") == [] and wanted("beach") == ["a1", "a2"]


def test_parameters():
    assert filters.csv_names(" Sun, ,sun") == ["sun", "sun"]
    assert filters.csv_uuids("x, 0d4f1f1e-0000-4000-8000-000000000001") == ["0d4f1f1e-0000-4000-8000-000000000001"]
    assert [filters.clamp_limit(x) for x in (None, 0, 500)] == [50, 1, 200]
    assert filters.lenient_bool("") is None and filters.lenient_bool("1") is True
    with pytest.raises(ValueError):
        filters.lenient_bool("yes")


def test_folders(assets):
    newest = F.struct("captured_at", "id")
    live = filters.apply_filters(assets, FeedRequest())
    assert [(r.name, r.media_count, r.cover_thumb) for r in folders.children(live.withColumn("thumb_path", F.col("id")), "", newest).collect()] == [("Trips", 2, "a2")]
    assert [(r.name, r.media_count) for r in folders.children(live.withColumn("thumb_path", F.col("id")), "Trips", newest).collect()] == [("Rome", 2)]
    assert live.where(F.col("folder_path") == "Trips").count() == 0


def test_days_remaining(assets):
    now = F.lit(T(2024, 5, 30)).cast("timestamp")
    row = assets.where("id = 'a4'").select(dates.days_remaining(F.col("deleted_at").cast("timestamp"), now).alias("d")).first()
    assert row.d == 20


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=1, max_size=25, unique=False), st.integers(1, 7), st.integers(0, 5))
def test_pages_concatenate(spark, days, limit, seed):
    rows = [(i, None if gone else T(2024, 1, 1 + d)) for i, (d, gone) in enumerate(days)]
    df = spark.createDataFrame(rows, "id long, captured_at timestamp_ntz")
    dated = df.where("captured_at is not null")
    whole, got, cursor = ids(feed.page(dated, FeedRequest(limit=200))), [], None
    while True:
        req = FeedRequest(limit=limit) if cursor is None else FeedRequest(limit=limit, cursor_captured_at=cursor.captured_at, cursor_id=cursor.id)
        page, more, cursor = feed.paged(dated, req)
        got += [r.id for r in page]
        if not more:
            break
    assert got == whole
    shuffled = ids(feed.page(df, FeedRequest(sort="random", seed=seed, limit=200)))
    assert sorted(shuffled) == [r[0] for r in rows]
    rest = ids(feed.page(df, FeedRequest(sort="random", seed=seed, limit=200, cursor_id=shuffled[0])))
    assert rest == shuffled[1:]


def test_vectors(spark):
    df = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, "p", [0.0, 1.0]), (3, "q", [0.0, 0.0])], "id long, person string, v array<float>")
    c = {r.person: (r.n, [round(x, 4) for x in r.centroid]) for r in vectors.centroids(df, "person", "v").collect()}
    assert c == {"p": (2, [0.7071, 0.7071]), "q": (1, [0.0, 0.0])}
    cover = vectors.covers(df.where("person = 'p'"), vectors.centroids(df, "person", "v"), "person", "id", "v").first()
    assert cover.cover_id == 1
    one = df.select(vectors.cosine(F.col("v"), F.array(F.lit(1.0))).alias("c"), vectors.moved_centroid(F.col("v"), F.lit(1), F.col("v")).alias("m")).first()
    assert one.c == 0.0 and one.m == [1.0, 0.0]
    assert vectors.similar_to_id(df, 99, "id", "v").count() == 0


def test_online_clustering_follows_the_order(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:3]
    rows = [(0, i, (centres[i % 3] + rng.normal(0, 0.05, 8)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "u long, id long, v array<double>")
    got = {r.id: r.cluster for r in vectors.cluster_online(df, "u", ["id"], "id", "v").collect()}
    assert got == {i: i % 3 for i in range(30)}


def test_assignment_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "id long, v array<double>")
    cents = df.select(F.col("id").alias("k"), F.col("v").alias("centroid"))
    for limit in (64 << 20, 60):
        assert {r.id: r.k for r in vectors.assigned(df, cents, "k", "id", "v", 0.5, limit).collect()} == {i: i for i in range(6)}


def test_suppression(spark):
    rows = [(1, 1, 0.0, 0.0, 0.4, 0.4, 0.9), (1, 2, 0.05, 0.05, 0.4, 0.4, 0.8), (1, 3, 0.6, 0.6, 0.2, 0.2, 0.7)]
    df = spark.createDataFrame(rows, "image long, box long, x double, y double, w double, h double, score double")
    assert sorted(r.box for r in detect.nms(df, "image", "box").collect()) == [1, 3]
    rng = random.Random(3)
    many = [(i % 4, i, rng.random(), rng.random(), 0.3, 0.3, rng.random()) for i in range(120)]
    df = spark.createDataFrame(many, df.schema)
    kept = detect.nms(df, "image", "box", 0.35)
    assert detect.iou_pairs(kept, "image", "box", 0.35).count() == 0
    lost = df.join(kept.select("box"), "box", "left_anti").join(kept.selectExpr("image", "x kx", "y ky", "w kw", "h kh", "score ks"), "image")
    hit = detect.iou(*[F.col(c) for c in ("x", "y", "w", "h", "kx", "ky", "kw", "kh")]) > 0.35
    assert lost.where(hit & (F.col("ks") >= F.col("score"))).select("box").distinct().count() == df.count() - kept.count()


def test_decoding(spark):
    scores = [0.0] * 8
    scores[5] = 0.9  # cell 2 of a 2 by 2 grid, second anchor: column 0, row 1
    boxes = [0.0] * 32
    boxes[20:24] = [0.0, 0.0, 2.0, 2.0]
    df = spark.createDataFrame([(1, scores, boxes, 1.0, 0.0, 0.0, 100, 100)], "image long, scores array<double>, boxes array<double>, scale double, pad_x double, pad_y double, img_w int, img_h int")
    r = detect.decoded_anchors(df, "image", 16, 2, 0.5).first()
    assert (r.cell, r.x, r.y, r.w, r.h) == (5, 0.0, 0.16, 0.32, 0.32)
    pose = [50.0, 50.0, 20.0, 40.0, 0.9] + [50.0, 50.0, 0.8] * 17
    poses = spark.createDataFrame([(1, pose + [0.0] * 56, 1.0, 0.0, 0.0, 100, 100)], "image long, values array<double>, scale double, pad_x double, pad_y double, img_w int, img_h int")
    r = detect.decoded_poses(poses, "image", 0.5).collect()
    assert len(r) == 1 and (round(r[0].x, 6), round(r[0].y, 6), len(r[0].keypoints)) == (0.4, 0.3, 17)
    points = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 0.0, 1.0, 3.0), (1, 0.0, 1.0, -1.0, 1.0)], "g long, x double, y double, u double, v double")
    r = detect.similarity_transform(points, ["g"]).first()
    assert [round(x, 9) for x in (r.a, r.b, r.tx, r.ty)] == [0.0, 2.0, 1.0, 1.0]


def test_tags(spark):
    rows = [(1, "Sun ", 0.4, 0, "model", 0), (1, "sun", 0.9, 1, "scraped", 1), (1, "SUN", 0.9, 2, "manual", 2), (1, " ", 1.0, 0, "x", 3), (1, "nan", float("nan"), 0, "x", 4)]
    df = spark.createDataFrame(rows, "a long, name string, confidence double, category int, source string, pos int")
    got = {r.name: (r.confidence, r.category, r.source) for r in people.deduplicated_tags(df, ["a"], carry=("category", "source")).collect()}
    assert got == {"sun": (0.9, 1, "scraped"), "nan": (0.0, 0, "x")}
    assert [r[0] for r in df.select(people.link_source(F.col("source"))).collect()][:3] == ["AI", "SCRAPE", "USER"]


def test_search_syntax(spark):
    q = search.parse('sun "red sea" or snow -ice')
    assert q.ways == (((True, ("sun",)), (True, ("red", "sea"))), ((True, ("snow",)), (False, ("ice",))))
    df = spark.createDataFrame([(1, "Sun on the Red Sea"), (2, "sun, sea, red"), (3, "snow"), (4, "snow and ice")], "id long, t string")
    assert ids(search.search(df, F.col("t"), 'sun "red sea" or snow -ice')) == [1, 3]
    assert search.search(df, F.col("t"), "").count() == 0


def test_jobs(spark):
    events = spark.createDataFrame([(1, True, None, None, None), (1, None, True, None, None), (2, True, True, True, False)], "job long, faces boolean, clip boolean, tags boolean, poses boolean")
    got = {r.job: (r.status, r.current_stage) for r in jobs.folded(events, "job", ("faces", "clip", "tags")).collect()}
    assert got == {1: ("pending", "ai_enrichment"), 2: ("completed", "completed")}
    now = F.lit(T(2024, 1, 1, 1)).cast("timestamp_ntz")
    stalled = spark.createDataFrame([(1, "processing", 2, T(2024, 1, 1)), (2, "processing", 3, T(2024, 1, 1)), (3, "processing", 3, T(2024, 1, 1, 0, 50))], "id long, status string, attempts int, updated_at timestamp_ntz")
    assert {r.id: r.status for r in jobs.reclaimed(stalled, now).collect()} == {1: "pending", 2: "failed", 3: "processing"}
    assert jobs.claimable(stalled.withColumn("current_stage", F.lit("thumbnail")), "nonsense").count() == 0


def test_paths(spark):
    files = spark.createDataFrame([(1, "f/x.jpg"), (2, "f/x.jpg"), (3, "f/x_1.jpg"), (4, "noext"), (5, "noext")], "id long, path string")
    got = {r.id: r.unique_path for r in mutations.verified_paths(files, "path", "id").collect()}
    assert len(set(got.values())) == 5 and got[5] == "noext_1"
    df = spark.createDataFrame([("/a/ .. /b//",), ("",), (None,), ("..",)], "p string")
    assert [r[0] for r in df.select(paths.sanitized(F.col("p"))).collect()] == ["a/b", "root", "root", "root"]
    crumbs = [r[0] for r in df.select(paths.breadcrumbs(F.col("p"))).collect()]
    assert crumbs[1] == [] and crumbs[2] == [] and crumbs[3][0].path == ".."


def test_upserts(spark):
    old = spark.createDataFrame([("a", 3), ("b", 1)], "name string, usage_count long").withColumn("category", F.lit(0)).withColumn("source", F.lit("x"))
    new = spark.createDataFrame([("b", 5, "y"), ("c", 6, "z")], "name string, category int, source string")
    got = {r.name: (r.usage_count, r.category) for r in mutations.tags_upserted(old, new).collect()}
    assert got == {"a": (3, 0), "b": (2, 0), "c": (1, 6)}
    members = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "album_id long, asset_id long, position int")
    more = {(r.asset_id, r.position) for r in mutations.appended_positions(members, 1, [11, 12, 13]).collect()}
    assert (10, 0) in more and (11, 1) in more and len(more) == 4 and max(p for _, p in more) > 2


def test_items_inherit(spark):
    posts = spark.createDataFrame([(1, "cap", ["x"])], "post long, caption string, tags array<string>")
    df = spark.createDataFrame([(1, 1, None, []), (1, 2, "own", ["y"])], "post long, item long, caption string, tags array<string>")
    plain = {r.item: (r.caption, r.tags) for r in items.inherited(df, posts, "post", ["caption", "tags"]).collect()}
    assert plain == {1: ("cap", []), 2: ("own", ["y"])}
    by_size = {r.item: r.tags for r in items.inherited(df, posts, "post", ["tags"], tags_by_size=True).collect()}
    assert by_size == {1: ["x"], 2: ["y"]}


def test_urls(spark):
    base = "https://ex.org/a/b?x=1#f"
    targets = {"c": "https://ex.org/a/c", "/c": "https://ex.org/c", "//h/c": "https://h/c", "?y": "https://ex.org/a/b?y", "http://z/": "http://z/", r"\/q&amp;r": "https://ex.org/q&r"}
    df = spark.createDataFrame([(t,) for t in targets], "t string")
    assert {r.t: r.u for r in df.select("t", urls.resolved(F.lit(base), F.col("t")).alias("u")).collect()} == targets
    assert df.limit(1).select(urls.resolve_dots(F.lit(base), F.lit("../../z/./y"))).first()[0] == "https://ex.org/z/y"
    assert df.limit(1).select(urls.poster_of(F.lit("https://v/abcd_1080p.mp4"), F.array(F.lit("i/x.jpg"), F.lit("i/abcd.jpg")))).first()[0] == "i/abcd.jpg"
    assert [r[0] for r in spark.createDataFrame([("www.a.b.org",), ("x.org",), ("local",)], "h string").select(text.site_name(F.col("h"))).collect()] == ["b", "x", "local"]


def test_browser_rules(spark):
    df = spark.createDataFrame([("https://x/watch?v=1", 0), ("https://x/watch?v=1", 1), ("https://x/list", 0)], "u string, n int")
    assert [r[0] for r in df.select(pages.needs_browser(F.col("u"), F.col("n"))).collect()] == [True, False, False]
    seen = F.array(F.lit("a.mp4"), F.lit("b/index.m3u8"), F.lit("b/master.m3u8"))
    assert df.limit(1).select(pages.preferred_stream(seen)).first()[0] == "b/master.m3u8"
    assert df.limit(1).select(social.route(F.lit("https://www.reddit.com/r/x"))).first()[0] == "reddit"


def test_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("blue_sky,3,x\nodd,none,y\nshort\n")
    assert {(r.name, r.category) for r in uploads.vocabulary(spark, str(tmp_path / "v.csv")).collect()} == {("blue sky", 3), ("odd", 0)}
    (tmp_path / "e.bin").write_bytes(b"")
    (tmp_path / "f.bin").write_bytes(b"abc")
    files = uploads.staged_files(spark, f"{tmp_path}/*.bin")
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in files.collect()] == [("f.bin", 3)]
    expected = spark.createDataFrame([("e.bin",), ("f.bin",)], "file_name string")
    assert [(r.file_name, r.status) for r in uploads.rejected(expected, files).collect()] == [("e.bin", "error")]
    df = spark.createDataFrame([("bytes 0-9/1234", "10"), (None, "77"), ("bytes */*", None)], "r string, n string")
    assert [x[0] for x in df.select(uploads.range_size(F.col("r"), F.col("n"))).collect()] == [1234, 77, None]


def test_streams_equal_batches(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = ingest.stream_window_counts(spark, "/root/testdata/sf0.001")
    whole = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    assert out.join(whole, ["start", "event_type", "n"], "left_anti").isEmpty()
    assert whole.count() == out.count()


def test_streams_leave_no_window_open(spark):
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    days = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    rests = e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    rests = rests.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
    for out, whole in ((ingest.stream_window_counts(spark, sf), days), (ingest.stream_session_counts(spark, sf), rests)):
        assert out.columns == whole.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))


def test_plans_are_what_is_wanted(spark):
    sf = "/root/testdata/sf0.01"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = plan(feed.page(filters.apply_filters(views.assets(spark, sf), FeedRequest(favorite=True)), FeedRequest()).select("id"))
    assert "TakeOrderedAndProject" in p and "PushedFilters" in p and "EqualTo(o_orderpriority,1-URGENT)" in p
    assert "o_totalprice" not in p.split("ReadSchema")[1].split("\n")[0]


def test_media_scalars(spark):
    df = spark.createDataFrame([("x.MP4",), ("a.b/.hidden",), ("noext",)], "n string")
    assert [r[0] for r in df.select(paths.extension(F.col("n"))).collect()] == ["MP4", None, None]
    assert df.limit(1).select(media.is_video_extension(F.lit("GIF"))).first()[0]
    assert df.limit(1).select(media.video_mime_of_url(F.lit("a.M3U8?x"))).first()[0] == "application/x-mpegURL"
    with pytest.raises(Exception, match="not a boolean"):
        df.select(text.lenient_flag(F.col("n"))).collect()


@pytest.mark.parametrize("max_bytes", [16 << 20, 2000])
def test_exact_search_for_each(spark, max_bytes):
    """The blocked search against one product of all; blocks of queries change nothing."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in vectors.similar_to_each(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.24, 50, max_bytes).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.similarity
    rows = e.orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    for q, found in got.items():
        sims = v @ v[np.flatnonzero(ids == q)[0]]
        assert set(found) == {int(ids[i]) for i in np.lexsort((ids, -sims))[:50] if sims[i] >= 0.24}
        assert all(abs(s - sims[ids == i][0]) < 1e-9 for i, s in found.items())
