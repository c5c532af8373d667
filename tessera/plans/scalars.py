"""Queries of scalar rules and of parsed sources, each over a whole table whose rows give the cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates, media, paths, text
from tessera.operators import detect, jobs
from tessera.session import table
from tessera.sources import playlists, social, uploads
from tessera.streaming import queues

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- numbers, times, names ---


@query("SELECT l_orderkey AS a, l_linenumber AS b, round(CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END * (l_quantity + l_linenumber / 60 + l_discount * 100 / 3600), 9) AS degrees, round(least(greatest(l_tax * 20 - 0.2, 0.0), 1.0), 9) AS confidence, round(CASE WHEN l_linenumber % 3 > 0 THEN l_quantity / (l_linenumber % 3) ELSE 1.5 END, 9) AS ratio FROM lineitem")
def line_numbers(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    degrees = media.decimal_degrees(q, n, F.col("l_discount") * 100, F.when(F.col("l_returnflag") == "A", "s").otherwise("N"))
    out = [degrees.alias("degrees"), media.sane_confidence(F.col("l_tax") * 20 - 0.2).alias("confidence"), media.aspect_ratio(q, n % 3, 1.5).alias("ratio")]
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), n.alias("b"), *out).withColumns({c: F.round(c, 9) for c in ("degrees", "confidence", "ratio")})


@query("SELECT vec_id, round(list_sum(CASE WHEN len(list_filter(v, lambda x: x < 0 OR x > 1)) > 0 THEN list_transform(v, lambda x: 1 / (1 + exp(-x))) ELSE v END), 6) AS total FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 2 = 0 THEN abs(x) / 10 ELSE x END) AS v FROM embeddings)")
def scores_calibrated(spark, sf):
    scores = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.col("vec_id") % 2 == 0, F.abs(x) / 10).otherwise(x))
    total = F.aggregate(media.calibrated(scores), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(total, 6).alias("total"))


@query("SELECT p_partkey AS id, CASE WHEN t THEN 600 ELSE p_size * 40 END AS width, CASE WHEN t THEN p_size * 40 ELSE 600 END AS height, round(s, 9) AS scale, round((640 - p_size * 40 * s) / 2, 6) AS pad_x, round((640 - 600 * s) / 2, 6) AS pad_y FROM (SELECT *, p_partkey % 4 IN (1, 3) AS t, least(640 / (p_size * 40), 640 / 600) AS s FROM part)")
def frames_fitted(spark, sf):
    w, h, turn = F.col("p_size") * 40, F.lit(600), F.element_at(F.array(*map(F.lit, (0, 90, 180, -270))), (F.col("p_partkey") % 4 + 1).cast("int"))
    shown, (scale, x, y) = media.rotated(w, h, turn), detect.letterbox(w, h, 640)
    out = [shown[0].alias("width"), shown[1].alias("height"), F.round(scale, 9).alias("scale"), F.round(x, 6).alias("pad_x"), F.round(y, 6).alias("pad_y")]
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *out)


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS rfc FROM events")
def times_from_epoch(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.from_epoch(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("rfc"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN -1 WHEN 2 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 7200 ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS seconds FROM events")
def times_parsed(spark, sf):
    ts = F.col("ts").cast("timestamp")
    plain, zoned = F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    given = F.element_at(F.array(plain, F.concat(zoned, F.lit("Z")), F.concat(zoned, F.lit("+02:00")), F.date_format(ts, "d MMM yyyy")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.unix_timestamp(dates.parsed_time(given)), F.lit(-1)).alias("seconds"))


HEADS = ("FFD8FF303030303030303030", "89504E470D0A1A0A30303030", "474946383961303030303030", "524946463030303057454250", "303030306674797068656963", "303030306674797071742020", "303030306674797069736F6D", "706C61696E20746578742121", "FFD8FF30")


@query("SELECT doc_id, string_split('jpg png gif webp heic mov mp4', ' ')[CASE WHEN doc_id % 9 < 7 THEN doc_id % 9 + 1 END] AS ext FROM documents")
def heads_sniffed(spark, sf):
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % 9 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", media.magic_extension(F.unhex(F.concat(head, F.when(F.col("doc_id") % 9 != 8, F.hex("text")).otherwise("")))).alias("ext"))


MARKS = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
SAID = "text || ' #' || source || ', (#no) #' || upper(source) || '! #. # ##' || lang"


@query(f"""SELECT doc_id, coalesce(string_agg(w, ',' ORDER BY i), '') AS tags FROM (SELECT doc_id, arg_min(w, i) AS w, min(i) AS i FROM (SELECT doc_id, i, trim(t, {MARKS}) AS w FROM (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM
    (SELECT doc_id, string_split_regex({SAID}, '\\s+') AS l FROM documents)) WHERE starts_with(t, '#')) WHERE w <> '' GROUP BY doc_id, lower(w)) GROUP BY doc_id""")
def hashtags_of_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.hashtags(F.expr(SAID)), ",").alias("tags"))


@query("SELECT doc_id, coalesce(nullif(lower(nullif(regexp_extract(n, '^.+\\.([^.]*)$', 1), '')), ''), 'raw') AS ext FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'noext' WHEN 1 THEN 'a.b.' || upper(lang) ELSE lang || '.Jpg' END AS n FROM documents)")
def disk_extensions(spark, sf):
    i = F.col("doc_id") % 3
    name = F.when(i == 0, "noext").when(i == 1, F.concat(F.lit("a.b."), F.upper("lang"))).otherwise(F.concat("lang", F.lit(".Jpg")))
    made = paths.disk_name(F.lit("x"), name)
    return table(spark, sf, "documents").select("doc_id", F.split_part(made, F.lit("."), F.lit(-1)).alias("ext"))


ERRORS = "CASE event_id % 4 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Rate Limit hit' WHEN 2 THEN 'timeout' ELSE 'feedback_required' END"


@query(f"SELECT event_id, l AS limited, CAST(CASE WHEN l THEN 180 * pow(2, least(greatest(event_id % 7, 1) - 1, 3)) ELSE 35 END AS BIGINT) AS wait FROM (SELECT event_id, event_id % 4 <> 2 AS l FROM events)")
def errors_backed_off(spark, sf):
    limited, wait = media.backoff_seconds(F.expr(ERRORS), F.col("event_id") % 7)
    return table(spark, sf, "events").select("event_id", limited.alias("limited"), wait.alias("wait"))


@query("SELECT event_id FROM events WHERE event_id % 3 < 2 AND (event_id % 5 = 0 OR ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM events))")
def links_ready(spark, sf):
    e = table(spark, sf, "events")
    status = F.element_at(F.array(F.lit("pending"), F.lit("rate_limited"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int"))
    first = e.agg((F.min("ts") + F.expr("interval 10 days")).alias("now"))
    rows = e.select("event_id", status.alias("status"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("next_retry_at")).join(first)
    return jobs.links_ready(rows, F.col("now")).select("event_id")


@query("""SELECT '{"type":"event","event_id":' || event_id || ',"user_id":' || user_id || '}' AS value FROM events""")
def events_as_messages(spark, sf):
    return queues.as_messages(table(spark, sf, "events").select("event_id", "user_id"), "event")


# --- parsed sources ---

BODY = """CASE turn % 5 WHEN 0 THEN '{"action":"commit","turn":' || CAST(turn AS STRING) || '}' WHEN 1 THEN ' {"target":"https://x.org/' || CAST(conv_id AS STRING) || '"}' WHEN 2 THEN 'https://x.org/' || CAST(conv_id AS STRING) ELSE text END"""
TYPED = "CASE WHEN turn % 5 < 2 THEN 'application/JSON; v=1' WHEN turn % 5 = 2 THEN 'text/plain' WHEN turn % 5 = 3 THEN 'image/png' ELSE 'text/plain' END"


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'commit' WHEN 1 THEN 'link' WHEN 2 THEN 'link' ELSE CASE WHEN length(text) < 2048 AND regexp_matches(trim(text, ' '), '^https?://') THEN 'link' ELSE 'binary' END END AS kind FROM conversations")
def bodies_told_apart(spark, sf):
    body = F.expr(BODY)
    return table(spark, sf, "conversations").select("conv_id", "turn", uploads.body_kind(F.expr(TYPED), body, F.length(body)).alias("kind"))


@query("""SELECT conv_id, turn, i AS item_index, CASE WHEN i = 0 THEN 'own' ELSE 'post ' || turn END AS caption, CASE WHEN i = 1 AND turn % 2 = 0 THEN 'x' ELSE 'a,' || role END AS tags, CASE WHEN turn % 3 = 0 THEN 'f/' || conv_id ELSE 'p/' || role END AS folder, CASE WHEN i = 1 THEN 'mp4' ELSE 'png' END AS ext, CASE WHEN i = 1 THEN 'video/mp4' ELSE 'image/png' END AS mime_type
    FROM conversations, (SELECT CAST(unnest(range(2)) AS INTEGER) AS i)""")
def manifests_unfolded(spark, sf):
    one = F.struct(F.concat(F.lit("u"), "turn").alias("url"), F.lit("image").alias("media_type"), F.lit("image/png").alias("mime_type"), F.lit("own").alias("caption"), F.array().cast("array<string>").alias("tags"))
    two = F.struct(F.lit("v").alias("url"), F.lit("video").alias("media_type"), F.lit(None).cast("string").alias("mime_type"), F.lit(None).cast("string").alias("caption"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    parts = [F.lit("p").alias("platform"), F.col("role").alias("author"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("f/"), "conv_id")).alias("folder"), F.concat(F.lit("post "), "turn").alias("caption"), F.array(F.lit("a"), "role").alias("tags"), F.array(one, two).alias("items")]
    out = uploads.manifest_items(table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct(*parts)).alias("body")))
    return out.select("conv_id", "turn", "item_index", "caption", F.array_join("tags", ",").alias("tags"), "folder", "ext", "mime_type")


INFO = """'{"streams":[{"width":0,"height":0},{"width":' || CAST(p_size * 10 AS STRING) || ',"height":720' || CASE p_partkey % 3 WHEN 1 THEN ',"tags":{"rotate":"90"}' WHEN 2 THEN ',"side_data_list":[{"rotation":-90}]' ELSE '' END
|| '}],"format":{"duration":"' || CASE WHEN p_partkey % 5 = 0 THEN 'N/A' ELSE CAST(p_size AS STRING) || '.5' END || '","tags":{"' || CASE WHEN p_partkey % 2 = 0 THEN 'creation_time' ELSE 'com.apple.quicktime.creationdate' END || '":"2024"}}}'"""


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size * 10 ELSE 720 END AS width, CASE WHEN p_partkey % 3 = 0 THEN 720 ELSE p_size * 10 END AS height, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size + 0.5 AS DOUBLE) END AS duration, '2024' AS created FROM part")
def media_probed(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), uploads.probe(F.expr(INFO)).alias("p")).select("id", "p.*")


POSTS = """'{"edges":[{"node":{"shortcode":"s' || CAST(conv_id AS STRING) || '","display_url":"d' || CAST(turn AS STRING) || '"' || CASE WHEN turn % 2 = 1 THEN ',"children":[{"display_url":"c1"},{"display_url":"c2","video_url":"v' || CAST(turn AS STRING) || '","is_video":true},{"display_url":"c3","is_video":true}]' ELSE '' END || '}},{"node":{"shortcode":"none"}}]}'"""


@query("SELECT conv_id, turn, 's' || conv_id AS shortcode, i AS item_index, turn % 2 = 1 AND i > 0 AS is_video, CASE WHEN turn % 2 = 0 THEN 'd' || turn ELSE CASE i WHEN 0 THEN 'c1' WHEN 1 THEN 'v' || turn ELSE 'c3' END END AS url FROM conversations, (SELECT CAST(unnest(range(3)) AS INTEGER) AS i) WHERE turn % 2 = 1 OR i = 0")
def posts_unfolded(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(POSTS).alias("body"))
    return social.post_nodes(rows).select("conv_id", "turn", "shortcode", "item_index", "is_video", "url")


LISTING = """CASE event_id % 6 WHEN 0 THEN '{"secure_media":{"reddit_video":{"fallback_url":"v' || CAST(user_id AS STRING) || '"}},"preview":{"images":[{"source":{"url":"i"}}]}}' WHEN 1 THEN '{"preview":{"images":[{"source":{"url":"i' || CAST(user_id AS STRING) || '"}}]},"url":"https://x.org/a.png"}'
    WHEN 2 THEN '{"url":"https://x.org/' || CAST(user_id AS STRING) || '.PNG"}' WHEN 3 THEN '{"secure_media":{"oembed":{"provider_name":"P"}},"url":"https://e.org/' || CAST(user_id AS STRING) || '"}' WHEN 4 THEN '{"media_metadata":{"b' || CAST(user_id AS STRING) || '":{},"a":{}}}' ELSE '{"url":"https://x.org/page"}' END"""


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'video:v' || user_id WHEN 1 THEN 'image:i' || user_id WHEN 2 THEN 'link:https://x.org/' || user_id || '.PNG' WHEN 3 THEN 'embed:https://e.org/' || user_id WHEN 4 THEN 'gallery:a,gallery:b' || user_id END AS media FROM events")
def listings_read(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(social.listing_media(F.expr(LISTING)), ",").alias("media"))


CLIP = """'{"urls":{' || CASE WHEN event_id % 2 = 0 THEN '"hd":"h' || CAST(user_id AS STRING) || '",' ELSE '' END || '"sd":"s"' || CASE WHEN event_id % 3 = 0 THEN ',"poster":"p"' ELSE '' END || ',"thumbnail":"t"},"tags":["' || event_type || '","b"]' || CASE WHEN event_id % 5 = 0 THEN ',"niches":["b"]' ELSE '' END || '}'"""


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'h' || user_id ELSE 's' END AS url, CASE WHEN event_id % 3 = 0 THEN 'p' ELSE 't' END AS poster, event_type || ',b' || CASE WHEN event_id % 5 = 0 THEN ',b' ELSE '' END AS tags FROM events")
def clips_read(spark, sf):
    c = table(spark, sf, "events").select("event_id", social.clip_media(F.expr(CLIP)).alias("c"))
    return c.select("event_id", "c.url", "c.poster", F.array_join("c.tags", ",").alias("tags"))


@query("SELECT lower(source) AS source, count(DISTINCT t) AS n, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT source, unnest([lang, 'l-' || lang]) AS t FROM documents) GROUP BY 1")
def tags_of_crawl(spark, sf):
    """The set of tags over the posts of a crawl."""
    tags = table(spark, sf, "documents").select(F.lower("source").alias("source"), F.explode(F.array("lang", F.concat(F.lit("l-"), "lang"))).alias("t"))
    sets = tags.groupBy("source").agg(F.collect_set("t").alias("s"))
    return sets.select("source", F.size("s").cast("long").alias("n"), F.array_join(F.array_sort("s"), ",").alias("tags"))


LINES = """'#EXTM3U' || chr(10) || '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",URI="aud' || CAST(p_partkey AS STRING) || '.m3u8"' || chr(10) || '#EXT-X-STREAM-INF:BANDWIDTH=' || CAST(p_size * 1000 AS STRING) || ',CODECS="avc1,mp4a",RESOLUTION=' || CAST(p_size * 16 AS STRING) || 'x' || CAST(p_size * 9 AS STRING) || ',AUDIO="a"' || chr(10) || 'hi.m3u8' || chr(10)
|| '#EXT-X-STREAM-INF:BANDWIDTH=900,RESOLUTION=640x360' || chr(10) || chr(10) || '# note' || chr(10) || ' ../lo' || CAST(p_partkey AS STRING) || '.m3u8' || chr(10) || '#EXT-X-STREAM-INF:BANDWIDTH=x' || chr(10)"""


@query("""SELECT p_partkey AS id, 'https://ex.org/s/' || CAST(p_partkey AS VARCHAR) || '/hi.m3u8' AS url, CAST(p_size * 1000 AS BIGINT) AS bandwidth, p_size * 16 AS width, p_size * 9 AS height, 'https://ex.org/s/' || p_partkey || '/aud' || p_partkey || '.m3u8' AS audio_url FROM part
    UNION ALL SELECT p_partkey, 'https://ex.org/s/lo' || p_partkey || '.m3u8', 900, 640, 360, NULL FROM part""")
def playlists_read(spark, sf):
    base = F.concat(F.lit("https://ex.org/s/"), F.col("p_partkey").cast("string"), F.lit("/master.m3u8"))
    # A playlist is much work and a part few bytes: parts are dealt to all tasks, where by bytes alone one task would have them.
    parts = table(spark, sf, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return playlists.variants(parts.select(F.col("p_partkey").alias("id"), base.alias("base"), F.expr(LINES).alias("body")), "id", "base", "body")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE n_chars END AS size FROM documents")
def range_sizes(spark, sf):
    i, n = F.col("doc_id") % 3, F.col("n_chars").cast("string")
    whole = F.when(i == 0, F.concat(F.lit("bytes 0-9/"), n)).when(i == 2, F.lit("bytes 0-9/*"))
    return table(spark, sf, "documents").select("doc_id", uploads.range_size(whole, F.when(i == 1, n).when(i == 2, F.lit("none"))).alias("size"))
