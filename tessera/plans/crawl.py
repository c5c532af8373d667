"""Queries of what pages hold, over the whole table of pages.

The pages of the table are prose with a title and a few anchors. The view adds to each the other markup that
crawled pages have, made from the page's number, and all queries read it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import media, text, urls
from tessera.operators import items
from tessera.session import table
from tessera.sources import pages, social

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


P = "CAST(page_id AS STRING)"
CDN = "https://cdn.example.org"
#: A page's markup as an expression that both engines read.
MARKUP = f"""html
|| '<a href="/post/' || {P} || '">a</a><a href="../posts/x' || {P} || '?v=../1">b</a><a href="./item/./' || {P} || '">c</a><a href="../../../../thread/' || {P} || '">d</a>'
|| '<a href="https://other.example.org/post/' || {P} || '">e</a><a href="/login/post/1">f</a><a href="/post/' || {P} || '">again</a><a href="list/">g</a>'
|| '<a href="/tag/Sea">t</a><a class="t" href="/tags/t' || CAST(page_id % 7 AS STRING) || '">u</a><a href="/tag/sea">v</a>'
|| '<img src="/i/pic' || {P} || '_640w.jpg"><img data-src="pics/' || {P} || '-scaled.png?x=1"><img src="/favicon.png"><img srcset="/i/pic' || {P} || '_320w.jpg 320w, ../i/big' || {P} || '_640w.webp 640w">'
|| (CASE page_id % 3 WHEN 0 THEN '<video poster="/v/movie' || {P} || '.jpg" src="{CDN}/v/movie' || {P} || '_1080p.mp4"></video>'
    WHEN 1 THEN '<script>["{CDN}/h/' || {P} || '/720.m3u8","{CDN}/h/' || {P} || '/1080.m3u8","{CDN}/h/' || {P} || '/audio_1.m3u8","{CDN}/seg/segment_1.mp4"]</script>' ELSE '' END)
|| (CASE WHEN page_id % 2 = 0 THEN '<meta property="og:image" content="//cdn.example.org/o' || {P} || '.png"><meta name="description" content=" About ' || {P} || ' ">' ELSE '<time datetime="2024-01-02T00:00:00Z">' END)
|| (CASE WHEN page_id % 4 = 0 THEN '<script>{{"thumbnail": "https:' || chr(92) || '/' || chr(92) || '/cdn.example.org' || chr(92) || '/t' || {P} || '.webp", "poster": "none"}}</script>' ELSE '' END)
|| (CASE page_id % 6 WHEN 0 THEN '<iframe src="https://player.vimeo.com/video/' || {P} || '"></iframe>' WHEN 3 THEN '<iframe data-src="//www.youtube.com/embed/' || {P} || '"></iframe><iframe src="/own"></iframe>' ELSE '' END)
|| (CASE page_id % 5 WHEN 0 THEN '<link rel="next" href="/list?page=' || {P} || '">' WHEN 1 THEN '<link href="../n' || {P} || '" rel="next">' WHEN 2 THEN '<a class="btn next big" href="next/' || {P} || '">n</a>'
    WHEN 3 THEN '<a href="?page=3">3</a>' ELSE '' END)"""
RICH = f"(SELECT page_id, url, {MARKUP} AS html FROM pages)"


def rich_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.expr(MARKUP).alias("html"))


def every(name: str, group: int = 1, order: int = 0) -> str:
    """All matches of a named pattern, in their order."""
    found = f"regexp_extract_all(html, {quote(urls.PATTERNS[name])}, {group})"
    return f"(SELECT page_id, url, {order} AS src, unnest({found}) AS t, unnest(range(len({found}))) AS i FROM {RICH})"


NORMAL = r"""trim(replace(replace(replace(replace(t, '\/', '/'), '&amp;', '&'), '&quot;', ''), '&#38;', '&'), '"''\ ')"""
PLAIN = """CASE WHEN regexp_matches(n, '^https?://') THEN n WHEN starts_with(n, '//') THEN CASE WHEN starts_with(url, 'http://') THEN 'http:' ELSE 'https:' END || n
    WHEN starts_with(n, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || n WHEN starts_with(n, '?') THEN regexp_replace(url, '[?#].*$', '') || n
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || n END"""
STEPS = "string_split(substr(regexp_extract(p, '^[a-z]+://[^/?#]*([^?#]*)', 1), 2), '/')"
UNDOTTED = f"""regexp_extract(p, '^([a-z]+://[^/?#]*)', 1) || list_reduce(list_concat([''], {STEPS}), lambda a, s: CASE s WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || s END)
    || CASE WHEN {STEPS}[-1] IN ('.', '..') THEN '/' ELSE '' END || regexp_extract(p, '^[^?#]*(.*)$', 1)"""


def absolute(rows: str) -> str:
    """rows with page_id, url and a target t: adds its absolute address u."""
    return f"(SELECT *, {UNDOTTED} AS u FROM (SELECT *, {PLAIN} AS p FROM (SELECT *, {NORMAL} AS n FROM {rows})))"


HOST = "lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
DENIED = " OR ".join(f"contains(lower(u), {quote(x)})" for x in urls.NOT_POSTS)
PLAYED = " OR ".join(f"contains(lower(u), {quote(x)})" for x in urls.PLAYERS)


@query(f"SELECT page_id, CAST(i AS INTEGER) AS nth, u AS link FROM {absolute(every('anchor'))}")
def crawl_links(spark, sf):
    links = F.posexplode(urls.resolved_all(F.col("url"), urls.found_all(F.col("html"), "anchor"))).alias("nth", "link")
    return rich_pages(spark, sf).select("page_id", links)


@query(f"SELECT DISTINCT page_id, u AS link FROM {absolute(every('anchor'))} WHERE {HOST.format(u='u')} = {HOST.format(u='url')} AND u <> url AND rtrim(u, '/') <> url AND NOT ({DENIED}) AND regexp_matches(u, {quote(urls.PATTERNS['post_path'])})")
def crawl_post_links(spark, sf):
    return rich_pages(spark, sf).select("page_id", F.explode(urls.post_links(F.col("url"), F.col("html"))).alias("link"))


@query(f"SELECT page_id, lower(trim(t)) AS tag FROM {every('tag')} GROUP BY ALL")
def crawl_tags(spark, sf):
    return rich_pages(spark, sf).select("page_id", F.explode(urls.tags(F.col("html"))).alias("tag"))


@query(f"SELECT DISTINCT page_id, u AS player FROM {absolute(every('iframe'))} WHERE {PLAYED}")
def crawl_players(spark, sf):
    return rich_pages(spark, sf).select("page_id", F.explode(urls.players(F.col("url"), F.col("html"))).alias("player"))


POSTER_ROWS = f"(SELECT * FROM {every('video_poster', order=1)} UNION ALL SELECT * FROM {every('meta_poster', order=2)} UNION ALL SELECT * FROM {every('json_poster', order=3)} WHERE regexp_matches(trim(replace(t, '\\/', '/')), '^(http|/)'))"
POSTERS = f"(SELECT page_id, u, min(src * 1000 + i) AS o FROM {absolute(POSTER_ROWS)} GROUP BY page_id, u)"


@query(f"SELECT page_id, u AS poster FROM {POSTERS}")
def crawl_posters(spark, sf):
    return rich_pages(spark, sf).select("page_id", F.explode(urls.posters(F.col("url"), F.col("html"))).alias("poster"))


NEXT_ROWS = " UNION ALL ".join(f"SELECT * FROM {every(n, order=k)} WHERE i = 0" for k, n in enumerate(("link_next", "link_next_reversed", "anchor_next", "anchor_class_next")))
NUMBER = r"'[?&](page|p|pg)=(\d+)(?:&|#|$)'"
COUNTED = f"""(SELECT page_id, CASE WHEN contains(html, 'page=' || v) OR contains(html, 'p=' || v) THEN regexp_replace(url, '[?#].*$', '') || '?' || array_to_string(list_concat(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND split_part(x, '=', 1) <> k), [k || '=' || v]), '&') END AS counted FROM (SELECT *, regexp_extract(url, {NUMBER}, 1) AS k, CAST(CAST(nullif(regexp_extract(url, {NUMBER}, 2), '') AS INTEGER) + 1 AS VARCHAR) AS v FROM {RICH}))"""


@query(f"SELECT page_id, coalesce(named, counted) AS next_url FROM {COUNTED} LEFT JOIN (SELECT page_id, arg_min(u, src) AS named FROM {absolute('(' + NEXT_ROWS + ')')} WHERE src < 2 OR u <> url GROUP BY page_id) USING (page_id)")
def crawl_next(spark, sf):
    return rich_pages(spark, sf).select("page_id", urls.next_page(F.col("url"), F.col("html")).alias("next_url"))


def first(name: str) -> str:
    return f"nullif(regexp_extract(html, {quote(urls.PATTERNS[name])}, 1), '')"


@query(f"""SELECT page_id, trim({first('title')}) AS title, trim({first('time')}) AS published, trim({first('description')}) AS description, coalesce(n, 0)::INTEGER AS n_tags, coalesce(m, 0)::INTEGER AS n_players FROM {RICH}
    LEFT JOIN (SELECT page_id, count(DISTINCT lower(trim(t))) AS n FROM {every('tag')} GROUP BY page_id) USING (page_id) LEFT JOIN (SELECT page_id, count(DISTINCT u) AS m FROM {absolute(every('iframe'))} WHERE {PLAYED} GROUP BY page_id) USING (page_id)""")
def crawl_metadata(spark, sf):
    out = pages.metadata(rich_pages(spark, sf))
    return out.select("page_id", "title", "published", "description", F.size("tags").alias("n_tags"), F.size("players").alias("n_players"))


SRCSET = f"(SELECT * FROM (SELECT page_id, url, 3 AS src, split_part(trim(unnest(string_split(t, ','))), ' ', 1) AS t, i * 100 + unnest(range(len(string_split(t, ',')))) AS i FROM {every('srcset')}) WHERE t <> '')"


@query(f"SELECT page_id, t AS u FROM {SRCSET}")
def crawl_srcset(spark, sf):
    return rich_pages(spark, sf).select("page_id", F.explode(urls.srcset_urls(F.col("html"))).alias("u"))


IS_IMAGE = r"(NOT starts_with(lower(u), 'data:') AND (regexp_matches(split_part(lower(u), '?', 1), '\.(jpg|jpeg|png|pnj|webp|gif|avif)$') OR contains(lower(u), 'tumblr.com/') OR contains(lower(u), '/thumbnail/')))"
IMAGE_MIME = "CASE WHEN regexp_matches(lower(url), '\\.pn[gj]') THEN 'image/png' WHEN contains(lower(url), '.webp') THEN 'image/webp' WHEN contains(lower(url), '.gif') THEN 'image/gif' WHEN contains(lower(url), '.avif') THEN 'image/avif' ELSE 'image/jpeg' END"
VIDEO_MIME = "CASE WHEN contains(lower(url), '.m3u8') THEN 'application/x-mpegURL' WHEN contains(lower(url), '.webm') AND NOT contains(lower(url), '.webmanifest') THEN 'video/webm' ELSE 'video/mp4' END"
VIDEOS = f"(SELECT page_id, u AS url, min(i) AS o FROM {absolute(every('video', 0))} GROUP BY page_id, u)"
IMAGES = f"""(SELECT page_id, u AS url, min(src * 100000 + i) AS o FROM (SELECT page_id, src, i, u FROM {absolute(every('image', 0, 1))} UNION ALL SELECT page_id, src, i, u FROM {absolute(every('source', 1, 2))} WHERE {IS_IMAGE}
    UNION ALL SELECT page_id, src, i, u FROM {absolute(SRCSET)}) GROUP BY page_id, u)"""
STEM = r"regexp_replace(split_part(string_split(split_part(url, '?', 1), '/')[-1], '.', 1), '[0-9p_]+$', '')"
NTH = "CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INTEGER) AS pos"
ITEMS = f"""(SELECT page_id, pos, 'video' AS media_type, url, {VIDEO_MIME} AS mime_type, coalesce(CASE WHEN length({STEM}) >= 4 THEN (SELECT arg_min(u, p.o) FROM {POSTERS} p WHERE p.page_id = v.page_id AND contains(u, {STEM})) END,
    (SELECT arg_min(u, p.o) FROM {POSTERS} p WHERE p.page_id = v.page_id)) AS poster FROM (SELECT *, {NTH} FROM {VIDEOS}) v
    UNION ALL SELECT page_id, pos, 'image', url, {IMAGE_MIME}, NULL FROM (SELECT *, {NTH} FROM {IMAGES}))"""


@query(f"SELECT * FROM {ITEMS}")
def crawl_items(spark, sf):
    return pages.items(rich_pages(spark, sf), "page_id")


# --- items: junk, sizes, groups ---

BAD = "starts_with(lower(mime_type), 'text/') OR " + " OR ".join(f"contains(lower(mime_type), {quote(x)})" for x in items.BAD_MIMES)
GOOD = "regexp_matches(lower(mime_type), '^(image|video|audio)/') OR lower(mime_type) IN (" + ", ".join(map(quote, items.PLAYLIST_MIMES)) + ")"
BARE = "split_part(lower(url), '?', 1)"
JUNK = f"""(NOT regexp_matches(lower(trim(url)), '^https?://') OR {BAD} OR NOT ({GOOD}) OR {' OR '.join(f'ends_with({BARE}, {quote(x)})' for x in items.SEGMENT_ENDS)} OR {' OR '.join(f'contains({BARE}, {quote(x)})' for x in items.SEGMENT_PARTS)}
    OR {' OR '.join(f'contains(lower(url), {quote(x)})' for x in items.ADS + items.TYPES_IN_URLS + items.CODE_PARTS + items.CHROME)} OR {' OR '.join(f'ends_with(lower(url), {quote(x)})' for x in items.CODE_ENDS)})"""


@query(f"SELECT page_id, url, media_type, {JUNK} AS junk FROM {ITEMS}")
def crawl_junk(spark, sf):
    return crawl_items(spark, sf).select("page_id", "url", "media_type", items.is_junk(F.col("url"), F.col("mime_type"), F.col("media_type")).alias("junk"))


#: Sizes as numbers of the page and the place; every seventh is unknown.
WIDTH, HEIGHT = "(page_id * 37 + pos * 211) % 1500", "(page_id * 53 + pos * 97) % 1100"
SIZED = f"(SELECT *, CAST(CASE WHEN page_id % 7 <> 0 THEN {WIDTH} END AS INTEGER) AS width, CAST(CASE WHEN page_id % 7 <> 0 THEN {HEIGHT} END AS INTEGER) AS height FROM {ITEMS})"


def _sized(spark, sf):
    known = lambda e: F.when(F.col("page_id") % 7 != 0, F.expr(e)).cast("int")
    return crawl_items(spark, sf).withColumns({"width": known(WIDTH), "height": known(HEIGHT)})


@query(f"""SELECT page_id, url, CASE WHEN width IS NULL THEN true WHEN media_type = 'video' THEN width >= 120 AND height >= 120
    ELSE width >= 200 AND height >= 200 AND width * height >= 60000 AND width / height BETWEEN 0.15 AND 6.5 END AS valid FROM {SIZED}""")
def crawl_sizes(spark, sf):
    return _sized(spark, sf).select("page_id", "url", items.has_valid_size(F.col("media_type"), F.col("width"), F.col("height")).alias("valid"))


TAIL = "regexp_extract(split_part(url, '?', 1), '^(.*)[.]([^.]*)$', 2)"
PRINT = f"""(SELECT *, CASE WHEN contains(b, '_') AND regexp_matches(regexp_extract(b, '^(.*)_([^_]*)$', 2), '^[0-9]*$|[wp]$') THEN regexp_extract(b, '^(.*)_([^_]*)$', 1)
    WHEN contains(b, '-') AND regexp_matches(regexp_extract(b, '^(.*)-([^-]*)$', 2), '^[0-9]*$|^scaled') THEN regexp_extract(b, '^(.*)-([^-]*)$', 1) ELSE b END || '.' || x AS g
    FROM (SELECT *, regexp_extract(split_part(url, '?', 1), '^(.*)[.]([^.]*)$', 1) AS b, {TAIL} AS x FROM {SIZED} WHERE media_type = 'image'))"""
AREA = "coalesce(CAST(width AS BIGINT) * height, 0)"


@query(f"SELECT page_id, arg_max(url, ({AREA}, pos)) AS url, count(*) AS n_merged, string_agg(url, ' ' ORDER BY {AREA}, pos) AS variants FROM {PRINT} GROUP BY page_id, g")
def crawl_image_groups(spark, sf):
    rows = _sized(spark, sf).where("media_type = 'image'").withColumn("size", F.lit(None).cast("long"))
    out = items.merged_images(rows, ["page_id"])
    return out.select("page_id", "url", "n_merged", F.array_join(F.transform("variants", lambda v: v["url"]), " ").alias("variants"))


QUALITY = "CASE WHEN contains(url, '4k') OR contains(url, '2160') THEN 4000 WHEN contains(url, '1080') THEN 2000 WHEN contains(url, '720') THEN 1000 WHEN contains(url, '480') THEN 500 ELSE 0 END"
LABEL = "CASE WHEN contains(lower(url), '4k') OR contains(lower(url), '2160') THEN '4K' WHEN contains(lower(url), '1080') THEN '1080p' WHEN contains(lower(url), '720') THEN '720p' WHEN contains(lower(url), '480') THEN '480p' WHEN contains(lower(url), 'audio') THEN 'Audio Track' END"
FOLDER = "CASE WHEN contains(lower(url), '.m3u8') THEN regexp_replace(url, '/[^/]*$', '') ELSE url END"


@query(f"""SELECT page_id, arg_max(url, (coalesce(CAST(width AS BIGINT) * height, 0), {QUALITY}, pos)) FILTER (WHERE NOT contains(lower(url), 'audio_')) AS url, arg_min(url, pos) FILTER (WHERE contains(lower(url), 'audio')) AS audio_url,
    string_agg({LABEL}, ',' ORDER BY pos) AS labels FROM {SIZED} WHERE media_type = 'video' GROUP BY page_id, {FOLDER} HAVING count(*) FILTER (WHERE NOT contains(lower(url), 'audio_')) > 0""".replace("string_agg(CASE", "coalesce(string_agg(CASE").replace("ORDER BY pos) AS labels", "ORDER BY pos), '') AS labels"))
def crawl_video_groups(spark, sf):
    rows = _sized(spark, sf).where("media_type = 'video'").withColumn("audio_url", F.lit(None).cast("string"))
    return items.merged_videos(rows, ["page_id"]).select("page_id", "url", "audio_url", F.array_join(F.transform("variants", lambda v: v["label"]), ",").alias("labels"))


# --- addresses ---

SOCIAL = f"""CASE page_id % 6 WHEN 0 THEN 'https://www.instagram.com/p/Ab_' || {P} || '-1/?x=1' WHEN 1 THEN 'https://instagram.com/some.name' || {P} || '/' WHEN 2 THEN 'https://www.Reddit.com/r/x' || {P}
    WHEN 3 THEN 'https://redgifs.com/watch/' || {P} WHEN 4 THEN 'https://h.example.org/reels/' || {P} || '/master.m3u8' ELSE url END"""


@query(f"SELECT page_id, nullif(regexp_extract(u, '/(?:p|reel|reels|tv)/([A-Za-z0-9_-]+)', 1), '') AS code, CASE WHEN f NOT IN ('', 'p', 'reel', 'reels', 'tv', 'stories', 'explore', 'accounts') THEN f END AS profile FROM (SELECT *, regexp_extract(u, '^https?://[^/]+/([A-Za-z0-9_.-]+)', 1) AS f FROM (SELECT page_id, {SOCIAL} AS u FROM pages))")
def crawl_url_ids(spark, sf):
    u = F.col("u")
    return table(spark, sf, "pages").select("page_id", F.expr(SOCIAL).alias("u")).select("page_id", text.shortcode(u).alias("code"), text.profile_name(u).alias("profile"))


@query(f"SELECT page_id, CASE WHEN contains(u, 'instagram.com') THEN 'instagram' WHEN contains(u, 'reddit.com') OR contains(u, 'redd.it') THEN 'reddit' WHEN contains(u, 'redgifs.com') THEN 'redgifs' WHEN contains(u, '.m3u8') THEN 'playlist' ELSE 'page' END AS extractor, v > 0 AS has_video, regexp_matches(u, '/(watch|video|embed|e|v)/|watch\\?') AND v = 0 AS browser FROM (SELECT page_id, lower({SOCIAL}) AS u FROM pages) JOIN (SELECT page_id, len(regexp_extract_all(html, {quote(urls.PATTERNS['video'])}, 0)) AS v FROM {RICH}) USING (page_id)")
def crawl_routes(spark, sf):
    rows = rich_pages(spark, sf).select("page_id", F.expr(SOCIAL).alias("u"), F.size(urls.found_all(F.col("html"), "video", 0)).alias("v"))
    return rows.select("page_id", social.route(F.col("u")).alias("extractor"), (F.col("v") > 0).alias("has_video"), pages.needs_browser(F.col("u"), F.col("v")).alias("browser"))


@query(f"SELECT page_id, (SELECT coalesce(arg_min(url, o) FILTER (WHERE contains(lower(url), 'master') AND contains(lower(url), '.m3u8')), arg_min(url, o) FILTER (WHERE contains(lower(url), '.m3u8')), arg_min(url, o)) FROM {VIDEOS} v WHERE v.page_id = p.page_id) AS stream FROM pages p")
def crawl_preferred_stream(spark, sf):
    return rich_pages(spark, sf).select("page_id", pages.preferred_stream(urls.media_urls(F.col("url"), F.col("html"), "video")).alias("stream"))


KIND = "string_split('JPG png mov gif heif xyz MP4 webm heic mkv', ' ')[page_id % 10 + 1]"


@query(f"""SELECT page_id, CASE WHEN e IN ('mp4', 'mov', 'm4v', 'webm', 'mkv', 'avi', 'gif') THEN CASE e WHEN 'gif' THEN 'image/gif' WHEN 'mov' THEN 'video/quicktime' WHEN 'webm' THEN 'video/webm' ELSE 'video/mp4' END
    ELSE CASE e WHEN 'heic' THEN 'image/heic' WHEN 'heif' THEN 'image/heic' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' ELSE 'image/jpeg' END END AS mime, CASE e WHEN 'heif' THEN 'heic' WHEN 'xyz' THEN 'jpg' WHEN 'mkv' THEN 'mp4' ELSE e END AS back
    FROM (SELECT page_id, lower({KIND}) AS e FROM pages)""")
def crawl_mimes(spark, sf):
    ext = F.element_at(F.split(F.lit("JPG png mov gif heif xyz MP4 webm heic mkv"), " "), (F.col("page_id") % 10 + 1).cast("int"))
    mime = media.mime_of_extension(ext)
    return table(spark, sf, "pages").select("page_id", mime.alias("mime"), media.extension_of_mime(F.concat(mime, F.lit("; q=1")), media.is_video_extension(ext)).alias("back"))
