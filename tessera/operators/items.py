"""Media items: junk and size rules, variants, grouping, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.media import quality_label
from tessera.functions.text import first_wins
from tessera.functions.urls import contains_any

# Marks of URLs and types that are no media.
SEGMENT_ENDS = (".ts", ".m4s", ".aac", ".svg")
SEGMENT_PARTS = ("/segment_", "/segment-", "/frag_", "/fragment-", "-seg-", "/range/")
ADS = ("doubleclick.net", "googlesyndication.com", "adnxs.com", "/pagead/", "trafficjunky", "exoclick", "scorecardresearch.com")
TYPES_IN_URLS = ("image/svg+xml",)
CODE_ENDS = (".js", ".css")
CODE_PARTS = (".js?", ".css?", ".webmanifest", ".json")
CHROME = (
    "/avatar_", "/favicon", "thumb_", "-thumb.", "_thumb.", "thumbnail_", "badge_", "emoji/", "pixel.gif", "1x1.", "/gsi/client", "accounts.google.com",
)
BAD_MIMES = ("javascript", "json", "xml", "html")
PLAYLIST_MIMES = ("application/x-mpegurl", "application/vnd.apple.mpegurl")


def _ends(text: Column, ends: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | text.endswith(e)
    return out


def is_junk(url: Column, mime: Column, media_type: Column) -> Column:
    """No web address, no media type, a stream segment, an advert, code or page furniture. DASH manifests are junk too, as their type contains xml."""
    low, kind = F.lower(url), F.lower(mime)
    path = F.split_part(low, F.lit("?"), F.lit(1))
    web = F.lower(F.btrim(url)).rlike("^https?://")
    bad = kind.startswith("text/") | contains_any(kind, BAD_MIMES) | ((kind == "application/octet-stream") & (media_type == "image"))
    good = kind.startswith("image/") | kind.startswith("video/") | kind.startswith("audio/") | kind.isin(*PLAYLIST_MIMES)
    segment = _ends(path, SEGMENT_ENDS) | contains_any(path, SEGMENT_PARTS) | contains_any(low, ADS + TYPES_IN_URLS)
    return ~web | bad | ~good | segment | _ends(low, CODE_ENDS) | contains_any(low, CODE_PARTS) | contains_any(low, CHROME)


def has_valid_size(media_type: Column, width: Column, height: Column, min_side: int = 200, min_area: int = 60_000, min_ratio: float = 0.15, max_ratio: float = 6.5) -> Column:
    """Images must be large and not too long or thin; videos 120 by 120. Unknown sizes pass."""
    known = width.isNotNull() & height.isNotNull()
    ratio = width / F.nullif(height, F.lit(0))
    image = (width >= min_side) & (height >= min_side) & (width.cast("long") * height >= min_area) & ratio.between(min_ratio, max_ratio)
    return F.when(~known, True).when(media_type == "video", (width >= 120) & (height >= 120)).otherwise(F.coalesce(image, F.lit(False)))


def fingerprint(url: Column) -> Column:
    """The URL without query and size suffix: _123, _..w or _..p, else -123 or -scaled..., before the extension."""
    base = F.split_part(url, F.lit("?"), F.lit(1))
    path, ext = F.regexp_extract(base, r"(?s)^(.*)\.([^.]*)$", 1), F.regexp_extract(base, r"(?s)^(.*)\.([^.]*)$", 2)
    last = F.regexp_extract(path, r"(?s)^(.*)_([^_]*)$", 2)
    under = path.contains("_") & (last.rlike("^[0-9]*$") | last.rlike("(?s)(w|p)$"))
    tail = F.regexp_extract(path, r"(?s)^(.*)-([^-]*)$", 2)
    dash = path.contains("-") & (tail.rlike("^[0-9]*$") | tail.startswith("scaled"))
    short = F.when(under, F.regexp_extract(path, r"(?s)^(.*)_([^_]*)$", 1)).when(dash, F.regexp_extract(path, r"(?s)^(.*)-([^-]*)$", 1)).otherwise(path)
    return F.when(base.contains("."), F.concat(short, F.lit("."), ext)).otherwise(base)


def group_key(url: Column, media_type: Column) -> Column:
    """Images by fingerprint, playlists by their folder; other videos stand alone."""
    folder = F.when(url.contains("/"), F.regexp_extract(url, r"(?s)^(.*)/[^/]*$", 1)).otherwise(url)
    return F.when(media_type == "image", fingerprint(url)).when(F.lower(url).contains(".m3u8"), folder).otherwise(url)


def _area(width: Column, height: Column) -> Column:
    return F.coalesce(width.cast("long") * height, F.lit(0).cast("long"))


def merged_images(items: DataFrame, keys: list[str]) -> DataFrame:
    """One item of each group of images: the largest by area, size and then last position, with all variants, smallest first.

    items: keys, pos, url, width, height, size. Adds variants (array of url, width, height) and n_merged.
    """
    area, size = _area(F.col("width"), F.col("height")), F.coalesce("size", F.lit(0).cast("long"))
    rows = items.withColumn("_g", fingerprint(F.col("url"))).withColumn("_o", F.struct(area.alias("area"), size.alias("size"), F.col("pos").alias("pos")))
    groups = rows.groupBy(*keys, "_g").agg(
        F.max_by(F.struct("url", "width", "height"), "_o").alias("best"), F.array_sort(F.collect_list(F.struct("_o", "url", "width", "height"))).alias("v"), F.count("*").alias("n_merged")
    )
    variants = first_wins(F.transform("v", lambda x: F.struct(x["url"].alias("url"), x["width"].alias("width"), x["height"].alias("height"))), lambda x: x["url"])
    return groups.select(*keys, "best.url", "best.width", "best.height", variants.alias("variants"), "n_merged")


def merged_videos(items: DataFrame, keys: list[str]) -> DataFrame:
    """One item of each group of videos: the best by area, then by the quality in its URL, then last; audio streams only lend their track.

    items: keys, pos, url, width, height, audio_url. Adds variants (array of url, label).
    """
    url = F.col("url")
    low = F.lower(url)
    rank = F.when(url.contains("4k") | url.contains("2160"), 4000).when(url.contains("1080"), 2000).when(url.contains("720"), 1000).when(url.contains("480"), 500).otherwise(0)
    rows = items.withColumn("_g", group_key(url, F.lit("video")))
    rows = rows.withColumn("_o", F.struct(_area(F.col("width"), F.col("height")).alias("area"), rank.alias("rank"), F.col("pos").alias("pos")))
    audio = F.when(low.contains("audio") | F.col("audio_url").isNotNull(), F.coalesce("audio_url", url))
    main = ~low.contains("audio_")
    groups = rows.groupBy(*keys, "_g").agg(
        F.max_by(F.when(main, F.struct("url", "width", "height", "audio_url")), F.when(main, F.col("_o"))).alias("best"),
        F.min_by(audio, F.when(audio.isNotNull(), F.col("pos"))).alias("track"),
        F.array_sort(F.collect_list(F.struct("pos", "url", quality_label(url).alias("label")))).alias("v"),
    )
    variants = first_wins(F.transform("v", lambda x: F.struct(x["url"].alias("url"), x["label"].alias("label"))), lambda x: x["url"])
    out = groups.where("best is not null")
    return out.select(*keys, "best.url", "best.width", "best.height", F.coalesce("best.audio_url", "track").alias("audio_url"), variants.alias("variants"))


def with_variants(items: DataFrame, variants: DataFrame, item_id: str) -> DataFrame:
    """Items with their variants as an array, widest first, unknown widths last; empty without variants."""
    entry = F.struct((-F.coalesce("width", F.lit(-1))).alias("o"), "url", "width", "height", "label")
    lists = variants.groupBy(item_id).agg(F.array_sort(F.collect_list(entry)).alias("_v"))
    out = items.join(lists, item_id, "left")
    bare = F.transform("_v", lambda x: F.struct(x["url"].alias("url"), x["width"].alias("width"), x["height"].alias("height"), x["label"].alias("label")))
    return out.withColumn("variants", F.coalesce(bare, F.array().cast("array<struct<url:string,width:int,height:int,label:string>>"))).drop("_v")


def inherited(items: DataFrame, posts: DataFrame, post_id: str, names: list[str], tags_by_size: bool = False) -> DataFrame:
    """Items with what they lack taken from their post. Tags are taken only if null, or with tags_by_size if empty too."""
    p = posts.select(post_id, *[F.col(n).alias(f"_p_{n}") for n in names])
    out = items.join(p, post_id, "left")
    for n in names:
        own = F.when(F.size(n) > 0, F.col(n)) if tags_by_size and n == "tags" else F.col(n)
        out = out.withColumn(n, F.coalesce(own, f"_p_{n}"))
    return out.drop(*[f"_p_{n}" for n in names])


def indexed(items: DataFrame, post_id: str, order: str) -> DataFrame:
    """Each item's index within its post from 0, and the post's number of items. A post's items are few."""
    w = Window.partitionBy(post_id)
    return items.withColumn("item_index", F.row_number().over(w.orderBy(order)) - 1).withColumn("total", F.count("*").over(w))
