"""Pages as a source: metadata and items of already fetched HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import media, urls
from tessera.functions.text import site_name


def metadata(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Title, publishing time, description, tags, players, next page and site of each page."""
    u, h = F.col(url), F.col(html)
    return pages.select(
        *[c for c in pages.columns if c != html],
        F.btrim(urls.found(h, "title")).alias("title"),
        F.btrim(urls.found(h, "time")).alias("published"),
        F.btrim(urls.found(h, "description")).alias("description"),
        urls.tags(h).alias("tags"),
        urls.players(u, h).alias("players"),
        urls.next_page(u, h).alias("next_url"),
        site_name(urls.host(u)).alias("site"),
    )


def items(pages: DataFrame, id_: str, url: str = "url", html: str = "html") -> DataFrame:
    """Media items of pages, a row each, the first of equal URLs: id, pos, media_type, url, mime_type, poster.

    Videos come from the page's text; images from the text, source attributes and srcset entries.
    """
    u, h = F.col(url), F.col(html)
    sources = F.filter(urls.resolved_all(u, urls.found_all(h, "source")), media.is_image_url)
    sets = urls.resolved_all(u, urls.srcset_urls(h))
    images = F.array_distinct(F.concat(urls.media_urls(u, h, "image"), sources, sets))
    both = pages.select(id_, urls.media_urls(u, h, "video").alias("v"), images.alias("i"), urls.posters(u, h).alias("posters"))
    kinds = [("video", "v", media.video_mime_of_url), ("image", "i", media.image_mime_of_url)]
    rows = [
        both.select(id_, "posters", F.posexplode(c).alias("pos", "url")).select(
            id_, "pos", F.lit(k).alias("media_type"), "url", mime(F.col("url")).alias("mime_type"), (urls.poster_of(F.col("url"), F.col("posters")) if k == "video" else F.lit(None)).cast("string").alias("poster")
        )
        for k, c, mime in kinds
    ]
    return rows[0].unionByName(rows[1])


def needs_browser(url: Column, n_videos: Column) -> Column:
    """Whether a page must be rendered: a watch-like URL on which no video was found."""
    return F.lower(url).rlike("/(watch|video|embed|e|v)/|watch\\?") & (F.coalesce(n_videos, F.lit(0)) == 0)


def preferred_stream(urls_seen: Column) -> Column:
    """Of URLs seen while a page plays: a master playlist, else any playlist, else the first video."""
    master = F.filter(urls_seen, lambda u: F.lower(u).contains("master") & F.lower(u).contains(".m3u8"))
    lists = F.filter(urls_seen, lambda u: F.lower(u).contains(".m3u8"))
    return F.coalesce(F.get(master, F.lit(0)), F.get(lists, F.lit(0)), F.get(F.filter(urls_seen, media.is_video_url), F.lit(0)))
