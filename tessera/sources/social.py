"""Social feeds as JSON: edges to items, the best source of a node, pages up to what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def post_nodes(pages: DataFrame, body: str = "body") -> DataFrame:
    """Items of paged posts: a carousel gives one for each child, else the post itself. Keeps the other columns, adds shortcode, caption, item_index, is_video, url."""
    child = "struct<display_url:string,video_url:string,is_video:boolean>"
    node = f"struct<shortcode:string,caption:string,taken_at:bigint,display_url:string,video_url:string,is_video:boolean,children:array<{child}>>"
    parsed = F.from_json(body, f"edges array<struct<node:{node}>>")
    rows = pages.select(*[c for c in pages.columns if c != body], F.explode(parsed["edges"]).alias("_e")).withColumn("_n", F.col("_e.node"))
    own = F.array(F.struct(F.col("_n.display_url").alias("display_url"), F.col("_n.video_url").alias("video_url"), F.col("_n.is_video").alias("is_video")))
    items = F.when(F.size("_n.children") > 0, F.col("_n.children")).otherwise(own)
    out = rows.withColumn("_x", items).select(*[c for c in pages.columns if c != body], "_n.shortcode", "_n.caption", F.posexplode("_x").alias("item_index", "_i"))
    url = F.when(F.col("_i.is_video") & F.col("_i.video_url").isNotNull(), F.col("_i.video_url")).otherwise(F.col("_i.display_url"))
    return out.select(*[c for c in out.columns if c != "_i"], F.coalesce("_i.is_video", F.lit(False)).alias("is_video"), url.alias("url")).where("url is not null")


def listing_media(post: Column) -> Column:
    """The media of a listing post (JSON), the first of: embed, native video, preview video, gallery, single image, direct link."""
    j = lambda p: F.get_json_object(post, p)
    link = j("$.url")
    gallery = F.transform(F.map_keys(F.from_json(j("$.media_metadata"), "map<string,string>")), lambda k: F.concat(F.lit("gallery:"), k))
    one = lambda kind, u: F.when(u.isNotNull(), F.array(F.concat(F.lit(kind + ":"), u)))
    return F.coalesce(
        one("embed", F.when(j("$.secure_media.oembed.provider_name").isNotNull(), link)),
        one("video", j("$.secure_media.reddit_video.fallback_url")),
        one("preview", j("$.preview.reddit_video_preview.fallback_url")),
        F.when(F.size(gallery) > 0, F.array_sort(gallery)),
        one("image", j("$.preview.images[0].source.url")),
        one("link", F.when(F.lower(link).rlike(r"\.(jpg|jpeg|png|gif|webp|mp4|webm)$"), link)),
    )


def clip_media(clip: Column) -> Column:
    """Of a clip (JSON): the HD or else SD stream, the poster or else thumbnail, and tags with niches, repeats kept."""
    j = lambda p: F.get_json_object(clip, p)
    names = lambda p: F.coalesce(F.from_json(j(p), "array<string>"), F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(j("$.urls.hd"), j("$.urls.sd")).alias("url"),
        F.coalesce(j("$.urls.poster"), j("$.urls.thumbnail")).alias("poster"),
        F.concat(names("$.tags"), names("$.niches")).alias("tags"),
    )


def until_known(posts: DataFrame, partition: list[str], order: list[Column], known: Column, budget: int | None = None) -> DataFrame:
    """Posts of each feed before the first known one, and at most budget of them: the rest is for the next crawl."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = posts.withColumn("_seen", F.sum(F.when(known, 1).otherwise(0)).over(w)).withColumn("_nth", F.row_number().over(w)).where("_seen = 0")
    return (out if budget is None else out.where(F.col("_nth") <= budget)).drop("_seen", "_nth")


def route(url: Column) -> Column:
    """Which extractor takes a URL."""
    low = F.lower(url)
    return (
        F.when(low.contains("instagram.com"), "instagram")
        .when(low.contains("reddit.com") | low.contains("redd.it"), "reddit")
        .when(low.contains("redgifs.com"), "redgifs")
        .when(low.contains(".m3u8"), "playlist")
        .otherwise("page")
    )
