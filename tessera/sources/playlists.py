"""HLS master playlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.urls import resolved


def attribute(line: Column, name: str) -> Column:
    """The value of an attribute in a tag line, quoted or bare."""
    quoted = F.regexp_extract(line, rf'(?:[:,])\s*{name}="([^"]*)"', 1)
    bare = F.regexp_extract(line, rf'(?:[:,])\s*{name}=([^",]+)', 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(F.btrim(bare), F.lit("")))


def variants(playlists: DataFrame, id_: str, url: str, body: str) -> DataFrame:
    """Variants of master playlists: id, url, bandwidth, width, height, audio_url.

    A variant's address is the first line after its tag that is no tag. Lines stay in the playlist's row, audio
    groups are looked up there, and nothing is shuffled.
    """
    lines = F.filter(F.transform(F.split(F.col(body), "\n"), F.btrim), lambda x: x != "")
    rows = playlists.select(id_, F.col(url).alias("_base"), lines.alias("_lines"))
    # Outer: from a plain explode Spark infers a filter that splits every body again; null lines go with the next filter.
    at = rows.select(id_, "_base", "_lines", F.posexplode_outer("_lines").alias("_i", "_line"))
    audio = F.filter("_lines", lambda x: x.startswith("#EXT-X-MEDIA:") & (attribute(x, "TYPE") == "AUDIO") & attribute(x, "URI").isNotNull())
    stream = at.where(F.col("_line").startswith("#EXT-X-STREAM-INF"))
    target = F.get(F.filter(F.slice("_lines", F.col("_i") + 2, F.size("_lines")), lambda x: ~x.startswith("#")), F.lit(0))
    group = attribute(F.col("_line"), "AUDIO")
    track = F.get(F.reverse(F.filter(audio, lambda x: attribute(x, "GROUP-ID") == group)), F.lit(0))
    size = attribute(F.col("_line"), "RESOLUTION")
    found = F.struct(
        resolved(F.col("_base"), target).alias("url"),
        F.coalesce(attribute(F.col("_line"), "BANDWIDTH").try_cast("long"), F.lit(0).cast("long")).alias("bandwidth"),
        F.split_part(size, F.lit("x"), F.lit(1)).try_cast("int").alias("width"),
        F.split_part(size, F.lit("x"), F.lit(2)).try_cast("int").alias("height"),
        resolved(F.col("_base"), attribute(track, "URI")).alias("audio_url"),
    )
    # As a row of its own the variant is made once: a filter on its address isn't moved ahead and doesn't make that again.
    out = stream.select(id_, F.explode_outer(F.array(found)).alias("_v")).where("_v.url is not null")
    return out.select(id_, "_v.*")
