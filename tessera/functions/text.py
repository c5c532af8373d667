"""Text expressions: hashtags, mentions of names, ids in URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_MARKS = r"!-/:-@\[-`{-~"


def first_wins(values: Column, key=None) -> Column:
    """Distinct values of an array, the first of each key staying in place."""
    key = key or (lambda x: x)
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def hashtags(text: Column) -> Column:
    """Tokens that start with #, without marks at both ends; one of each spelling regardless of case, the first."""
    marked = F.filter(F.split(text, r"\s+"), lambda w: w.startswith("#"))
    bare = F.transform(marked, lambda w: F.regexp_replace(w, f"^[{ASCII_MARKS}]+|[{ASCII_MARKS}]+$", ""))
    return first_wins(F.filter(bare, lambda w: w != ""), lambda w: F.lower(w))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shortcode(url: Column) -> Column:
    """The id that follows /p/, /reel/, /reels/ or /tv/."""
    return F.nullif(F.regexp_extract(url, r"/(?:p|reel|reels|tv)/([A-Za-z0-9_-]+)", 1), F.lit(""))


def profile_name(url: Column, reserved: tuple[str, ...] = ("p", "reel", "reels", "tv", "stories", "explore", "accounts")) -> Column:
    """The first segment of a URL's path if it isn't reserved."""
    name = F.nullif(F.regexp_extract(url, r"^https?://[^/]+/([A-Za-z0-9_.-]+)", 1), F.lit(""))
    return F.when(~name.isin(*reserved), name)


def site_name(host: Column) -> Column:
    """The second-level label of a host without www."""
    parts = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.element_at(parts, 1))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.btrim(text), F.lit(""))


def lenient_flag(text: Column) -> Column:
    """true/1, false/0, blank as null; anything else raises."""
    value = blank_to_null(text)
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), value)).cast("boolean")
    return F.when(value.isin("true", "1"), True).when(value.isin("false", "0"), False).when(value.isNull(), F.lit(None).cast("boolean")).otherwise(bad)


def pointer(text: Column, *paths: str) -> Column:
    """The first of several JSON paths that has a value."""
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])
