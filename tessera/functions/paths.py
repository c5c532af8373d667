"""Folder paths, file names and ids as paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(path: Column) -> Column:
    return F.btrim(F.btrim(path), F.lit("/"))


def segments(path: Column) -> Column:
    return F.split(path, "/")


def sanitized(folder: Column) -> Column:
    """Without empty and .. segments, each trimmed; root if nothing is left."""
    parts = F.filter(F.transform(segments(clean(folder)), lambda p: F.btrim(p)), lambda p: (p != "") & (p != ".."))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise(F.lit("root"))


def prefixes(path: Column) -> Column:
    """All ancestors of a path and itself, as an array."""
    parts = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def breadcrumbs(path: Column) -> Column:
    """Name and cumulative path of each segment; none for a null or empty path."""
    trimmed = F.btrim(path, F.lit("/"))
    parts = segments(trimmed)
    made = F.transform(parts, lambda p, i: F.struct(p.alias("name"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("path")))
    return F.when((trimmed != "") & trimmed.isNotNull(), made).otherwise(F.array().cast("array<struct<name:string,path:string>>"))


def shard(id_: Column) -> Column:
    """aa/bb from the first hex digits of an id."""
    hexes = F.replace(id_, F.lit("-"), F.lit(""))
    return F.concat_ws("/", F.substring(hexes, 1, 2), F.substring(hexes, 3, 2))


def extension(name: Column) -> Column:
    """What follows the last dot of a file name that isn't its first character; null without one."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.nullif(F.regexp_extract(base, r"^.+\.([^.]+)$", 1), F.lit(""))


def disk_name(id_: Column, original: Column) -> Column:
    return F.concat(id_, F.lit("."), F.coalesce(F.lower(extension(original)), F.lit("raw")))


def suggested_name(caption: Column, index: Column, total: Column, ext: Column) -> Column:
    """From the first 30 characters: other than letters and digits to _, trimmed of _, lower case; numbered if there are several."""
    made = F.lower(F.btrim(F.regexp_replace(F.substring(caption, 1, 30), r"[^\p{L}\p{N}]", "_"), F.lit("_")))
    prefix = F.when(made == "", F.lit("media")).otherwise(made)
    return F.concat(prefix, F.when(total > 1, F.concat(F.lit("_"), (index + 1).cast("string"))).otherwise(F.lit("")), F.lit("."), ext)
