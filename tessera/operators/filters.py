"""Feed requests and the predicates they stand for."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists of ids up to this length are sent as a literal set; longer ones are joined.
LITERAL_IDS = 1000


def blank_as_none(value: str | None) -> str | None:
    return None if value is None or not value.strip() else value


def lenient_bool(value: str | None) -> bool | None:
    """true/1 and false/0; blank is None; anything else is an error."""
    value = blank_as_none(value)
    if value is None:
        return None
    if value in ("true", "1"):
        return True
    if value in ("false", "0"):
        return False
    raise ValueError(f"not a boolean: {value!r}")


def clamp_limit(limit: int | None, default: int = 50, most: int = 200) -> int:
    return max(1, min(most, default if limit is None else limit))


def csv_names(value: str | None) -> list[str]:
    """A comma-separated list, trimmed, lower-cased, blanks dropped; repeats stay."""
    return [x for part in (value or "").split(",") if (x := part.strip().lower())]


def csv_uuids(value: str | None) -> list[str]:
    """A comma-separated list of ids; those that aren't UUIDs are dropped, repeats stay."""
    out = []
    for part in (value or "").split(","):
        try:
            out.append(str(uuid.UUID(part.strip())))
        except ValueError:
            continue
    return out


@dataclass(frozen=True)
class FeedRequest:
    """Parameters of a feed or facet query; None leaves a predicate out."""

    user_id: object = None
    trash: bool = False
    media_type: str | None = None
    favorite: bool | None = None
    #: None: no restriction; an empty list: no rows.
    candidate_ids: Sequence[object] | None = None
    folder: str | None = None
    city: str | None = None
    camera: str | None = None
    date_from: object = None
    date_to: object = None
    tags: Sequence[str] = field(default_factory=tuple)
    person_ids: Sequence[object] = field(default_factory=tuple)
    album_id: object = None
    query: str | None = None
    sort: str = "timeline"
    seed: int = 1337
    limit: int | None = None
    cursor_captured_at: object = None
    cursor_id: object = None

    def __post_init__(self) -> None:
        if self.sort == "timeline" and (self.cursor_captured_at is None) != (self.cursor_id is None):
            raise ValueError("a timeline cursor needs both captured_at and id")


def media_type_is(media_type: str | None) -> Column:
    """photos have no duration, videos have one; other values don't restrict."""
    if media_type == "photos":
        return F.col("duration_seconds").isNull()
    if media_type == "videos":
        return F.col("duration_seconds").isNotNull()
    return F.lit(True)


def in_range(name: str, low: object, high: object) -> Column:
    """Inclusive bounds, each optional; a bound drops nulls."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(name) >= F.lit(low))
    if high is not None:
        out = out & (F.col(name) <= F.lit(high))
    return out


def bounding_box(lat: str, lng: str, south=None, north=None, west=None, east=None) -> Column:
    """An axis restricts only when both of its bounds are given."""
    out = F.lit(True)
    if south is not None and north is not None:
        out = out & F.col(lat).between(south, north)
    if west is not None and east is not None:
        out = out & F.col(lng).between(west, east)
    return out


def with_ids(df: DataFrame, name: str, ids: Sequence[object] | None) -> DataFrame:
    """Rows whose id is in the list: None keeps all, an empty list none."""
    if ids is None:
        return df
    if not ids:
        return df.where(F.lit(False))
    if len(ids) <= LITERAL_IDS:
        return df.where(F.col(name).isin(list(ids)))
    listed = df.sparkSession.createDataFrame([(x,) for x in ids], df.select(name).schema)
    return df.join(listed, name, "left_semi")


def divided(df: DataFrame, key: str, bridge: DataFrame, bridge_key: str, value: str, wanted: Sequence[object]) -> DataFrame:
    """Relational division: rows of df that the bridge links with every wanted value.

    The number of wanted values counts repeats, so a repeated one leaves no rows. The bridge is filtered before
    it is grouped, and counted with partial aggregation.
    """
    if not wanted:
        return df
    full = bridge.where(F.col(value).isin(sorted(set(wanted)))).groupBy(F.col(bridge_key).alias("_key"))
    full = full.agg(F.countDistinct(value).alias("_n")).where(F.col("_n") == len(wanted)).select("_key")
    return df.join(full, df[key] == full["_key"], "left_semi")


def apply_filters(assets: DataFrame, req: FeedRequest, tags: DataFrame | None = None, faces: DataFrame | None = None, album_assets: DataFrame | None = None) -> DataFrame:
    """All predicates of a request. tags: asset_id, name; faces: asset_id, person_id; album_assets: album_id, asset_id."""
    keep = F.col("deleted_at").isNotNull() if req.trash else F.col("deleted_at").isNull()
    if req.user_id is not None:
        keep = keep & (F.col("user_id") == F.lit(req.user_id))
    keep = keep & media_type_is(req.media_type) & in_range("captured_at", req.date_from, req.date_to)
    for name, value in (("is_favorite", req.favorite), ("folder_path", req.folder), ("city", req.city), ("camera_model", req.camera)):
        if value is not None:
            keep = keep & (F.col(name) == F.lit(value))
    out = with_ids(assets.where(keep), "id", req.candidate_ids)
    if req.album_id is not None and album_assets is not None:
        out = out.join(album_assets.where(F.col("album_id") == F.lit(req.album_id)).select(F.col("asset_id").alias("id")), "id", "left_semi")
    if req.person_ids and faces is not None:
        out = divided(out, "id", faces, "asset_id", "person_id", req.person_ids)
    if req.tags and tags is not None:
        out = divided(out, "id", tags, "asset_id", "name", req.tags)
    return out


def query_string(params: dict[str, Column]) -> Column:
    """Parameters as the query of a URL, in the given order; null and empty ones are left out."""
    pairs = [F.when(v.cast("string") != "", F.concat(F.lit(f"{name}="), F.url_encode(v.cast("string")))) for name, v in params.items()]
    joined = F.concat_ws("&", *pairs)
    return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit(""))
