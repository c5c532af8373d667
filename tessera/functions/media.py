"""Media types, magic bytes, geometry of frames and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and MIME types.
IMAGE_MIMES = {"heic": "image/heic", "heif": "image/heic", "png": "image/png", "webp": "image/webp"}
VIDEO_MIMES = {"gif": "image/gif", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm"}
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "webm", "mkv", "avi", "gif")
EXTENSIONS = {
    "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/avif": "avif", "image/svg+xml": "svg", "image/heic": "heic", "image/heif": "heic",
    "video/mp4": "mp4", "video/webm": "webm", "video/quicktime": "mov", "video/x-matroska": "mkv", "application/x-mpegurl": "mp4", "application/vnd.apple.mpegurl": "mp4",
}
HEIC_BRANDS = ("heic", "heix", "heim", "heis", "mif1", "msf1")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def mime_of_extension(ext: Column) -> Column:
    """Of an image or a clip, which the extension tells apart; JPEG and MP4 where nothing else is known."""
    low = F.lower(ext)
    return F.when(is_video_extension(ext), F.coalesce(_lookup(low, VIDEO_MIMES), F.lit("video/mp4"))).otherwise(F.coalesce(_lookup(low, IMAGE_MIMES), F.lit("image/jpeg")))


def extension_of_mime(mime: Column, is_video: Column) -> Column:
    main = F.btrim(F.split_part(mime, F.lit(";"), F.lit(1)))
    return F.coalesce(_lookup(main, EXTENSIONS), F.when(is_video, "mp4").otherwise("jpg"))


def is_video_extension(ext: Column) -> Column:
    return F.lower(ext).isin(*VIDEO_EXTENSIONS)


def image_mime_of_url(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.contains(".png") | low.contains(".pnj"), "image/png")
        .when(low.contains(".webp"), "image/webp")
        .when(low.contains(".gif"), "image/gif")
        .when(low.contains(".avif"), "image/avif")
        .otherwise("image/jpeg")
    )


def video_mime_of_url(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains(".m3u8"), "application/x-mpegURL").when(low.contains(".webm") & ~low.contains(".webmanifest"), "video/webm").otherwise("video/mp4")


def is_video_url(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(m3u8|mp4|webm)")


def is_image_url(url: Column) -> Column:
    low = F.lower(url)
    path = F.split_part(low, F.lit("?"), F.lit(1))
    return ~low.startswith("data:") & (path.rlike(r"\.(jpg|jpeg|png|pnj|webp|gif|avif)$") | low.contains("tumblr.com/") | low.contains("/thumbnail/"))


def magic_extension(head: Column) -> Column:
    """File type of the first bytes, as an extension; null under 12 bytes or unknown. head: binary."""
    hexes = F.hex(F.substring(head, 1, 12))
    brand = F.unhex(F.substring(hexes, 17, 8)).cast("string")
    known = (
        F.when(hexes.startswith("FFD8FF"), "jpg")
        .when(hexes.startswith("89504E470D0A1A0A"), "png")
        .when(hexes.startswith("474946383761") | hexes.startswith("474946383961"), "gif")
        .when(hexes.startswith("52494646") & (F.substring(hexes, 17, 8) == "57454250"), "webp")
        .when((F.substring(hexes, 9, 8) == "66747970") & brand.isin(*HEIC_BRANDS), "heic")
        .when((F.substring(hexes, 9, 8) == "66747970") & (brand == "qt  "), "mov")
        .when(F.substring(hexes, 9, 8) == "66747970", "mp4")
    )
    return F.when(F.length(hexes) == 24, known)


def quality_label(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.contains("4k") | low.contains("2160"), "4K")
        .when(low.contains("1080"), "1080p")
        .when(low.contains("720"), "720p")
        .when(low.contains("480"), "480p")
        .when(low.contains("audio"), "Audio Track")
    )


def aspect_ratio(width: Column, height: Column, default: float = 1.0) -> Column:
    return F.when(height > 0, width / height).otherwise(F.lit(default))


def rotated(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """Width and height as shown: swapped at a quarter turn."""
    turned = F.abs(rotation).isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def sane_confidence(value: Column) -> Column:
    """NaN and infinities to 0, the rest clamped to 0..1."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def calibrated(scores: Column) -> Column:
    """Sigmoid of all scores of an array if any of them is outside 0..1."""
    raw = F.exists(scores, lambda x: (x < 0) | (x > 1))
    return F.when(raw, F.transform(scores, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))).otherwise(scores)


def backoff_seconds(message: Column, attempt: Column) -> tuple[Column, Column]:
    """Whether an error is a rate limit, and the wait without jitter: 180 s doubling up to 8 times, else 35 s."""
    limited = F.lower(message).rlike("429|feedback_required|checkpoint|rate limit")
    factor = F.pow(F.lit(2), F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(3)))
    return limited, F.when(limited, 180 * factor).otherwise(35).cast("long")


def char_sum(text: Column) -> Column:
    """Checksum: the sum of the characters' codes."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c)).cast("long")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))
