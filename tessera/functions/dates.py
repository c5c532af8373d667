"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordinal_suffix(day: Column) -> Column:
    last = F.pmod(day, F.lit(10))
    plain = F.when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.when(day.between(11, 13), "th").otherwise(plain)


def ordinal_title(ts: Column) -> Column:
    """Saturday, 12th September 2026."""
    day = F.dayofmonth(ts)
    return F.concat(F.date_format(ts, "EEEE"), F.lit(", "), day.cast("string"), ordinal_suffix(day), F.lit(" "), F.date_format(ts, "MMMM yyyy"))


def time_of_day(hour: Column) -> Column:
    """5-11 Morning, 12-16 Afternoon, 17-20 Evening, else Night; null stays null."""
    return F.when(hour.between(5, 11), "Morning").when(hour.between(12, 16), "Afternoon").when(hour.between(17, 20), "Evening").when(hour.isNotNull(), "Night")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def parsed_time(text: Column) -> Column:
    """RFC 3339, else yyyy-MM-dd HH:mm:ss as UTC, else null."""
    zoned = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|z|[+-]\d\d:\d\d)$"), text.try_cast("timestamp"))
    return F.coalesce(zoned, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def date_part(text: Column, n: int) -> Column:
    """The n-th number (from 1) of a date text split at -, T, space and colon."""
    return F.get(F.split(text, "[-T :]"), F.lit(n - 1)).try_cast("int")


def from_epoch(seconds: Column) -> Column:
    return rfc3339(F.timestamp_seconds(seconds))


def days_remaining(deleted_at: Column, now: Column, keep_days: int = 30) -> Column:
    """Whole days until a trashed row is purged, 0 at least."""
    passed = F.floor((F.unix_timestamp(now) - F.unix_timestamp(deleted_at)) / 86400)
    return F.greatest(F.lit(keep_days) - passed, F.lit(0)).cast("int")


def camera_folder(ts: Column) -> Column:
    return F.concat(F.lit("Camera Roll/"), F.date_format(ts, "yyyy-MM"))


def sample_times(duration: Column) -> Column:
    """Frame times of a clip: duration / (n + 1) * i, with n 4 over 60 s, 3 over 1 s, else 1."""
    n = F.when(duration > 60, 4).when(duration > 1, 3).otherwise(1)
    return F.transform(F.sequence(F.lit(1), n), lambda i: duration / (n + 1) * i)
