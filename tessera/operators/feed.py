"""Feed ordering, keyset pages, seeded shuffles and day sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import ordinal_title
from tessera.operators.filters import FeedRequest, clamp_limit


def timeline_order(ts: str = "captured_at", id_: str = "id") -> list[Column]:
    return [F.col(ts).desc_nulls_last(), F.col(id_).desc()]


def after_timeline(captured_at: object, cursor_id: object, ts: str = "captured_at", id_: str = "id") -> Column:
    """What follows a cursor. Undated rows don't follow a dated cursor; an undated cursor has only an id."""
    if captured_at is not None:
        at = F.lit(captured_at).cast("timestamp_ntz") if isinstance(captured_at, str) else F.lit(captured_at)
        return (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(id_) < F.lit(cursor_id)))
    if cursor_id is not None:
        return F.col(ts).isNull() & (F.col(id_) < F.lit(cursor_id))
    return F.lit(True)


def shuffle_key(id_: Column, seed: int) -> Column:
    """The first 32 bits of md5(id || seed) as a signed integer."""
    value = F.conv(F.substring(F.md5(F.concat(id_.cast("string"), F.lit(str(abs(seed))))), 1, 8), 16, 10).cast("long")
    return F.when(value >= 2**31, value - 2**32).otherwise(value)


def after_shuffle(cursor_id: object, seed: int) -> Column:
    """What follows a row in shuffled order, whatever became of the row itself."""
    key, at = shuffle_key(F.col("id"), seed), shuffle_key(F.lit(cursor_id), seed)
    return (key > at) | ((key == at) & (F.col("id") > F.lit(cursor_id)))


def page(df: DataFrame, req: FeedRequest) -> DataFrame:
    """A page with one row more than the limit, which tells that more follow. Planned as a top-k per partition, then of those."""
    limit = clamp_limit(req.limit)
    if req.sort == "random":
        out = df if req.cursor_id is None else df.where(after_shuffle(req.cursor_id, req.seed))
        return out.withColumn("shuffle", shuffle_key(F.col("id"), req.seed)).orderBy("shuffle", "id").limit(limit + 1)
    return df.where(after_timeline(req.cursor_captured_at, req.cursor_id)).orderBy(*timeline_order()).limit(limit + 1)


def paged(df: DataFrame, req: FeedRequest) -> tuple[list, bool, object]:
    """The rows of a page (201 at most come to the driver), whether more follow, and the last row as cursor."""
    rows, limit = page(df, req).collect(), clamp_limit(req.limit)
    return rows[:limit], len(rows) > limit, rows[limit - 1] if len(rows) > limit else None


def section_id(ts: Column) -> Column:
    return F.coalesce(F.concat(F.lit("section-"), F.date_format(ts, "yyyy-MM-dd")), F.lit("section-undated"))


def sections(df: DataFrame, ts: str = "captured_at", id_: str = "id") -> DataFrame:
    """Day sections of rows in timeline order: section_id, title, month, year, date_iso, n_items, first_id.

    In that order rows of a day stand together, so a section is a group, and no global running number is needed.
    """
    day = df.groupBy(F.to_date(ts).alias("d")).agg(F.count("*").alias("n_items"), F.max_by(id_, F.struct(ts, id_)).alias("first_id"))
    t = F.col("d")
    return day.select(
        section_id(t).alias("section_id"),
        F.coalesce(ordinal_title(t), F.lit("Undated")).alias("title"),
        F.date_format(t, "MMM").alias("month"),
        F.year(t).cast("string").alias("year"),
        F.date_format(t, "yyyy-MM-dd").alias("date_iso"),
        "n_items",
        "first_id",
    )


def runs(df: DataFrame, partition: list[str], order: list[Column], key: Column) -> DataFrame:
    """Numbers consecutive rows of equal key within each partition, in the given order, from 1, as run."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.when(F.lag(F.struct(key)).over(w).eqNullSafe(F.struct(key)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def scrub_markers(days: DataFrame) -> DataFrame:
    """The first (newest) section of each month: month, year, section_id."""
    return days.where("date_iso is not null").groupBy("month", "year").agg(F.max("section_id").alias("section_id"))


def neighbours(df: DataFrame, partition: list[str], order: list[Column], id_: str = "id") -> DataFrame:
    """Previous and next row within each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("prev_id", F.lag(id_).over(w)).withColumn("next_id", F.lead(id_).over(w))


def merge_page(shown: DataFrame, incoming: DataFrame, id_: str = "id") -> DataFrame:
    """Rows shown so far and those of the incoming page that aren't among them."""
    return shown.unionByName(incoming.join(shown.select(id_), id_, "left_anti"))
