"""Exact dedup with a heavy-hitter split.

Texts are equal if they are after A-Z are lower-cased; a SHA-256 digest stands for each. Misra-Gries summaries of the
digests are made in every task and merged in a tree. Every digest that more than one in COUNTERS + 1 rows have is
among the counters. Those are counted exactly; the ones that are as frequent as that, at most COUNTERS of them, have
their winners broadcast, and all their rows are settled where they are. What is left is shuffled by digest: no digest
there has more than its share of rows, and only ids and digests are shuffled unless texts are to be passed on.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import others, quoted, stage

#: Counters of a summary, and so the most winners that are broadcast.
COUNTERS = 2048
MADE = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def pruned(counts: Counter, most: int) -> Counter:
    """A Misra-Gries summary of at most so many counters: the first that is one too many is taken off all.

    A count is never above the true one, and below it by at most n / (most + 1), however summaries were merged.
    """
    if len(counts) <= most:
        return counts
    least = sorted(counts.values(), reverse=True)[most]
    return Counter({k: c - least for k, c in counts.items() if c > least})


def merged(a: tuple[int, Counter], b: tuple[int, Counter], most: int) -> tuple[int, Counter]:
    """Two summaries with the number of rows that each is of."""
    return a[0] + b[0], pruned(a[1] + b[1], most)


def summary(keys: DataFrame, most: int) -> tuple[int, Counter]:
    """The number of rows of a one-column table, and a Misra-Gries summary of their values.

    A row of counters comes from each task, and these are merged in a tree of tasks; the driver gets a few of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, Counter()
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            n += batch.num_rows
            counts.update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True)))
            counts = pruned(counts, most)
        yield pa.RecordBatch.from_pydict({"n": [n], "k": pa.array([list(counts.keys())], pa.list_(pa.binary())), "c": pa.array([list(counts.values())], pa.list_(pa.int64()))})

    parts = keys.mapInArrow(count, "n long, k array<binary>, c array<long>").rdd
    if not parts.getNumPartitions():
        return 0, Counter()
    own = parts.map(lambda r: (r.n, Counter(dict(zip(map(bytes, r.k), r.c, strict=True)))))
    return own.treeReduce(lambda a, b: merged(a, b, most), depth=3)


def _winner() -> Column:
    """Of rows with one digest: the largest id, a row without one only where none has, and of repeats the first; with the number of rows."""
    return F.max(F.struct("_id", (-F.col("_row")).alias("row"))).alias("_top"), F.count("*").alias("_n")


def marked(docs: DataFrame, id_: str = "doc_id", text: str = "text", passed: Sequence[str] | None = None, counters: int | None = None) -> DataFrame:
    """Every row with what becomes of it: keep_id, group_size, kept, text_sha256, after the columns passed on (all, if not given).

    Of rows with equal texts the one with the largest id is kept. A null text is an empty one, and both are texts like
    any other: all empty rows but one go. A row without id is kept only where no row of its group has one; keep_id is
    null then. Of repeated rows (one id, one text) exactly one is kept, and all of them count in group_size. Columns
    named like a result are replaced by it, other names don't matter. No rows give no rows. Texts may be of any length.
    """
    most = counters or COUNTERS
    names = others(docs.select(*map(quoted, passed)) if passed is not None else docs, *MADE)
    own = F.struct(*[F.col(quoted(c)) for c in names] or [F.lit(0)])
    rows = docs.select(own.alias("_doc"), F.col(quoted(id_)).cast("long").alias("_id"), F.unhex(F.sha2(normalised(F.col(quoted(text))), 256)).alias("_key"))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")
    total, found = summary(rows.select("_key"), most)
    spark = docs.sparkSession
    suspects = spark.createDataFrame([(bytearray(k),) for k in sorted(found)], "_key binary")
    exact = rows.select("_key", "_id", "_row").join(F.broadcast(suspects), "_key").groupBy("_key").agg(*_winner())
    heavy = exact.where(F.col("_n") * F.lit(most + 1) > F.lit(total)).collect()
    winners = spark.createDataFrame(heavy, exact.schema)
    settled = rows.join(F.broadcast(winners), "_key")
    rest = rows.join(F.broadcast(winners.select("_key")), "_key", "left_anti")
    copies = rest.groupBy("_key").agg(*_winner()).where("_n > 1")
    alone = F.struct("_id", (-F.col("_row")).alias("row"))
    light = rest.join(copies, "_key", "left").withColumns({"_top": F.coalesce("_top", alone), "_n": F.coalesce("_n", F.lit(1))})
    out = settled.select(*light.columns).unionByName(light)
    results = [F.col("_top._id").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_row") == -F.col("_top.row")).alias("kept"), F.lower(F.hex("_key")).alias("text_sha256")]
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in names], *results)


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all rows but one of each text, as marked() chooses; columns as they are."""
    whole = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("_whole"), F.col(quoted(id_)).alias("_i"), F.col(quoted(text)).alias("_t"))
    return marked(whole, "_i", "_t", ["_whole"]).where("kept").select("_whole.*")
