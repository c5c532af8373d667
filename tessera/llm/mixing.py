"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected target / size times. Expected copies are summed up along a fixed
order of the source's documents, one random offset is added, and a document is emitted once for each integer
boundary that the sum crosses at it. The order is by size, so any stretch of it has the mean size of its
neighbours and the words taken come near the target whichever offset is drawn.

A document that alone holds more than one in HEAVY of its source's words would decide by its boundary whether the target is
met. Such documents, at most HEAVY of a source, are expected a whole number of times, so that any offset crosses as many
boundaries at them: from the largest on, the number that brings the words so far nearest to their share. All others of
the source share what is left to the target evenly.

The prefix sums are made in two levels: of blocks of the order (a size class and a hash bucket within it),
then within each block, so that no source is ever in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, joined, quoted, stage, texts_of, word_spans

#: Documents of one block of the order, about; and the share of a source's words, as one in so many, that makes a document heavy.
BLOCK_ROWS = 50_000
HEAVY = 256


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target sizes of the sources.

    sizes has _source, source_size and n_docs, a row for each source. Sources by code point, null last, have
    the weights, repeating, and share the share of all sizes; a target stops at most times its source's size
    and the excess goes to the others by weight until none is above. That fixed point is a common level: each
    target is the smaller of its bound and weight times the level. Ordered by bound / weight, the level is
    what is left after the sources before, over the weights left; the first source whose bound it doesn't
    reach sets it. Adds target. The table has a row for each source, so one window over it is small.
    """
    one = Window.orderBy(F.col("_source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(one) - 1, F.lit(len(weights)))
    w = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), nth + 1))
    w = w.withColumn("_bound", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("_bound") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_bound").over(before), F.lit(0.0))
    w = w.withColumn("_level", left / F.sum("_w").over(after))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_bound"), F.struct(F.col("_bound") / F.col("_w"), F.col("_level").alias("at")))
    w = w.withColumn("_level", F.min(fits).over(everything)["at"])
    target = F.least("_bound", F.col("_w") * F.coalesce("_level", F.lit(float("inf"))))
    return w.withColumn("target", target).drop("_w", "_bound", "_level")


def _offset(seed: int, source: Column) -> Column:
    """A number in [0, 1) of the seed and the source, a multiple of 2**-20 so that sums with it stay exact."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(source, F.lit("\0"))), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _whole_copies(sizes: Column, rate: Column, most: float) -> Column:
    """Of heavy documents' sizes, largest first: words (their sum), taken, and copies, the whole number of each."""

    def step(so_far: Column, size: Column) -> Column:
        words = so_far["words"] + size
        n = F.least(F.greatest(F.floor((rate * words - so_far["taken"]) / size + 0.5), F.lit(0)), F.floor(F.lit(float(most))))
        return F.struct(words.alias("words"), (so_far["taken"] + n * size).alias("taken"), F.concat(so_far["copies"], F.array(n)).alias("copies"))

    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("copies"))
    return F.aggregate(sizes, start, step)


def _sized(keep_text: bool):
    """Adds size, the number of words of _text; _text goes unless it is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = texts_of(batch, "_text"), []
            for i, j in chunks(texts):
                buf, offsets = joined(texts[i:j])
                counts.append(np.diff(np.searchsorted(word_spans(buf)[0], offsets)))
            names = [n for n in batch.schema.names if keep_text or n != "_text"]
            size = pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), size], [*names, "size"])

    return run


def _with_size(rows: DataFrame, keep_text: bool) -> DataFrame:
    names = [c for c in rows.columns if keep_text or c != "_text"]
    return rows.mapInArrow(_sized(keep_text), ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names), "size long"]))


def copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, and the columns in carry as _c0, _c1, ...

    size is the number of words (null text: 0). Every input row is one document, repeated ids too; a null
    source is a source. A source without words has target 0 and gives no copies. Documents without words are
    drawn like others of their source. The same rows and seed give the same copies in any layout; among rows
    equal in id, text and source it is not said which gets a copy more, as they are the same.
    """
    own = [
        F.col(quoted(id_col)).cast("long").alias("doc_id"),
        F.col(quoted(source_col)).cast("string").alias("_source"),
        F.xxhash64(F.lit(seed), F.col(quoted(id_col)), F.col(quoted(text_col))).alias("_mix"),
        F.col(quoted(text_col)).cast("string").alias("_text"),
    ]
    # Staged without the texts: sums and places are made of this, and the texts are counted once.
    narrow = base = stage(_with_size(docs.select(*own), False), "sizes")
    if carry:
        base = _with_size(docs.select(*own, *[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(carry) if c != text_col]), text_col in carry)
        if text_col in carry:
            base = base.withColumn(f"_c{list(carry).index(text_col)}", F.col("_text").cast(docs.schema[text_col].dataType)).drop("_text")
    sizes = narrow.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = source_targets(sizes, weights, share, most)
    sources = sources.select(F.col("_source").alias("_src"), "source_size", "target", "n_docs", _offset(seed, F.col("_source")).alias("_offset"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    heavy = (F.col("size") > 0) & (F.col("size") * HEAVY >= F.col("source_size"))
    sources = stage(sources.withColumn("_rate", rate), "sources")
    large = narrow.join(sources, F.col("_source").eqNullSafe(F.col("_src"))).where(heavy)
    large = large.groupBy(F.col("_source").alias("_ls")).agg(F.sort_array(F.collect_list("size"), asc=False).alias("_sizes"))
    sources = sources.join(large, F.col("_src").eqNullSafe(F.col("_ls")), "left").drop("_ls")
    sources = sources.withColumn("_h", _whole_copies(F.coalesce("_sizes", F.array().cast("array<bigint>")), F.col("_rate"), most)).drop("_sizes")
    others = F.col("source_size") - F.col("_h.words")
    left = F.least(F.greatest((F.col("target") - F.col("_h.taken")) / others, F.lit(0.0)), F.lit(float(most)))
    sources = sources.withColumn("_e", F.when(others > 0, left).otherwise(F.col("_rate"))).withColumn("_whole", F.col("_h.copies")).drop("_h", "_rate")
    # Eight classes an octave; the buckets within a class follow the source's number of documents.
    size_class = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    bucket = F.pmod(F.shiftright("_mix", 20), F.ceil(F.col("n_docs") / BLOCK_ROWS)).cast("int")
    # One row for each source, read twice.
    sources = stage(sources, "sources")

    def ranked_of(rows: DataFrame) -> DataFrame:
        out = rows.join(sources, F.col("_source").eqNullSafe(F.col("_src"))).drop("_src").withColumn("_heavy", heavy)
        return out.withColumn("_class", size_class).withColumn("_bucket", bucket)

    ranked = ranked_of(base)
    blocks = ranked_of(narrow).where(~F.col("_heavy")).groupBy("_source", "_class", "_bucket").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("_source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("_source").alias("_bs"), F.col("_class").alias("_bc"), F.col("_bucket").alias("_bb"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before")
    )
    at = F.col("_source").eqNullSafe(F.col("_bs")) & (F.col("_class") == F.col("_bc")) & (F.col("_bucket") == F.col("_bb"))
    within = Window.partitionBy("_source", "_class", "_bucket").orderBy("size", "_mix", F.col("doc_id").asc_nulls_last())
    placed = ranked.where(~F.col("_heavy")).join(blocks, at).withColumn("_at", F.col("_before") + F.row_number().over(within))
    # Expected copies are the same for all of these in a source, so their prefix sum is a product, free of summing errors.
    crossed = F.floor(F.col("_at") * F.col("_e") + F.col("_offset")) - F.floor((F.col("_at") - 1) * F.col("_e") + F.col("_offset"))
    placed = placed.withColumn("_n", F.least(crossed, F.floor(F.lit(float(most)))).cast("long"))
    # A whole number of expected copies crosses as many boundaries, wherever it begins.
    first = Window.partitionBy("_source").orderBy(F.desc("size"), "_mix", F.col("doc_id").asc_nulls_last())
    whole = ranked.where("_heavy").withColumn("_n", F.element_at("_whole", F.row_number().over(first)))
    names = ["doc_id", "_source", "size", "source_size", "target", "_n", *[f"_c{i}" for i in range(len(carry))]]
    placed = placed.select(*names).unionByName(whole.select(*names)).withColumnRenamed("_n", "copies")
    return placed.select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target", "copies", *[f"_c{i}" for i in range(len(carry))])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as copies() says (0, 1, 2 times with the usual bound)."""
    names = docs.columns
    taken = copies(docs, id_col, text_col, source_col, carry=names, **options).where("copies > 0")
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(names)]
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*back)
