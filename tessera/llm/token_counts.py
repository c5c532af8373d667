"""Exact histogram of encoded lengths and what its suffix sums answer for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import column, quoted, stage

#: Where the public vocabularies are by default; a parameter of every function that encodes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public byte-level BPE pre-tokenisation pattern. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of one block of the two-level sums.
BLOCK = 1024

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file, made once in a process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _lengths(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in column(batch, "_text")]
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_text"]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64())], [*names, "n_tokens"])

    return run


def token_lengths(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """The encoded length of every whole text (null: 0) as n_tokens, with the columns in keep."""
    keep = tuple(c for c in keep if c != "n_tokens")
    held = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(quoted(c)).alias(k) for c, k in zip(keep, held, strict=True)], F.col(quoted(text_col)).cast("string").alias("_text"))
    fields = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in held] + ["n_tokens long"])
    out = rows.mapInArrow(_lengths(vocabulary), fields)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, held, strict=True)], "n_tokens")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row for each encoded length that occurs, with suffix sums.

    n_tokens, n_docs (documents of that length), docs_at_least and tokens_at_least (of that length or more),
    docs_before (shorter ones), truncated_total (tokens left if every text is cut to n_tokens: the shorter
    ones whole, the others n_tokens each) and total (all tokens). An empty input gives no rows.

    The sums over lengths are made by block of lengths, then within each block, so no task holds all of them. The
    counts by length are staged, so the lengths are made once.
    """
    hist = stage(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    hist = hist.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_later_d"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_later_t"),
        F.sum("_d").over(every).alias("_all_d"),
        F.sum("_t").over(every).alias("total"),
    )
    on = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    out = hist.join(blocks, "_block")
    out = out.withColumn("docs_at_least", F.sum("n_docs").over(on) + F.col("_later_d"))
    out = out.withColumn("tokens_at_least", F.sum("_tokens").over(on) + F.col("_later_t"))
    cut = F.col("total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("_all_d") - F.col("docs_at_least")).alias("docs_before"), cut.alias("truncated_total"), "total"
    )


def token_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """length_histogram of the encoded lengths of all texts; null and empty texts have length 0."""
    return length_histogram(token_lengths(docs, text_col, vocabulary=vocabulary))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q, the smallest length that at least q of all documents don't exceed: share, n_tokens."""
    asked = histogram.sparkSession.createDataFrame([(float(q),) for q in shares], "share double")
    n = F.col("docs_before") + F.col("docs_at_least")
    reached = histogram.select("n_tokens", ((F.col("docs_before") + F.col("n_docs")) / n).alias("_reached"))
    pairs = reached.join(F.broadcast(asked), F.col("_reached") >= F.col("share"))
    return pairs.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit, the tokens left if every text is cut to it: limit, kept_tokens, dropped_tokens, n_cut (documents cut)."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    pairs = histogram.crossJoin(F.broadcast(asked))
    over = F.col("n_tokens") > F.col("limit")
    return pairs.groupBy("limit").agg(
        F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("kept_tokens"),
        F.sum(F.when(over, (F.col("n_tokens") - F.col("limit")) * F.col("n_docs")).otherwise(F.lit(0))).alias("dropped_tokens"),
        F.sum(F.when(over, F.col("n_docs")).otherwise(F.lit(0))).alias("n_cut"),
    )
