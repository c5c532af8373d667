"""Full-text search from an index: postings by term, with places, in blocks of documents with the best score of each.

An index is three tables. postings: a row for each term and document (term, block, id, size, score, places), dealt by ranges
of (term, block) and sorted, so that the rows of a query's words are a few row groups that the scan finds by their bounds,
and a frequent word is spread over many files. A place is a word's position times 4 with its weight class; places ascend and
are delta-coded by the file format. maxima: the best score of each term in each block of about BLOCK documents. documents:
the id, block and size of each. Searches read these alone, and of postings only the words asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.operators.search import WEIGHTS, Query, density, parse
from tessera.session import shared_dir

#: Documents of a block, about, and how many of the best blocks are read for a first threshold.
BLOCK, FIRST = 128, 16
CLASSES = tuple(WEIGHTS)
#: Words that a task turns into arrays at once.
TOKENS = 1 << 17


@dataclass(frozen=True)
class TextIndex:
    """Where an index has been written."""

    path: str
    id_: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _sizes(tokens: pa.Array) -> np.ndarray:
    return pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batch: pa.RecordBatch, most: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """A batch of (id, block, words, ..) in pieces of at most so many words, or of one document that has more."""
    ends, i = np.cumsum(_sizes(batch.column(2))), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def _postings(weights: list[float], classes: list[int]):
    """Rows of (id, block, words, words of each field) to (term, block, id, size, score, places), document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                ids, blocks, tokens, counts = batch.columns
                sizes = _sizes(tokens)
                n = int(sizes.sum())
                if not n:
                    continue
                coded = tokens.flatten().dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                field = np.repeat(np.tile(np.arange(len(weights)), len(sizes)), counts.flatten().to_numpy(zero_copy_only=False))
                order = np.argsort(doc * len(coded.dictionary) + code, kind="stable")
                key = (doc * len(coded.dictionary) + code)[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                own = doc[order][first]
                places = pa.ListArray.from_arrays(pa.array(np.r_[first, n], pa.int32()), pa.array((place * 4 + np.array(classes)[field])[order].astype(np.int32)))
                score = np.add.reduceat(np.array(weights)[field][order], first)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[order][first])), blocks.take(at), ids.take(at), pa.array(sizes[own]), pa.array(score), places], ["term", "block", "id", "size", "score", "places"])

    return run


def build(docs: DataFrame, id_: str, fields: dict[str, Column], path: str | None = None, block: int = BLOCK) -> TextIndex:
    """Write an index of docs, whose ids are unique, and say where it is. fields: the text of each weight class (A to D).

    The words of the fields stand one after the other. Rows without any word are documents without postings. Texts
    are read once for the postings, and only postings are shuffled, once.
    """
    spark = docs.sparkSession
    index = TextIndex(path or f"{shared_dir(spark)}/words-{uuid.uuid4().hex}", id_)
    blocks = max(1, docs.count() // block)
    kind = docs.schema[id_].dataType.simpleString()
    own = [words(F.coalesce(c, F.lit(""))) for c in fields.values()]
    rows = docs.select(F.col(id_).alias("id"), F.pmod(F.xxhash64(F.col(id_)), F.lit(blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(own)])
    names = [f"w{i}" for i in range(len(own))]
    flat = rows.select("id", "block", F.concat(*names).alias("tokens"), F.array(*[F.size(n) for n in names]).alias("counts"))
    made = flat.mapInArrow(_postings([WEIGHTS[c] for c in fields], [CLASSES.index(c) for c in fields]), f"term string, block long, id {kind}, size long, score double, places array<int>")
    dealt = made.repartitionByRange("term", "block", "id").sortWithinPartitions("term", "block", "id")
    dealt.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").parquet(f"{index.path}/postings")
    postings = index.table(spark, "postings")
    best = postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(F.col("score") / (1 + F.col("size"))).alias("most"))
    best.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{index.path}/maxima")
    flat.select("id", "block", F.size("tokens").cast("long").alias("size")).write.parquet(f"{index.path}/documents")
    return index


def _terms(query: Query, wanted: bool = False) -> list[str]:
    """All words of a query, or those that it wants."""
    return sorted({t for way in query.ways for sign, terms in way if sign or not wanted for t in terms})


def _gathered(rows: DataFrame, query: Query, places: list[str]) -> DataFrame:
    """Postings to documents: id, block, size, score (of the wanted words), has (a flag for each word of the query), p0.. (places)."""
    terms, wanted = _terms(query), _terms(query, True)
    bit = F.element_at(F.create_map(*[x for i, t in enumerate(terms) for x in (F.lit(t), F.lit(1 << i))]), F.col("term")) if len(terms) < 63 else None
    held = F.array_sort(F.collect_set("term")) if bit is None else F.bit_or(bit)
    score = F.sum(F.when(F.col("term").isin(wanted), F.col("score")).otherwise(0.0))
    at = [F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(places)]
    return rows.groupBy("id", "block", "size").agg(score.alias("score"), held.alias("has"), *at)


def _has(query: Query, term: str) -> Column:
    terms = _terms(query)
    if len(terms) < 63:
        return F.col("has").bitwiseAND(F.lit(1 << terms.index(term))) != 0
    return F.array_contains("has", term)


def _starts(places: str, back: int) -> Column:
    """Positions of the places, moved back."""
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda p: F.shiftright(p, 2) - back)


def _holds(query: Query, places: list[str]) -> Column:
    """Whether a gathered document satisfies the query: a phrase is where the places of its words, each moved back, meet."""
    out = F.lit(False)
    for way in query.ways:
        both = F.lit(True)
        for sign, terms in way:
            one = F.lit(True)
            for t in set(terms):
                one = one & _has(query, t)
            if len(terms) > 1:
                starts = [_starts(f"p{places.index(t)}", i) for i, t in enumerate(terms)]
                common = starts[0]
                for s in starts[1:]:
                    common = F.array_intersect(common, s)
                one = one & (F.size(common) > 0)
            both = both & (one if sign else ~one)
        out = out | both
    return out


def _phrases(query: Query) -> list[str]:
    return sorted({t for way in query.ways for _, terms in way if len(terms) > 1 for t in terms})


def _read(spark: SparkSession, index: TextIndex, query: Query, places: list[str]) -> DataFrame:
    """The postings of a query's words; places only of words that need them."""
    rows = index.table(spark, "postings").where(F.col("term").isin(_terms(query)))
    return rows.select("term", "block", "id", "size", "score", *([F.when(F.col("term").isin(places), F.col("places")).alias("places")] if places else []))


def matching(spark: SparkSession, index: TextIndex, text: str, every_place: bool = False) -> DataFrame:
    """Documents that satisfy a web search query: id, block, size, score, has, places of the words of phrases (or of all).

    A way that only excludes words takes all documents without them. An empty query matches nothing.
    """
    query = parse(text)
    if not query.ways:
        return index.table(spark, "documents").select("id", "block", "size", F.lit(0.0).alias("score")).where(F.lit(False))
    places = _terms(query) if every_place else _phrases(query)
    found = _gathered(_read(spark, index, query, places), query, places)
    if not all(any(sign for sign, _ in way) for way in query.ways):
        none = F.lit(0).cast(found.schema["has"].dataType) if len(_terms(query)) < 63 else F.array().cast("array<string>")
        found = index.table(spark, "documents").join(found.drop("block", "size"), "id", "left").withColumns({"has": F.coalesce("has", none), "score": F.coalesce("score", F.lit(0.0))})
    return found.where(_holds(query, places))


def search(spark: SparkSession, index: TextIndex, text: str) -> DataFrame:
    """The ids of documents that satisfy a web search query."""
    return matching(spark, index, text).select(F.col("id").alias(index.id_))


def rank() -> Column:
    """The weights of all occurrences of wanted words, over 1 + the number of all words."""
    return F.col("score") / (1 + F.col("size"))


def bounds(spark: SparkSession, index: TextIndex, text: str) -> DataFrame:
    """What no document of a block ranks above: block, bound."""
    wanted = _terms(parse(text), True)
    return index.table(spark, "maxima").where(F.col("term").isin(wanted)).groupBy("block").agg(F.sum("most").alias("bound"))


def best(spark: SparkSession, index: TextIndex, text: str, limit: int, matched: bool = True, digits: int = 6, first: int = FIRST) -> DataFrame:
    """The best documents: id, rank (rounded to digits), by falling rank, ties to the smallest id; of those that match, or of all that hold a wanted word.

    The blocks with the highest bounds are read first. The rank of the last of the limit best there is a threshold, and
    of all others only blocks whose bound reaches it are read. With fewer than limit documents there, all blocks are.
    """
    query, caps = parse(text), bounds(spark, index, text)
    if not _terms(query, True) or matched and not all(any(sign for sign, _ in way) for way in query.ways):
        # Without a wanted word there is no bound; a way that only excludes words takes documents that hold none.
        found = matching(spark, index, text).where(F.lit(matched))
        return found.select(F.col("id").alias(index.id_), F.round(rank(), digits).alias("rank")).orderBy(F.desc("rank"), index.id_).limit(limit)
    places = _phrases(query) if matched else []

    def ranked(rows: DataFrame) -> DataFrame:
        found = _gathered(rows, query, places)
        found = found.where(_holds(query, places)) if matched else found.where("score > 0")
        return found.select("id", F.round(rank(), digits).alias("rank")).orderBy(F.desc("rank"), "id").limit(limit)

    top = [r.block for r in caps.orderBy(F.desc("bound"), "block").limit(first).collect()]
    rows = _read(spark, index, query, places)
    last = ranked(rows.where(F.col("block").isin(top))).agg(F.count("*").alias("n"), F.min("rank").alias("least")).head()
    if last.n == limit:
        rows = rows.join(caps.where(F.col("bound") >= last.least - 10.0**-digits).select("block"), "block", "left_semi")
    return ranked(rows).select(F.col("id").alias(index.id_), "rank")


def cover_density(spark: SparkSession, index: TextIndex, text: str) -> DataFrame:
    """Documents that match a query, with their cover density: id, rank. A phrase counts as its words."""
    query = parse(text)
    ways = [frozenset(t for sign, terms in way if sign for t in terms) for way in query.ways]
    ways, terms = [w for w in ways if w], _terms(query)
    wanted = [(i, t) for i, t in enumerate(terms) if any(t in w for w in ways)]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                own = [(int(p) >> 2, t, WEIGHTS[CLASSES[int(p) & 3]]) for places, (_, t) in zip(row, wanted, strict=True) if places is not None for p in places]
                out.append(density(sorted(own), ways))
            yield pd.Series(out, dtype=float)

    found = matching(spark, index, text, every_place=True)
    if not wanted:
        return found.select(F.col("id").alias(index.id_), F.lit(0.0).alias("rank"))
    return found.select(F.col("id").alias(index.id_), F.pandas_udf(score, "double")(F.struct(*[f"p{i}" for i, _ in wanted])).alias("rank"))
