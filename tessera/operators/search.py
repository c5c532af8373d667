"""Text search: weighted terms, websearch queries, a deterministic rank, trigrams, hybrid names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import words

# Weights of the classes A, B, C, D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


@dataclass(frozen=True)
class Query:
    """A disjunction of conjunctions; a term is a tuple of words (a phrase if more than one) with a sign."""

    ways: tuple[tuple[tuple[bool, tuple[str, ...]], ...], ...]


def parse(text: str) -> Query:
    """Web search syntax: words are all wanted, "..." is a phrase, or separates alternatives, - excludes."""
    ways: list[list[tuple[bool, tuple[str, ...]]]] = [[]]
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not sign:
            ways.append([])
            continue
        terms = tuple(w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w)
        if terms:
            ways[-1].append((sign != "-", terms))
    return Query(tuple(tuple(w) for w in ways if w))


def _has(tokens: Column, terms: tuple[str, ...]) -> Column:
    """Tokens hold no spaces, so a phrase is a piece of them joined by spaces, found in one pass."""
    if len(terms) == 1:
        return F.array_contains(tokens, terms[0])
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(terms) + " ")


def matches(tokens: Column, query: Query) -> Column:
    """Whether a token array satisfies the query; an empty query matches nothing."""
    out = F.lit(False)
    for way in query.ways:
        both = F.lit(True)
        for wanted, terms in way:
            both = both & (_has(tokens, terms) if wanted else ~_has(tokens, terms))
        out = out | both
    return out


def search(docs: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows whose text matches. Tokens are made once for each row."""
    return docs.withColumn("_tokens", words(text)).where(matches(F.col("_tokens"), parse(query))).drop("_tokens")


def rank(fields: dict[str, Column], query: str) -> Column:
    """The weights of all occurrences of wanted words over the fields by weight class, over 1 + the number of all words.

    A stand-in for cover density with the same weights; match sets are what is held to be equal.
    """
    wanted = sorted({t for way in parse(query).ways for sign, terms in way if sign for t in terms})
    if not wanted:
        return F.lit(0.0)
    score, size = F.lit(0.0), F.lit(0)
    for weight, field in fields.items():
        own = words(F.coalesce(field, F.lit("")))
        score = score + F.size(F.filter(own, lambda w: w.isin(*wanted))) * F.lit(WEIGHTS[weight])
        size = size + F.size(own)
    return score / (1 + size)


def covers(places: list[tuple[int, str, float]], ways: list[frozenset[str]]) -> list[tuple[int, int]]:
    """The shortest stretches of places, from the first to the last, that hold all words of one of the ways; places are (position, word, weight) in order."""
    held = lambda words: any(way <= words for way in ways)
    out, begin = [], 0
    while True:
        seen: set[str] = set()
        end = next((i for i in range(begin, len(places)) if seen.add(places[i][1]) or held(seen)), None)
        if end is None:
            return out
        seen = set()
        first = next(i for i in range(end, begin - 1, -1) if seen.add(places[i][1]) or held(seen))
        out.append((first, end))
        begin = first + 1


def density(places: list[tuple[int, str, float]], ways: list[frozenset[str]]) -> float:
    """The sum over covers of their mean weight (harmonic), over 1 + the number of other words in them."""
    total = 0.0
    for first, end in covers(places, ways):
        n = end - first + 1
        noise = places[end][0] - places[first][0] - (end - first)
        total += n / sum(1 / w for _, _, w in places[first : end + 1]) / (1 + max(noise, 0))
    return total


def cover_density(docs: DataFrame, id_: str, fields: dict[str, Column], query: str) -> DataFrame:
    """Documents that match a query, with their cover density: id, rank.

    The words of all fields stand one after the other, with the weight of their class. A phrase counts as its
    words. Words are found, and matches told apart, by expressions; what goes to Python are the places of the
    query's words in documents that match.
    """
    asked = parse(query)
    ways = [frozenset(t for sign, terms in way if sign for t in terms) for way in asked.ways]
    ways = [w for w in ways if w]
    wanted = sorted(frozenset().union(*ways))

    def weighted(weight: str, field: Column) -> Column:
        return F.transform(words(F.coalesce(field, F.lit(""))), lambda w: F.struct(w.alias("w"), F.lit(WEIGHTS[weight]).alias("k")))

    own = F.concat(*[weighted(k, c) for k, c in fields.items()])
    rows = docs.select(F.col(id_), own.alias("_t")).where(matches(F.transform("_t", lambda x: x["w"]), asked))
    at = F.filter(F.transform("_t", lambda x, i: F.struct(i.alias("i"), x["w"].alias("w"), x["k"].alias("k"))), lambda x: x["w"].isin(*wanted))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([density([(x["i"], x["w"], x["k"]) for x in own], ways) for own in s], dtype=float)

    return rows.select(id_, at.alias("_p")).select(id_, F.pandas_udf(score, "double")("_p").alias("rank"))


def inverted_index(docs: DataFrame, id_: str, fields: dict[str, Column]) -> DataFrame:
    """Term rows: term, id, weight, position; write it bucketed by term for repeated searches."""
    parts = [docs.select(id_, F.lit(w).alias("weight"), F.posexplode(words(F.coalesce(c, F.lit("")))).alias("position", "term")) for w, c in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("term", id_, "weight", "position")


def trigrams(name: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(name: Column, other: str) -> Column:
    a, b = trigrams(name), trigrams(F.lit(other))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def persons_named(spark: SparkSession, query: str, persons: DataFrame) -> DataFrame:
    """The person with the smallest id whose name is one of the query's words, and the query without that word: person_id, rest; no row without one.

    persons: person_id, name. The words of a query are few; they are joined with the names, whatever their number.
    """
    own = query.split()
    words = spark.createDataFrame([(i, w, " ".join(own[:i] + own[i + 1 :])) for i, w in enumerate(own)], "_i long, _w string, rest string")
    hits = persons.join(words, F.lower("name") == F.lower("_w"))
    top = hits.agg(F.min(F.struct("person_id", "_i", "rest")).alias("t")).where("t is not null")
    return top.select("t.person_id", "t.rest")
