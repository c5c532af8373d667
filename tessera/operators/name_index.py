"""Names by trigrams: an index of postings, searched with a count filter, and a join of all names with all.

An index is three tables. postings: a row for each trigram and distinct lower-cased name (gram, name, n, the number of the
name's trigrams), dealt by ranges of (gram, name) and sorted; members: the ids of each name; grams: how many names have each.
Two names with a and b trigrams are similar by at least t only if they share t / (1 + t) (a + b) of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import trigrams
from tessera.session import shared_dir

#: Below a bound by less than this is on it.
SLACK = 1e-9


@dataclass(frozen=True)
class NameIndex:
    """Where an index has been written."""

    path: str
    id_: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def build(names: DataFrame, id_: str, name: str, path: str | None = None) -> NameIndex:
    """Write an index of the names that aren't null and say where it is. Names that differ by case only are one name."""
    spark = names.sparkSession
    index = NameIndex(path or f"{shared_dir(spark)}/names-{uuid.uuid4().hex}", id_)
    known = names.where(F.col(name).isNotNull()).select(F.col(id_).alias("id"), F.lower(name).alias("name"))
    known.repartitionByRange("name", "id").sortWithinPartitions("name", "id").write.parquet(f"{index.path}/members")
    rows = index.table(spark, "members").select("name").distinct().select("name", trigrams(F.col("name")).alias("_g"))
    rows = rows.select(F.explode("_g").alias("gram"), "name", F.size("_g").alias("n"))
    rows.repartitionByRange("gram", "name").sortWithinPartitions("gram", "name").write.option("parquet.writer.version", "v2").parquet(f"{index.path}/postings")
    index.table(spark, "postings").groupBy("gram").agg(F.count("*").alias("names")).write.parquet(f"{index.path}/grams")
    return index


def shared_least(a: Column, b: Column, least: float) -> Column:
    """How many trigrams names with a and b of them share at least to be that similar."""
    return F.ceil(F.lit(least / (1 + least)) * (a + b) - SLACK)


def alike(spark: SparkSession, index: NameIndex, text: str, least: float) -> DataFrame:
    """Distinct names that are similar to a text, by at least so much (above 0): name, similarity.

    The postings of the text's trigrams are read alone, and counted by name; names with too many or too few trigrams
    are left before that, and with too few in common after it.
    """
    asked = spark.range(1).select(trigrams(F.lit(text)).alias("g")).head().g
    rows = index.table(spark, "postings").where(F.col("gram").isin(asked)).where((F.col("n") >= least * len(asked) - SLACK) & (F.lit(least) * F.col("n") <= len(asked) + SLACK))
    found = rows.groupBy("name", "n").agg(F.count("*").alias("c")).where(F.col("c") >= shared_least(F.col("n"), F.lit(len(asked)), least))
    return found.select("name", (F.col("c") / (F.col("n") + len(asked) - F.col("c"))).alias("similarity")).where(F.col("similarity") >= least)


def named_alike(spark: SparkSession, index: NameIndex, text: str, least: float) -> DataFrame:
    """The ids of names that are similar to a text: id, similarity."""
    return alike(spark, index, text, least).join(index.table(spark, "members"), "name").select(F.col("id").alias(index.id_), "similarity")


def candidates(spark: SparkSession, index: NameIndex, least: float) -> DataFrame:
    """Pairs of distinct names that may be that similar, each once: a, b (a < b).

    A name's trigrams are ordered from the rarest on. Of similar names each has one of its first n - least * n + 1 in
    common with the other's; frequent trigrams are last and mostly aren't among them. At the first common one, what
    may still follow has to be enough in both.
    """
    ranked = index.table(spark, "postings").join(index.table(spark, "grams"), "gram")
    own = ranked.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("names", "gram"))).alias("g"))
    n = F.size("g")
    first = own.select("name", n.alias("n"), F.posexplode(F.slice("g", F.lit(1), n - F.ceil(F.lit(least) * n - SLACK).cast("int") + 1)).alias("at", "x")).select("name", "n", "at", F.col("x.gram").alias("gram"))
    a, b = (first.select(F.col("gram"), *[F.col(c).alias(f"{c}_{s}") for c in ("name", "n", "at")]) for s in "ab")
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.lit(least) * F.greatest("n_a", "n_b") <= F.least("n_a", "n_b") + SLACK) & (left >= shared_least(F.col("n_a"), F.col("n_b"), least))
    return a.join(b, "gram").where((F.col("name_a") < F.col("name_b")) & fits).select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()


def pairs_alike(spark: SparkSession, index: NameIndex, least: float) -> DataFrame:
    """All pairs of distinct names that are similar by at least so much (above 0): a, b (a < b), similarity."""
    grams = index.table(spark, "members").select("name").distinct().select("name", trigrams(F.col("name")).alias("g"))
    pairs = candidates(spark, index, least)
    both = pairs.join(grams.select(F.col("name").alias("a"), F.col("g").alias("_a")), "a").join(grams.select(F.col("name").alias("b"), F.col("g").alias("_b")), "b")
    c = F.size(F.array_intersect("_a", "_b"))
    return both.select("a", "b", (c / (F.size("_a") + F.size("_b") - c)).alias("similarity")).where(F.col("similarity") >= least)
