"""Searches from the index against searches that read every text, and what they read."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import search, text_index
from tessera.plans import library

SF = "/root/testdata/sf0.01"
QUERIES = [
    "sun", "sun sea", '"red sea"', '"sea sea"', '"red sea" -ice', "sun OR ice snow", "-sun", "-sun OR red", '-"red sea"', '"the red sea" ice', '"red sea" OR "sea ice" -sun', "nothing here", "", "-", "Sun, SEA!", '"sun red" "red sun"',
]
NAMES = {"A": "title", "B": "text", "D": "place"}


def documents(n=400, seed=1):
    rng = random.Random(seed)
    some = ["sun", "sea", "red", "ice", "snow", "the", "été", "x1"]
    say = lambda most: " ".join(rng.choices(some, [1, 3, 2, 1, 1, 8, 1, 1], k=rng.randint(0, most)))
    rows = [(i, say(3), say(25).replace(" the ", ", The "), rng.choice(["sea", None, "red sea"])) for i in range(n)]
    return rows + [(n, None, None, None), (n + 1, "", " \n", ""), (n + 2, "sun", "the " * 5000 + "red sea", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), "id long, title string, text string, place string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, docs):
    return text_index.build(docs, "id", fields(), block=16)


def fields():
    return {k: F.col(c) for k, c in NAMES.items()}


def whole(df):
    return df.withColumn("all", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in fields().values()]))


@pytest.mark.parametrize("text", QUERIES)
def test_matches_are_those_of_all_texts(spark, docs, index, text):
    want = sorted(r.id for r in search.search(whole(docs), F.col("all"), text).collect())
    assert sorted(r.id for r in text_index.search(spark, index, text).collect()) == want


@pytest.mark.parametrize("text", QUERIES)
@pytest.mark.parametrize("limit,matched", [(7, True), (40, False)])
def test_best_are_the_best_of_all(spark, docs, index, text, limit, matched):
    rows = search.search(whole(docs), F.col("all"), text) if matched else docs
    rows = rows.withColumn("rank", F.round(search.rank(fields(), text), 6))
    want = (rows if matched else rows.where("rank > 0")).orderBy(F.desc("rank"), "id").limit(limit)
    got = text_index.best(spark, index, text, limit, matched, first=3)
    assert got.columns == ["id", "rank"]
    assert [tuple(r) for r in got.collect()] == [(r.id, r["rank"]) for r in want.collect()]


def test_density_from_the_index(spark, docs, index):
    for text in ("sun sea", '"red sea" OR ice -snow'):
        got = {r.id: round(r["rank"], 9) for r in text_index.cover_density(spark, index, text).collect()}
        assert got == {r.id: round(r["rank"], 9) for r in search.cover_density(docs, "id", fields(), text).collect()} and got


def test_only_blocks_that_can_matter_are_read(spark):
    """A few documents rank far above the others: after the first blocks, all that is read are blocks whose bound reaches the threshold."""
    rows = [(i, "word " * (1 + i % 3) + "filler " * 60) for i in range(4000)] + [(5000 + i, "word " * 9) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string")
    index = text_index.build(df, "id", {"A": F.col("text")}, block=32)
    caps = text_index.bounds(spark, index, "word")
    top = text_index.best(spark, index, "word", 10)
    assert [r.id for r in top.collect()] == [5000 + i for i in range(10)]
    least = min(r["rank"] for r in top.collect())
    kept = caps.where(F.col("bound") >= least - 1e-6).count()
    assert kept <= 20 < 100 < caps.count()
    joined = top._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in joined
    # The bound holds for every document of a block.
    ranks = text_index.matching(spark, index, "word").select("block", text_index.rank().alias("r")).groupBy("block").agg(F.max("r").alias("r"))
    assert ranks.join(caps, "block").where("r > bound + 1e-12").count() == 0 and ranks.count() == caps.count()


def test_a_search_reads_postings_only(spark):
    """No text in the plan; the words go to the scan as a filter; few files can hold a word; places are delta-coded."""
    index = library.documents_index(spark, SF, A="text")
    plan = library.fts_match_phrase(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "postings" in plan and re.search(r"PushedFilters: \[In\(term, \[have,in,the\]\)", plan)
    assert "places" not in library.fts_match_and(spark, SF)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    files = [f.replace("file://", "") for f in index.table(spark, "postings").inputFiles()]
    bounds, coded = [], set()
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
        bounds.append((min(g.column(0).statistics.min for g in groups), max(g.column(0).statistics.max for g in groups)))
        coded |= {e for g in groups for e in g.column(5).encodings}
    assert len(files) >= 4 and sum(a <= "avec" <= b for a, b in bounds) == 1 and "DELTA_BINARY_PACKED" in coded
    assert documents_read(spark, index) == spark.read.parquet(f"{SF}/documents.parquet").count()


def documents_read(spark, index):
    return index.table(spark, "documents").select("id").distinct().count()


def test_the_index_is_made_once_for_the_same_files(spark):
    assert library.documents_index(spark, SF, A="text") is library.documents_index(spark, SF, A="text")
    assert library.documents_index(spark, SF, A="text") is not library.documents_index(spark, "/root/testdata/sf0.001", A="text")


def test_no_rows(spark):
    index = text_index.build(spark.createDataFrame([], "id long, title string, text string, place string"), "id", fields())
    assert text_index.search(spark, index, "sun -sea").count() == text_index.best(spark, index, "sun", 5).count() == text_index.cover_density(spark, index, "sun").count() == 0


def test_many_words(spark, index, docs):
    """Over 62 words a set of them stands for the flags."""
    text = " OR ".join([f"w{i}" for i in range(70)] + ['"red sea" -ice'])
    assert sorted(r.id for r in text_index.search(spark, index, text).collect()) == sorted(r.id for r in search.search(whole(docs), F.col("all"), text).collect())
