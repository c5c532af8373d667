"""Names by trigrams against comparing every two."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import name_index, search


def grams(name):
    x = f"  {name.lower()} "
    return {x[i : i + 3] for i in range(len(x) - 2)}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def names(n=150, seed=2):
    rng = random.Random(seed)
    ends = ["son", "sen", "berg", "ova", "ez", "é"]
    made = ["".join(rng.choices("abcdeoilnr", k=rng.randint(0, 6))).title() + rng.choice(ends) for _ in range(n)]
    return made + ["Ann", "ann", "ANN", "anna", "", "a", "aaaaaaaaaa", "aaaa", "x y z", "Customer#000000001", "Customer#000000002", "customer#000000011", "z" * 3000, None]


@pytest.fixture(scope="module")
def index(spark):
    return name_index.build(spark.createDataFrame(list(enumerate(names())), "id long, name string").repartition(3), "id", "name")


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75, 1.0])
def test_pairs_are_those_of_comparing_every_two(spark, index, least):
    own = sorted({x.lower() for x in names() if x is not None})
    want = {(a, b): similarity(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if similarity(a, b) >= least}
    rows = name_index.pairs_alike(spark, index, least).collect()
    got = {(r.a, r.b): r.similarity for r in rows}
    assert len(rows) == len(got) and got == pytest.approx(want) and (want or least == 1.0)


def test_few_pairs_are_compared(spark, index):
    own = {x.lower() for x in names() if x is not None}
    every = len(own) * (len(own) - 1) // 2
    counts = [name_index.candidates(spark, index, least).count() for least in (0.3, 0.5, 0.75)]
    print(every, counts)
    assert counts[0] < 0.4 * every and counts[1] < 0.1 * every and counts[2] < 0.02 * every


@pytest.mark.parametrize("text,least", [("Anna", 0.3), ("anderson", 0.2), ("", 0.5), ("customer#00000000", 0.7), ("zzzzz", 0.01), ("nobody at all", 0.9)])
def test_alike_are_those_of_comparing_all(spark, index, text, least):
    rows = [(i, x) for i, x in enumerate(names()) if x is not None]
    want = {i: similarity(text, x) for i, x in rows if similarity(text, x) >= least}
    assert {r.id: r.similarity for r in name_index.named_alike(spark, index, text, least).collect()} == pytest.approx(want)
    plain = spark.createDataFrame(rows, "id long, name string").select("id", search.trigram_similarity(F.col("name"), text).alias("s")).where(F.col("s") >= least)
    assert {r.id: r.s for r in plain.collect()} == pytest.approx(want)


def test_a_search_reads_the_postings_of_its_trigrams(spark, index):
    plan = name_index.alike(spark, index, "ann", 0.4)._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan and "members" not in plan


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.floats(0.05, 1.0))
def test_count_filter_is_a_bound(a, b, least):
    """Whatever two names share: similar enough means enough in common, and lengths that fit."""
    import math

    for c in range(min(a, b) + 1):
        if c / (a + b - c) >= least:
            assert c >= math.ceil(least / (1 + least) * (a + b) - name_index.SLACK)
            assert least * max(a, b) <= min(a, b) + name_index.SLACK


def test_no_names(spark):
    index = name_index.build(spark.createDataFrame([(1, None)], "id long, name string"), "id", "name")
    assert name_index.pairs_alike(spark, index, 0.3).count() == name_index.named_alike(spark, index, "a", 0.1).count() == 0
