"""Exact dedup against a plain loop, and the promise of its summaries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm import SCHEMA, corpus, odd

from tessera.llm import exact_dedup


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    return sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)


def rows_():
    rows = [r[:3] for r in corpus(3, 80)]
    # A hot text in two cases, one that differs by a letter beyond ASCII, and texts found twice.
    rows += [(1000 + i, "Hot ÉTEXT" if i % 2 else "hot Étext", None) for i in range(120)] + [(2000, "hot étext", None)]
    rows += [(3000 + i, f"twice {i // 2}", "x") for i in range(60)] + [(4000 + i, None, None) for i in range(5)]
    return rows


@pytest.mark.parametrize("counters", [1, 2, 7, 2048])
def test_against_a_plain_loop(spark, counters):
    rows = rows_()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    out = exact_dedup.marked(docs, passed=["doc_id"], counters=counters)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, out.collect())) == brute(rows)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    best = {lower(t): (i, t, x) for i, t, x in sorted(rows, key=lambda r: r[0])}
    assert sorted(map(tuple, kept.collect())) == sorted(best.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=40), min_size=1, max_size=6), st.integers(1, 6), st.randoms())
def test_summaries_keep_what_is_frequent(parts, most, order):
    """However rows are dealt and summaries merged: no count above the true one, none short by more than n / (most + 1)."""
    own = []
    for part in parts:
        counts = Counter()
        for x in part:
            counts = exact_dedup.pruned(counts + Counter([x]), most)
        own.append((len(part), counts))
    while len(own) > 1:
        order.shuffle(own)
        own.append(exact_dedup.merged(own.pop(), own.pop(), most))
    n, counts = own[0]
    true = Counter(x for p in parts for x in p)
    assert n == true.total() and len(counts) <= most
    assert all(true[k] - n / (most + 1) <= counts[k] <= true[k] for k in true)


def test_frequent_digests_do_not_shuffle(spark, monkeypatch):
    """The rows that go through the shuffle are those of digests without a winner that was broadcast."""
    rows = [(i, "hot" if i % 3 else f"own {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    n, counts = exact_dedup.summary(docs.select(F.unhex(F.sha2("text", 256)).alias("k")), 8)
    hot = hashlib.sha256(b"hot").digest()
    assert n == 900 and 600 - 900 / 9 <= counts[hot] <= 600 and len(counts) <= 8
    out = exact_dedup.marked(docs, counters=8).collect()
    assert [r for r in out if r.kept and r.text == "hot"][0].doc_id == max(i for i, t in rows if t == "hot")
    assert sum(r.kept for r in out) == 301 and len(out) == 900


def test_odd(spark):
    """Null ids, repeated rows, one id with two texts, clashing names, no rows."""
    df = odd(spark).withColumn("group_size", F.lit("mine")).withColumn("_key", F.lit("k")).withColumn("_doc", F.lit(1))
    out = exact_dedup.marked(df).collect()
    assert len(out) == 6 and out[0].__fields__.count("kept") == 1 and set(out[0].__fields__) >= {"_id", "_key", "_doc"}
    long = [r for r in out if r.text and len(r.text) > 100]
    assert {(r.keep_id, r.group_size) for r in long} == {(5, 3)} and sum(r.kept for r in long) == 1 and all(r.doc_id == 5 for r in long if r.kept)
    assert [(r.doc_id, r.keep_id, r.kept) for r in out if r.text == "short"] == [(None, None, True)]
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 4
    nobody = spark.createDataFrame([(None, "a"), (None, "A"), (None, "a")], "doc_id long, text string")
    assert sorted((r.keep_id, r.group_size, r.kept) for r in exact_dedup.marked(nobody).collect()) == [(None, 3, False), (None, 3, False), (None, 3, True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.marked(empty).count() == 0 and exact_dedup.keep_one(empty).columns == empty.columns
    huge = spark.createDataFrame([(1, "A" * 3_000_000), (2, "a" * 3_000_000), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.marked(huge, passed=["doc_id"]).collect()) == [(1, 2), (2, 2), (3, 3)]
