"""The vector index against the exact search: recall, work, copies, odd vectors."""

import numpy as np
import pytest

from tessera.operators import ann, vectors
from tessera.plans import library


def table(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")


def shape(name, n, d=64, seed=1):
    """Vectors in clusters of several sizes and widths, in few dimensions, or in all directions alike."""
    rng = np.random.default_rng(seed)
    if name == "alike":
        return rng.standard_normal((n, d))
    if name == "few":
        return rng.standard_normal((n, 8)) @ rng.standard_normal((8, d)) + 0.05 * rng.standard_normal((n, d))
    count, width = {"many": (n // 4, 0.1), "tight": (n // 40, 0.05), "wide": (n // 40, 0.3), "large": (20, 0.1)}[name]
    return rng.standard_normal((count, d))[rng.integers(0, count, n)] + width * rng.standard_normal((n, d))


def share(u, queries, found, k=12):
    true = np.argsort(-(queries @ u.T), axis=1)[:, :k]
    return np.mean([len(set(a[:k].tolist()) & set(b.tolist())) / k for a, b in zip(found, true, strict=True)])


@pytest.mark.parametrize("name,least", [("many", 0.95), ("tight", 0.95), ("wide", 0.95), ("large", 0.95), ("few", 0.95)])
def test_one_shard_finds_new_vectors(name, least):
    """Queries that aren't stored, at a breadth of 60: under a tenth of the vectors are looked at, and 0.95 of the nearest found."""
    m = shape(name, 12_100)
    u, queries = ann.unit(m[:12_000]), ann.unit(m[12_000:])
    graph, starts = ann.linked(u)
    found, sims, compared = ann.walked(u, graph, starts, queries, 60)
    order = np.argsort(-sims, axis=1)
    got = share(u, queries, np.take_along_axis(found, order, 1))
    print(name, "recall", got, "compared", compared.mean() / len(u))
    assert got >= least and compared.mean() < 0.1 * len(u)


def test_one_shard_finds_stored_vectors_in_all_directions():
    """The hardest shape: what is stored is found with its neighbours; new vectors need more breadth."""
    m = shape("alike", 20_100)
    u = ann.unit(m[:20_000])
    graph, starts = ann.linked(u)
    for queries, breadth, least, most in ((u[::100], 60, 0.95, 0.1), (ann.unit(m[20_000:]), 60, 0.5, 0.1), (ann.unit(m[20_000:]), 480, 0.95, 0.4)):
        found, sims, compared = ann.walked(u, graph, starts, queries, breadth)
        got = share(u, queries, np.take_along_axis(found, np.argsort(-sims, axis=1), 1))
        print(breadth, "recall", got, "compared", compared.mean() / len(u))
        assert got >= least and compared.mean() < most * len(u)


def test_every_node_can_be_reached():
    """Clusters smaller than the neighbours looked at have no way out: each has a landmark of its own."""
    rng = np.random.default_rng(3)
    u = ann.unit(np.repeat(rng.standard_normal((30, 16)), 100, 0) + 1e-3 * rng.standard_normal((3000, 16)))
    graph, starts = ann.linked(u)
    reached = set(starts.tolist())
    edge = list(reached)
    while edge:
        edge = [int(t) for i in edge for t in graph[i] if t >= 0 and int(t) not in reached and not reached.add(int(t))]
    assert len({i // 100 for i in reached}) == 30 and len(reached) > 0.99 * len(u)
    assert (graph < len(u)).all() and all(i not in graph[i] for i in range(0, 3000, 7))


def test_search_over_shards(spark):
    """All ids divisible by 100 against all rows, over one shard and several: recall and work as counted."""
    m = shape("wide", 12_000)
    e = table(spark, m).repartition(4)
    asked = e.where("vec_id % 100 = 0")
    for rows, most in ((20_000, 0.1), (3_000, 0.4)):
        index = ann.build(e, "vec_id", "embedding", shard_rows=rows)
        shards = index.shards(spark).select("dims", "shard").collect()
        assert len(shards) == -(-12_000 // rows) or rows == 3_000 and 4 <= len(shards) <= 5
        got = ann.recall(e, index, asked, 12, 0.3)
        seen = [r.compared for r in ann.comparisons(index, asked, 12).collect()]
        print(rows, "recall", got, "compared", np.mean(seen) / 12_000)
        assert got >= 0.95 and len(seen) == 120 and np.mean(seen) < most * 12_000
    exact = {(r.query_id, r.vec_id): r.similarity for r in vectors.similar_to_each(e, asked, "vec_id", "embedding", 0.3, 12).collect()}
    found = ann.search(index, asked, 12, 0.3).collect()
    assert all(abs(exact.get((r.query_id, r.vec_id), r.similarity) - r.similarity) < 1e-5 and r.similarity >= 0.3 - 1e-6 for r in found)
    assert {r.query_id for r in found} == {r.vec_id for r in asked.collect()} and len(found) == len({(r.query_id, r.vec_id) for r in found})


def test_breadth_is_fitted(spark):
    """On vectors in all directions alike the breadth grows until the sample's recall is there."""
    e = table(spark, shape("alike", 3_000))
    index = ann.build(e, "vec_id", "embedding")
    new = table(spark, shape("alike", 60, seed=9), 10_000)
    breadth = ann.fitted_breadth(e, index, new, 12, 0.0, 0.95)
    assert breadth > ann.BREADTH and ann.recall(e, index, new, 12, 0.0, breadth) >= 0.95 > ann.recall(e, index, new, 12, 0.0, ann.BREADTH)


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in library.search_by_vector_index(spark, sf).collect()}
    want = {(r.query_id, r.vec_id) for r in vectors.similar_to_each(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.24, 12).collect()}
    assert len(got & want) >= 0.9 * len(want) and {q for q, _ in got} == {q for q, _ in want}


def test_copies_and_odd_vectors(spark):
    """A third of the rows one vector; nulls, nulls within, zero and empty vectors, several lengths, no rows."""
    m = shape("wide", 400, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000 + i, m[5].tolist()) for i in range(200)]
    rows += [(2000, None), (2001, [None] * 8), (2002, [0.0] * 8), (2003, []), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (2006, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    index = ann.build(df, "vec_id", "embedding", shard_rows=150)
    out = {}
    for r in ann.search(index, df.where("vec_id in (5, 1100, 7, 2000, 2002, 2003, 2004, 2006)"), 10, 0.5).collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.similarity, 5)))
    assert sorted(out[5]) == sorted(out[1100]) == [(5, 1.0)] + [(1000 + i, 1.0) for i in range(9)]
    assert (7, 1.0) in out[7] and len(out[7]) == 10 and set(out) == {5, 1100, 7, 2004} and sorted(out[2004])[:2] == [(2004, 1.0), (2005, 1.0)]
    assert index.members(spark).count() == 605
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    empty = ann.build(none, "vec_id", "embedding")
    assert ann.search(empty, df, 5, 0.0).count() == 0 and ann.search(index, none, 5, 0.0).count() == 0
