"""Nearest places against measuring all."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.media import haversine_km
from tessera.operators import geo


def globe(n, seed, dense=0.0):
    """Positions all over the globe, some at poles and at the date line, a share of them in one town."""
    rng = np.random.default_rng(seed)
    lat, lng = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    town = rng.random(n) < dense
    lat[town], lng[town] = 48 + rng.normal(0, 0.01, town.sum()), 11 + rng.normal(0, 0.01, town.sum())
    lat[:6], lng[:6] = [90, -90, 89.99, -89.99, 0, 0], [0, 77, 179.9, -120, 180, -179.99]
    return lat, lng


def brute(p, q):
    km = geo.km_between(p[0][:, None], p[1][:, None], q[0][None], q[1][None])
    return km.argmin(1), km.min(1)


@pytest.mark.parametrize("dense,points,places", [(0.0, 500, 2000), (0.4, 500, 2000), (1.0, 300, 700), (0.0, 50, 1), (0.3, 50, 17), (0.0, 1, 16)])
def test_tree_equals_measuring_all(dense, points, places):
    p, q = globe(max(points, 6), 1, dense), globe(max(places, 6), 2, dense)
    tree = geo.tree_of(geo.on_ball(*q))
    point, place, _ = geo.nearest_in(tree, geo.on_ball(*p))
    km = geo.km_between(p[0][point], p[1][point], q[0][place], q[1][place])
    best = {}
    for i, j, d in zip(point.tolist(), place.tolist(), km.tolist(), strict=True):
        best[i] = min(best.get(i, (np.inf, 0)), (d, j))
    at, least = brute(p, q)
    assert [best[i] for i in range(len(p[0]))] == list(zip(least.tolist(), at.tolist(), strict=True))
    assert sorted(tree.order.tolist()) == list(range(len(q[0])))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([-90, -89.9, -1, 0, 0.5, 1, 89.9, 90]), st.sampled_from([-180, -179.9, -90, 0, 0.5, 90, 179.9, 180])), min_size=1, max_size=60), st.integers(0, 5))
def test_ties_and_copies(places, seed):
    """Equal places, equal distances, points on places: every nearest place is among the pairs."""
    q = np.array([p[0] for p in places], float), np.array([p[1] for p in places], float)
    rng = np.random.default_rng(seed)
    p = np.r_[rng.uniform(-90, 90, 10), q[0]], np.r_[rng.uniform(-180, 180, 10), q[1]]
    point, place, _ = geo.nearest_in(geo.tree_of(geo.on_ball(*q)), geo.on_ball(*p))
    got = set(zip(point.tolist(), place.tolist(), strict=True))
    at, _ = brute(p, q)
    assert all((i, int(j)) in got for i, j in enumerate(at))


@pytest.mark.parametrize("dense", [0.0, 0.5])
def test_pairs_grow_with_the_points_only(dense):
    """Sixteen times the places: hardly more pairs for each point."""
    p, counts = geo.on_ball(*globe(2000, 3, dense)), []
    for n in (4_000, 64_000):
        counts.append(geo.nearest_in(geo.tree_of(geo.on_ball(*globe(n, 4, dense))), p)[2] / 2000)
    print(counts)
    assert max(counts) < 200 and counts[1] < 1.5 * counts[0]


@pytest.mark.parametrize("most", [200_000, 300])
def test_nearest(spark, most):
    """Rows, keys of text, one block and several, against an expression over all pairs."""
    (plat, plng), (qlat, qlng) = globe(300, 5, 0.3), globe(900, 6, 0.3)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(plat, plng, strict=True))] + [(900, None, 1.0), (901, 1.0, float("nan"))], "id long, lat double, lng double").repartition(3)
    rows = [(f"k{i:04}", float(a), float(b)) for i, (a, b) in enumerate(zip(qlat, qlng, strict=True))]
    places = spark.createDataFrame(rows + [("a", None, None), (None, 0.0, 0.0), ("zz", rows[0][1], rows[0][2])], "place string, lat double, lng double")
    got = {r.id: (r.place, r.km) for r in geo.nearest(points, places, "id", "place", most).collect()}
    pairs = points.where("id < 900").crossJoin(places.where("place is not null and lat is not null").withColumnsRenamed({"lat": "a", "lng": "b"}))
    want = pairs.groupBy("id").agg(F.min(F.struct(F.round(haversine_km(F.col("lat"), F.col("lng"), F.col("a"), F.col("b")), 6).alias("km"), "place")).alias("t"))
    want = {r.id: (r.t.place, r.t.km) for r in want.collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()} and all(abs(got[i][1] - want[i][1]) < 1e-5 for i in want)
    assert geo.nearest(points, places.where("place = 'a'"), "id", "place", most).count() == 0 and geo.nearest(points.where("id > 900"), places, "id", "place").count() == 0
