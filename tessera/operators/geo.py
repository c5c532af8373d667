"""Places on the globe: the nearest one of each point, by a k-d tree.

Points and places are taken as points of the unit ball, where a straight line orders them as the way over the surface does, so
poles and the date line are places like any other. The tree is sent to the tasks, and points stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Places of a leaf; points of a task that go down the tree together; what two squared distances may differ by and be compared exactly.
LEAF, TOGETHER, SLACK = 16, 4096, 1e-12
EARTH_KM = 6371.0


def on_ball(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    lat, lng = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], 1)


def km_between(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """Haversine distances, rounded to 9 digits."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return np.round(2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0))), 9)


@dataclass
class Tree:
    """Places in the order of the leaves. Level k has 2^k nodes; a node has the box of its places, and edges[k] where they begin."""

    order: np.ndarray
    xyz: np.ndarray
    edges: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]


def tree_of(xyz: np.ndarray) -> Tree:
    """Halved at the median of the widest side, level by level, until a leaf holds LEAF places at most."""
    order, edges = np.arange(len(xyz)), [np.array([0, len(xyz)])]
    low, high = [], []
    while True:
        at = edges[-1]
        own = xyz[order]
        low.append(np.minimum.reduceat(own, at[:-1]))
        high.append(np.maximum.reduceat(own, at[:-1]))
        if np.diff(at).max() <= LEAF:
            return Tree(order, own, edges, low, high)
        side = (high[-1] - low[-1]).argmax(1)
        node = np.repeat(np.arange(len(side)), np.diff(at))
        order = order[np.lexsort((own[np.arange(len(own)), side[node]], node))]
        edges.append(np.sort(np.concatenate([at, (at[:-1] + at[1:]) // 2])))


def nearest_in(tree: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (point, place) that hold the nearest places of each point and all as near to within SLACK; and how many pairs were measured.

    All points go down together. A box can hold a nearest place only if it begins nearer than some other box of
    the point ends.
    """
    point, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    reach = np.full(len(points), np.inf)
    for low, high in zip(tree.low, tree.high, strict=True):
        if low is not tree.low[0]:
            point, node = np.repeat(point, 2), (node[:, None] * 2 + np.arange(2)).ravel()
        p, a, b = points[point], low[node], high[node]
        begins = (np.maximum(np.maximum(a - p, p - b), 0) ** 2).sum(1)
        np.minimum.at(reach, point, (np.maximum(np.abs(p - a), np.abs(p - b)) ** 2).sum(1))
        keep = begins <= reach[point] + SLACK
        point, node = point[keep], node[keep]
    first, size = tree.edges[-1][node], np.diff(tree.edges[-1])[node]
    point = np.repeat(point, size)
    place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    far = ((points[point] - tree.xyz[place]) ** 2).sum(1)
    best = np.full(len(points), np.inf)
    np.minimum.at(best, point, far)
    near = far <= best[point] + SLACK
    return point[near], tree.order[place[near]], len(far)


def nearest(points: DataFrame, places: DataFrame, id_: str, key: str, most: int = 200_000) -> DataFrame:
    """The nearest place of each point, ties to the smallest key: id, key, km. Both have lat and lng.

    Places go to the tasks as trees of most places at once; a point meets some tens of a tree's places, whatever their
    number, and is shuffled only if there is more than one tree, to find the best of them. Points and places without
    a finite position are left out; without places there are no rows.
    """
    here = F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.abs("lat") < 1e6) & (F.abs("lng") < 1e6)
    known = places.where(here & F.col(key).isNotNull()).select(F.col(key), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    blocks = 1 + known.count() // most
    kind, type_ = places.schema[key].dataType.simpleString(), to_arrow_type(places.schema[key].dataType)
    rows = points.where(here).select(F.col(id_), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))

    def found(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, lat, lng, tree = sent.value
            for batch in batches:
                lats, lngs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                for lo in range(0, len(lats), TOGETHER):
                    own = slice(lo, lo + TOGETHER)
                    point, place, _ = nearest_in(tree, on_ball(lats[own], lngs[own]))
                    km = km_between(lats[own][point], lngs[own][point], lat[place], lng[place])
                    # Places are in the order of their keys.
                    order = np.lexsort((place, km, point))
                    top = order[np.r_[True, point[order][1:] != point[order][:-1]]]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(lo + point[top])) for c in range(3)), keys.take(pa.array(place[top])), pa.array(km[top])], [id_, "lat", "lng", "_key", "km"])

        return run

    best = None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).orderBy(key).toLocalIterator()
        own = [tuple(r) for r in part]
        if not own:
            continue
        lat, lng = np.array([r[1] for r in own]), np.array([r[2] for r in own])
        sent = points.sparkSession.sparkContext.broadcast((pa.array([r[0] for r in own], type_), lat, lng, tree_of(on_ball(lat, lng))))
        one = rows.mapInArrow(found(sent), f"{id_} {points.schema[id_].dataType.simpleString()}, lat double, lng double, _key {kind}, km double")
        best = one if best is None else best.unionByName(one)
    if best is None:
        return rows.select(id_, F.lit(None).cast(kind).alias(key), F.lit(0.0).alias("km")).where(F.lit(False))
    if blocks > 1:
        best = best.groupBy(id_, "lat", "lng").agg(F.min(F.struct("km", "_key")).alias("_top")).select(id_, F.col("_top._key").alias("_key"), F.col("_top.km").alias("km"))
    return best.select(id_, F.col("_key").alias(key), "km")
