"""Approximate vector search over proximity graphs.

Vectors are dealt to shards of a bounded size by their content, and each shard is a graph of its own: a vector's links
are the nearest ones that aren't nearer to another link already taken, and links back. An index is a table with a row for each
shard, so that a search reads it where it lies, without a shuffle; what a search brings together are the best of each
shard. Copies of a vector are one node, told from others by a hash of 128 bits, and a second table has their ids.

Best-first search keeps the BREADTH best nodes of a query in a shard and opens the best that isn't opened yet, until all are. It
starts at the best of the landmarks, of which every node has one within two steps, so that small clusters are entered too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.vectors import _matrix, exemplars, similar_to_each
from tessera.session import shared_dir

#: Links that a node chooses (with links back it has at most twice as many), and the neighbours it chooses from.
LINKS, CONSTRUCTION = 16, 64
#: Nodes kept by a search, and where it begins.
BREADTH, ENTRIES = 60, 16
#: Vectors of a shard, at most about; and bytes of their matrix. A search has a flag for each node and query of a block.
SHARD_ROWS, SHARD_BYTES = 32_768, 64 << 20
BLOCK_BYTES, FLAGS = 16 << 20, 64 << 20


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision; zero vectors stay."""
    m = m.astype(np.float64)
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row, in falling order."""
    p = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
    return np.take_along_axis(p, np.argsort(-np.take_along_axis(s, p, 1), axis=1, kind="stable"), 1)


def nearest_in(u: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each unit vector of a shard, nearest first, by products of blocks."""
    out, step = np.empty((len(u), k), np.int32), max(1, (32 << 20) // (4 * len(u)))
    for lo in range(0, len(u), step):
        s = u[lo : lo + step] @ u.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + step] = _best(s, k)
    return out


def chosen(u: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Which neighbours are linked: from the nearest on, those that are nearer to the node than to any linked before."""
    keep = np.zeros(near.shape, bool)
    for lo in range(0, len(u), 512):
        around = u[near[lo : lo + 512]]
        own = np.einsum("bkd,bd->bk", around, u[lo : lo + 512])
        among = around @ around.transpose(0, 2, 1)
        take = np.zeros(own.shape, bool)
        for j in range(near.shape[1]):
            take[:, j] = ~((among[:, j, :] > own[:, j, None]) & take).any(1) & (take.sum(1) < links)
        keep[lo : lo + 512] = take
    return keep


def linked(u: np.ndarray, links: int = LINKS, construction: int = CONSTRUCTION) -> tuple[np.ndarray, np.ndarray]:
    """The graph of a shard: for each node the nodes it leads to, -1 where there are fewer than twice the links; and the landmarks."""
    n = len(u)
    out = np.full((n, 2 * links), -1, np.int32)
    if n < 2:
        return out, np.arange(n, dtype=np.int32)
    near = nearest_in(u, min(construction, n - 1))
    node, j = np.nonzero(chosen(u, near, links))
    other = near[node, j].astype(np.int64)
    edges = np.unique(np.concatenate([node * n + other, other * n + node]))
    a, b = edges // n, edges % n
    order = np.lexsort((b, -np.einsum("nd,nd->n", u[a], u[b]), a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
    out[a[rank < 2 * links], rank[rank < 2 * links]] = b[rank < 2 * links]
    return out, landmarks(near)


def landmarks(near: np.ndarray) -> np.ndarray:
    """Nodes of which every node has one among its nearest or theirs: in turn, where there is none yet, the one that is near to most."""
    n = len(near)
    known = np.bincount(near.ravel(), minlength=n)
    marks = np.zeros(n, bool)
    marks[: min(n, ENTRIES)] = True
    for i in range(n):
        if not marks[near[i]].any() and not marks[near[near[i]]].any():
            marks[near[i][known[near[i]].argmax()]] = True
    return np.flatnonzero(marks).astype(np.int32)


def walked(u: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search for all queries at once: nodes (-1 for none), similarities, and how many vectors each query was compared with."""
    q, n = len(queries), len(u)
    first = queries @ u[starts].T
    entry = _best(first, min(ENTRIES, len(starts)))
    breadth = max(breadth, entry.shape[1])
    found = np.full((q, breadth), -1, np.int64)
    sims = np.full((q, breadth), -np.inf, np.float32)
    found[:, : entry.shape[1]], sims[:, : entry.shape[1]] = starts[entry], np.take_along_axis(first, entry, 1)
    opened = found < 0
    seen = np.zeros((q, n), bool)
    seen[:, starts] = True
    compared, active = np.full(q, len(starts)), np.arange(q)
    while len(active):
        s = np.where(opened[active], -np.inf, sims[active])
        at = s.argmax(1)
        live = np.isfinite(s[np.arange(len(active)), at])
        active, at = active[live], at[live]
        if not len(active):
            break
        opened[active, at] = True
        to = graph[found[active, at]]
        i, j = np.nonzero((to >= 0) & ~seen[active[:, None], np.maximum(to, 0)])
        node = to[i, j]
        seen[active[i], node] = True
        more = np.full(to.shape, -np.inf, np.float32)
        more[i, j] = np.einsum("nd,nd->n", queries[active[i]], u[node])
        compared[active] += np.bincount(i, minlength=len(active))
        all_ = np.hstack([sims[active], more])
        keep = np.argpartition(-all_, breadth - 1, axis=1)[:, :breadth]
        sims[active] = np.take_along_axis(all_, keep, 1)
        found[active] = np.take_along_axis(np.hstack([found[active], to]), keep, 1)
        opened[active] = np.take_along_axis(np.hstack([opened[active], ~np.isfinite(more)]), keep, 1)
    found[~np.isfinite(sims)] = -1
    return found, sims, compared


def _lists(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Index:
    """Where an index has been written: shards (dims, shard, keys, vectors, links, starts) and members (the ids of each node)."""

    path: str
    id_: str
    vector: str

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/shards")

    def members(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/members")


def _keyed(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<float>")
    return vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(id_).alias("_id"), v.alias("_v"), F.xxhash64(v).alias("_k"), F.xxhash64(F.lit(1), v).alias("_l"))


def build(vectors: DataFrame, id_: str, vector: str, path: str | None = None, shard_rows: int = SHARD_ROWS, links: int = LINKS, construction: int = CONSTRUCTION) -> Index:
    """Write an index of all vectors (without null ones, or such that hold a null) and say where it is.

    Vectors of another length have shards of their own. A shard takes shard_rows vectors, or as many as fill SHARD_BYTES.
    The work is in proportion to the number of vectors times the size of a shard.
    """
    spark = vectors.sparkSession
    index = Index(path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", id_, vector)
    rows = _keyed(vectors, id_, vector)
    rows.select("_k", "_l", "_id").write.parquet(f"{index.path}/members")
    # The first of equal vectors stands for all: partial results are combined before anything is shuffled.
    nodes = rows.groupBy("_k", "_l").agg(F.first("_v").alias("_v")).withColumn("_d", F.size("_v")).where("_d > 0")
    dims = rows.groupBy(F.size("_v").alias("_d")).agg(F.approx_count_distinct("_k", 0.02).alias("n"))
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(shard_rows)), F.lit(float(SHARD_BYTES)) / (4 * F.greatest("_d", F.lit(1)))))
    counts = dims.select("_d", F.ceil(F.col("n") / room).alias("_shards"))
    dealt = nodes.join(F.broadcast(counts), "_d").withColumn("_s", F.pmod(F.col("_k"), F.greatest("_shards", F.lit(1))))

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        own = table.combine_chunks()
        order = np.lexsort((own["_l"].to_numpy(), own["_k"].to_numpy()))
        own = own.take(pa.array(order))
        m = _lists(own["_v"].combine_chunks()).astype(np.float32)
        graph, starts = linked(unit(m), links, construction)
        return pa.Table.from_pydict(
            {
                "dims": pa.array([m.shape[1]], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()),
                "keys": pa.array([np.stack([own["_k"].to_numpy(), own["_l"].to_numpy()], 1).tobytes()], pa.binary()),
                "vectors": pa.array([m.tobytes()], pa.binary()), "links": pa.array([graph.tobytes()], pa.binary()), "starts": pa.array([starts.tobytes()], pa.binary()),
            }
        )

    made = dealt.select("_d", "_s", "_k", "_l", "_v").groupBy("_d", "_s").applyInArrow(shard, "dims int, shard long, keys binary, vectors binary, links binary, starts binary")
    made.write.parquet(f"{index.path}/shards")
    return index


def _visits(index: Index, queries: DataFrame, breadth: int, limit: int, least: float) -> DataFrame:
    """For each query and shard what was found: query_id, dims, shard, compared, similarity, _k, _l (null where nothing was)."""
    spark = queries.sparkSession
    given = queries.where(F.col(index.vector).isNotNull()).select(F.col(index.id_).alias("_i"), F.col(index.vector).cast("array<float>").alias("_v"))
    size = given.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("_v")), F.lit(1)).alias("d")).head()
    blocks = max(1, -(-(size.n * size.d * 4) // BLOCK_BYTES))
    kind, type_ = given.schema["_i"].dataType.simpleString(), to_arrow_type(given.schema["_i"].dataType)
    shards, breadth, out = index.shards(spark), max(breadth, limit), None

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            column = pa.array([v for _, v in sent.value], pa.list_(pa.float32()))
            ids = pa.array([i for i, _ in sent.value], type_)
            for batch in batches:
                for k in range(batch.num_rows):
                    d, shard, *raw = (batch.column(c)[k].as_py() for c in range(6))
                    at, asked = _matrix(column, d)
                    if not len(at):
                        continue
                    u = unit(np.frombuffer(raw[1], np.float32).reshape(-1, d))
                    keys, graph, starts = np.frombuffer(raw[0], np.int64).reshape(-1, 2), np.frombuffer(raw[2], np.int32).reshape(len(u), -1), np.frombuffer(raw[3], np.int32)
                    step = max(1, FLAGS // len(u))
                    for lo in range(0, len(at), step):
                        found, sims, compared = walked(u, graph, starts, unit(asked[lo : lo + step]), breadth)
                        best = _best(sims, min(limit, sims.shape[1]))
                        node, s = np.take_along_axis(found, best, 1), np.take_along_axis(sims, best, 1).astype(float)
                        node[s < least] = -1
                        # A first row always, for what was compared.
                        i, j = np.nonzero((node >= 0) | (np.arange(node.shape[1]) == 0))
                        hit = node[i, j] >= 0
                        key = keys[np.maximum(node[i, j], 0)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(at[lo + i])), pa.array(np.full(len(i), d, np.int32)), pa.array(np.full(len(i), shard)), pa.array(compared[i]),
                                pa.array(s[i, j], mask=~hit), pa.array(key[:, 0], mask=~hit), pa.array(key[:, 1], mask=~hit),
                            ],
                            ["query_id", "dims", "shard", "compared", "similarity", "_k", "_l"],
                        )

        return run

    for b in range(blocks):
        own = given.where(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in own.toLocalIterator()])
        one = shards.select("dims", "shard", "keys", "vectors", "links", "starts").mapInArrow(search(sent), f"query_id {kind}, dims int, shard long, compared long, similarity double, _k long, _l long")
        out = one if out is None else out.unionByName(one)
    return out


def search(index: Index, queries: DataFrame, limit: int, least: float, breadth: int = BREADTH) -> DataFrame:
    """The most similar vectors of each query above a threshold: query_id, id, similarity (of single precision); approximate.

    queries have the index's id and vector columns. Each shard gives its best limit nodes. The ids of a node are
    cut to the smallest limit ones before they are joined, as no more of them can be among the best. Null queries, and
    such of a length that the index hasn't, find nothing; a stored vector finds itself.
    """
    spark = queries.sparkSession
    hits = exemplars(_visits(index, queries, breadth, limit, least).where("_k is not null"), "query_id", [F.desc("similarity"), F.col("_k"), F.col("_l")], limit).drop("rank")
    members = index.members(spark).withColumn("_node", F.struct("_k", "_l"))
    first = exemplars(members, "_node", [F.col("_id")], limit).select("_k", "_l", F.col("_id").alias(index.id_))
    found = hits.join(first, ["_k", "_l"]).select("query_id", index.id_, "similarity")
    return exemplars(found, "query_id", [F.desc("similarity"), F.col(index.id_)], limit).drop("rank")


def comparisons(index: Index, queries: DataFrame, limit: int, breadth: int = BREADTH) -> DataFrame:
    """How many vectors each query is compared with in a search: query_id, compared."""
    visits = _visits(index, queries, breadth, limit, -2.0).groupBy("query_id", "dims", "shard").agg(F.max("compared").alias("n"))
    return visits.groupBy("query_id").agg(F.sum("n").alias("compared"))


def recall(vectors: DataFrame, index: Index, queries: DataFrame, limit: int, least: float, breadth: int = BREADTH) -> float:
    """The share of the exact search's results (ties with its last one included) that the index finds."""
    exact = similar_to_each(vectors, queries, index.id_, index.vector, least, limit)
    enough = exact.groupBy("query_id").agg(F.min("similarity").alias("_last"), F.count("*").alias("_n"))
    found = search(index, queries, limit, least, breadth).join(enough, "query_id")
    right = found.where(F.col("similarity") >= F.col("_last") - 1e-6).groupBy("query_id").agg(F.count("*").alias("_r"), F.first("_n").alias("_n"))
    got = right.agg(F.sum(F.least("_r", "_n"))).head()[0] or 0
    wanted = enough.agg(F.sum("_n")).head()[0]
    return got / wanted if wanted else 1.0


def fitted_breadth(vectors: DataFrame, index: Index, sample: DataFrame, limit: int, least: float, wanted: float = 0.95, most: int = 4096) -> int:
    """The least breadth, doubled from BREADTH, that finds the wanted share for a sample of queries, which is to be small."""
    breadth = max(BREADTH, limit)
    while breadth < most and recall(vectors, index, sample, limit, least, breadth) < wanted:
        breadth *= 2
    return breadth
