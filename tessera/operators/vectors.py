"""Vector expressions and searches: cosine, top-k, centroids, exemplars, cluster assignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column, floor: float | None = None) -> Column:
    """Divided by its length; a zero vector stays as it is, or with floor is divided by that at least."""
    n = norm(v) if floor is None else F.greatest(norm(v), F.lit(floor))
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors and for different lengths."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def moved_centroid(centroid: Column, n: Column, v: Column) -> Column:
    """Centroid of n vectors after one more, normalised."""
    return normalized(F.zip_with(doubles(centroid), doubles(v), lambda c, x: c * n + x))


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have size elements, and these as a matrix, without a Python object for each."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False))
    rows = np.flatnonzero(lengths == size)
    flat = pc.fill_null(column.take(pa.array(rows)).flatten(), float("nan")) if len(rows) else pa.array([], pa.float64())
    return rows, flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), size)


def similar_to(vectors: DataFrame, query: Sequence[float], id_: str, vector: str, least: float, limit: int, exclude: object = None) -> DataFrame:
    """The most similar vectors to a query vector above a threshold: id, similarity.

    The scan multiplies whole Arrow batches with the query, read as one array; only matching ids and similarities
    leave it, and the top-k is taken in each partition first. Vectors of another length match nothing.
    """
    q = np.asarray(query, float)
    q = q / max(np.linalg.norm(q), 1e-12)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m = _matrix(batch.column(1), len(q))
            s = (m @ q) / np.maximum(np.linalg.norm(m, axis=1), 1e-12)
            hit = s >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[hit])), pa.array(s[hit])], ["_i", "similarity"])

    rows = vectors if exclude is None else vectors.where(F.col(id_) != F.lit(exclude))
    kind = vectors.schema[id_].dataType.simpleString()
    scored = rows.where(F.col(vector).isNotNull()).select(id_, vector).mapInArrow(scan, f"_i {kind}, similarity double").withColumnRenamed("_i", id_)
    return scored.orderBy(F.desc("similarity"), id_).limit(limit)


def similar_to_id(vectors: DataFrame, target: object, id_: str, vector: str, least: float = 0.55, limit: int = 12) -> DataFrame:
    """The most similar vectors to a stored one, without itself; no rows if it isn't stored."""
    row = vectors.where((F.col(id_) == F.lit(target)) & F.col(vector).isNotNull()).select(vector).head()
    if row is None:
        return vectors.select(id_, F.lit(0.0).alias("similarity")).where(F.lit(False))
    return similar_to(vectors, row[0], id_, vector, least, limit, target)


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector of each group: keys, n, mean. Vectors of a group have one length; null ones don't count.

    Each batch is summed up by group as a matrix first, so what is shuffled is a sum for each group and batch.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(list(range(len(keys))))
            groups = own.to_pandas().groupby(own.schema.names, dropna=False, sort=False).ngroup().to_numpy()
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(len(keys))), -1).to_numpy(zero_copy_only=False))
            for size in np.unique(lengths[lengths >= 0]).tolist():
                rows, m = _matrix(batch.column(len(keys)), size)
                found, first, at = np.unique(groups[rows], return_index=True, return_inverse=True)
                total = np.zeros((len(found), size))
                np.add.at(total, at, m)
                cols = [own.column(k).take(pa.array(rows[first])) for k in range(len(keys))]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * size, pa.int32()), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([*cols, flat, pa.array(np.bincount(at, minlength=len(found)), pa.int64())], [*own.schema.names, "_sum", "_n"])

    held = [f"_k{i}" for i in range(len(keys))]
    fields = ", ".join([f"{h} {df.schema[k].dataType.simpleString()}" for h, k in zip(held, keys, strict=True)] + ["_sum array<double>, _n long"])
    given = df.select(*[F.col(k).alias(h) for k, h in zip(keys, held, strict=True)], F.col(vector).alias("_v"))
    parts = given.mapInArrow(sums, fields).select(*held, "_n", F.posexplode("_sum").alias("_pos", "_x"))
    parts = parts.groupBy(*held, "_pos").agg((F.sum("_x") / F.sum("_n")).alias("_x"), F.sum("_n").alias("_n"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda p: p["_x"])
    out = parts.groupBy(*held).agg(F.max("_n").alias("n"), mean.alias("mean"))
    return out.select(*[F.col(h).alias(k) for h, k in zip(held, keys, strict=True)], "n", "mean")


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Normalised mean of each group: key, n, centroid."""
    return mean_vectors(df, [key], vector).select(key, "n", normalized(F.col("mean"), 1e-6).alias("centroid"))


def covers(df: DataFrame, cents: DataFrame, key: str, id_: str, vector: str) -> DataFrame:
    """Of each group the member closest to its centroid, ties to the smallest id: key, cover_id, similarity."""
    scored = df.join(cents.select(key, "centroid"), key).select(key, id_, F.round(dot(F.col(vector), F.col("centroid")), 9).alias("similarity"))
    top = scored.groupBy(key).agg(F.max(F.struct("similarity", (-F.col(id_)).alias("i"))).alias("top"))
    return top.select(key, (-F.col("top.i")).alias("cover_id"), F.col("top.similarity").alias("similarity"))


def exemplars(df: DataFrame, key: str, order: list[Column], n: int = 5) -> DataFrame:
    """The first n members of each group in the given order, as rank."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def assigned(df: DataFrame, cents: DataFrame, key: str, id_: str, vector: str, least: float, max_bytes: int = 64 << 20) -> DataFrame:
    """The most similar centroid of each vector above a threshold: id, key, similarity.

    The centroids are sent to every task if they are within max_bytes; otherwise they are taken in blocks of
    that size, and the best of the blocks wins.
    """
    known = cents.where(F.col(key).isNotNull() & F.col("centroid").isNotNull()).select(F.col(key).cast("long").alias("_k"), doubles(F.col("centroid")).alias("c"))
    dims = known.select(F.count("*").alias("n"), F.max(F.size("c")).alias("d")).head()
    blocks = max(1, -(-(dims["n"] * (dims["d"] or 1) * 8) // max_bytes))
    kinds = f"{id_} {df.schema[id_].dataType.simpleString()}, {key} long, similarity double"

    def nearest(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # By key, so that the first of equal similarities is the smallest key.
            by_size: dict[int, list[tuple]] = {}
            for k, c in sorted(sent.value):
                by_size.setdefault(len(c), []).append((k, c))
            own = {d: (np.array([k for k, _ in v]), np.array([c for _, c in v], float).reshape(len(v), d)) for d, v in by_size.items()}
            for batch in batches:
                for d, (keys, m) in own.items():
                    rows, x = _matrix(batch.column(1), d)
                    for lo in range(0, len(rows), 1024):
                        s = np.round(x[lo : lo + 1024] @ m.T, 9)
                        at = s.argmax(1)
                        top = s[np.arange(len(s)), at]
                        hit = top >= least
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[lo : lo + 1024][hit])), pa.array(keys[at[hit]]), pa.array(top[hit])], [id_, key, "similarity"])

        return run

    best = None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("_k"), F.lit(blocks)) == b)
        sent = df.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.toLocalIterator()])
        one = df.where(F.col(vector).isNotNull()).select(id_, vector).mapInArrow(nearest(sent), kinds)
        best = one if best is None else best.unionByName(one)
    top = best.groupBy(id_).agg(F.max(F.struct("similarity", (-F.col(key)).alias("k"))).alias("top"))
    return top.select(id_, (-F.col("top.k")).cast(cents.schema[key].dataType).alias(key), F.col("top.similarity").alias("similarity"))


def cluster_online(
    df: DataFrame, group: str, order: list[str], id_: str, vector: str, match: float = 0.72, diverse: float = 0.82, most: int = 16
) -> DataFrame:
    """Order-dependent clustering within each group: group, id, cluster (from 0), similarity.

    A vector joins the cluster of its most similar exemplar if that is similar enough and the cluster's centroid
    is too; it becomes an exemplar there if it is a new view. Otherwise it starts a cluster. The state of a group
    is its clusters' exemplars, so a group is one user's vectors.
    """
    floor = max(match - 0.05, 0.60)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        clusters: list[list[np.ndarray]] = []
        out = []
        for v in pdf[vector]:
            x = np.asarray(v, float)
            x = x / max(np.linalg.norm(x), 1e-8)
            best, top = -1, -1.0
            for c, members in enumerate(clusters):
                s = float(np.max(np.stack(members) @ x))
                if s > top:
                    best, top = c, s
            if best >= 0 and top >= match:
                mean = np.mean(clusters[best], 0)
                if float(mean @ x) / max(np.linalg.norm(mean), 1e-6) >= floor:
                    if top < diverse and len(clusters[best]) < most:
                        clusters[best].append(x)
                    out.append((best, top))
                    continue
            clusters.append([x])
            out.append((len(clusters) - 1, 1.0))
        return pd.DataFrame({group: pdf[group].to_numpy(), id_: pdf[id_].to_numpy(), "cluster": [c for c, _ in out], "similarity": [s for _, s in out]})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, id_)}
    return df.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {id_} {kinds[id_]}, cluster long, similarity double")


def similar_to_each(vectors: DataFrame, queries: DataFrame, id_: str, vector: str, least: float, limit: int, max_bytes: int = 16 << 20) -> DataFrame:
    """Exact search for many queries: query_id, id, similarity of the most similar vectors of each above a threshold, ties to the smallest id.

    The queries go to every task in blocks of max_bytes, and are multiplied as a matrix with Arrow batches of vectors; a task
    keeps the best limit vectors of each query only. A vector of another length than the query is never similar;
    a query that is stored finds itself.
    """
    given = queries.where(F.col(vector).isNotNull()).select(F.col(id_).alias("i"), doubles(F.col(vector)).alias("v"))
    dims = given.select(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).head()
    blocks = max(1, -(-(dims["n"] * (dims["d"] or 1) * 8) // max_bytes))
    kind, kept = vectors.schema[id_].dataType.simpleString(), to_arrow_type(vectors.schema[id_].dataType)

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, list[tuple]] = {}
            for i, v in sent.value:
                by_size.setdefault(len(v), []).append((i, v))
            known = {}
            for d, own in by_size.items():
                m = np.array([v for _, v in own], float).reshape(len(own), d)
                known[d] = np.array([i for i, _ in own]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            order = {"by": ["query_id", "similarity", id_], "ascending": [True, False, True]}
            found, n = [], 0
            best = lambda: pd.concat(found).sort_values(**order).groupby("query_id").head(limit)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for d, (asked, unit) in known.items():
                    rows, m = _matrix(batch.column(1), d)
                    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                    for lo in range(0, len(rows), 1024):
                        for q in range(0, len(asked), 4096):
                            sims = unit[q : q + 4096] @ m[lo : lo + 1024].T
                            i, j = np.nonzero(sims >= least)
                            found.append(pd.DataFrame({"query_id": asked[q + i], id_: ids[rows[lo + j]], "similarity": sims[i, j]}))
                            n += len(i)
                            if n > 2_000_000:
                                found = [best()]
                                n = len(found[0])
            if n:
                top = best()
                yield pa.RecordBatch.from_arrays([pa.array(top[c], t) for c, t in zip(top, (kept, kept, pa.float64()), strict=True)], list(top))

        return run

    rows = vectors.where(F.col(vector).isNotNull()).select(id_, vector)
    found = None
    for b in range(blocks):
        own = given.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        sent = vectors.sparkSession.sparkContext.broadcast([(r.i, r.v) for r in own.toLocalIterator()])
        one = rows.mapInArrow(search(sent), f"query_id {kind}, {id_} {kind}, similarity double")
        found = one if found is None else found.unionByName(one)
    return exemplars(found, "query_id", [F.desc("similarity"), F.col(id_)], limit).drop("rank")


def cluster_clips(
    faces: DataFrame, cents: DataFrame, clip: str, frame: str, id_: str, vector: str, key: str, seen: float = 0.40, match: float = 0.72
) -> DataFrame:
    """The best face of each person in each clip: clip, person (from 0 in the order met), id, score, n, the known key and its similarity, or null.

    Faces are taken by frame, falling score and id. A face is the person of an earlier face of the clip if it is
    similar enough to that person's best face, the first such person whom no other face of the frame has claimed; else
    it is a new one. Of each person the face with the highest score stands, and is compared with known centroids.
    A clip's faces are few and form a group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best: list[list] = []
        claimed: set[int] = set()
        last = None
        for f, i, v, score in pdf.sort_values([frame, "score", id_], ascending=[True, False, True])[[frame, id_, vector, "score"]].itertuples(index=False):
            if f != last:
                claimed, last = set(), f
            x = np.asarray(v, float)
            x = x / max(np.linalg.norm(x), 1e-8)
            at = next((p for p, own in enumerate(best) if p not in claimed and float(own[1] @ x) >= seen), None)
            if at is None:
                at = len(best)
                best.append([i, x, score, 0])
            elif score > best[at][2]:
                best[at][:3] = [i, x, score]
            best[at][3] += 1
            claimed.add(at)
        return pd.DataFrame({clip: pdf[clip].iloc[0], "person": range(len(best)), id_: [b[0] for b in best], "score": [b[2] for b in best], "n": [b[3] for b in best]})

    kinds = {c: faces.schema[c].dataType.simpleString() for c in (clip, id_)}
    out = faces.groupBy(clip).applyInPandas(run, f"{clip} {kinds[clip]}, person long, {id_} {kinds[id_]}, score double, n long")
    chosen = faces.join(out.select(id_), id_, "left_semi")
    return out.join(assigned(chosen, cents, key, id_, vector, match), id_, "left").select(clip, "person", id_, "score", "n", key, "similarity")
