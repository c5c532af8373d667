"""Whitening of embeddings by an exact integer scatter matrix.

Entries become integers x. Over the distinct vectors the sums s and products R of x less a shift are added up as
integers of any size, so n R - s s^T is n^2 times the covariance without any rounding, whatever the shift and however
the rows are dealt. Only that is turned into floating point and decomposed.

Matrix products of integers are made by BLAS on pieces of LIMB bits and few enough rows that no sum is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import quoted, stage

#: 2 * LIMB + log2(ROWS) is at most 53: a product of pieces of so many rows is exact in double precision.
LIMB, ROWS = 20, 1 << 13
LOW, HIGH = -(2**63), 2**63 - 1
WIDTHS = (1, 2, 4, 8)
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column that are vectors of finite entries: their positions and entries as doubles, for each length."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False))
    for size in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == size)
        flat = pc.fill_null(column.take(pa.array(at)).flatten().cast(pa.float64()), float("nan"))
        m = flat.to_numpy(zero_copy_only=False).reshape(len(at), size)
        fine = np.isfinite(m).all(1)
        yield at[fine], m[fine]


def to_integers(m: np.ndarray) -> np.ndarray:
    """floor(256 c) of each entry as a long; what is beyond the longs becomes the nearest of them."""
    with np.errstate(over="ignore"):
        f = np.floor(m * 256.0)
    inside = (f > LOW) & (f < 2.0**63)
    return np.where(inside, np.where(inside, f, 0).astype(np.int64), np.where(f > 0, HIGH, LOW))


def packed(x: np.ndarray) -> list[bytes]:
    """Each row of longs as bytes: the least width that holds them all, then the entries; equal rows, equal bytes."""
    low, high = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x)), np.zeros(len(x)))
    out: list[bytes] = [b""] * len(x)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << (8 * w - 1))) & (high < 1 << (8 * w - 1))] = w
    for w in WIDTHS:
        at = np.flatnonzero(width == w)
        raw = np.ascontiguousarray(x[at].astype(f"<i{w}"))
        for i, row in zip(at.tolist(), raw, strict=True):
            out[i] = bytes((w,)) + row.tobytes()
    return out


def unpacked(rows: list[bytes], size: int) -> np.ndarray:
    """The inverse of packed() for vectors of one length."""
    out = np.empty((len(rows), size), np.int64)
    widths = np.array([r[0] for r in rows], int)
    for w in WIDTHS:
        at = np.flatnonzero(widths == w)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at.tolist()), f"<i{w}").reshape(len(at), size)
    return out


def pieces(x: np.ndarray, shift: list[int]) -> list[np.ndarray]:
    """x - shift as a sum of matrices of integers below 2**LIMB in size, as doubles, times 1, 2**LIMB, 2**(2 LIMB) and so on."""
    step, s = 1 << LIMB, np.array(shift, np.int64)
    if np.abs(x.astype(float) - s.astype(float)).max(initial=0) < 2.0**62:
        left = x - s
    else:
        left = x.astype(object) - np.array(shift, object)
    out = []
    while True:
        # Towards zero, so that what is left gets smaller in size until there is nothing.
        part = left % step
        part = part - step * ((left < 0) & (part > 0))
        out.append(part.astype(float))
        left = (left - part) // step
        if not left.any():
            return out


@dataclass
class Scatter:
    """n vectors, the sums of their entries less the shift, and of the products of these: Python integers."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Scatter) -> Scatter:
        return Scatter(self.n + other.n, self.sums + other.sums, self.products + other.products)


def whole(m: np.ndarray) -> np.ndarray:
    """Doubles that are integers, as Python integers."""
    return m.astype(np.int64).astype(object)


def scatter(x: np.ndarray, shift: list[int]) -> Scatter:
    d = x.shape[1]
    sums, products = np.array([0] * d, object), np.array([[0] * d] * d, object).reshape(d, d)
    for lo in range(0, len(x), ROWS):
        parts = pieces(x[lo : lo + ROWS], shift)
        for i, a in enumerate(parts):
            sums = sums + whole(a.sum(0)) * (1 << (LIMB * i))
            for j, b in enumerate(parts):
                products = products + whole(a.T @ b) * (1 << (LIMB * (i + j)))
    return Scatter(len(x), sums, products)


@dataclass
class Whitener:
    """Of vectors of one length: how many are fitted, their sums, and the components with their eigenvalues and shares, largest first."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    error: float | None = None

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n x - S as doubles rounded once, and the sum of its squares: exact, or None where it is above the longs."""
        top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        u = x * self.n - np.array(self.sums, np.int64) if top <= HIGH else x.astype(object) * self.n - np.array(self.sums, object)
        f = u.astype(float)
        about = (f * f).sum(1)
        out: list[int | None] = [None] * len(x)
        for i in np.flatnonzero((about >= 2.0**62) & (about < 2.0**64)).tolist():
            exact = sum(v * v for v in u[i].tolist())
            out[i] = exact if exact <= HIGH else None
        at = np.flatnonzero(about < 2.0**62)
        own = u[at].astype(np.int64)
        for i, v in zip(at.tolist(), (own * own).sum(1).tolist(), strict=True):
            out[i] = v
        return f, out

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """centred: n x - S. A component without variance has no whitened values: NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred / self.n) @ self.vectors / np.sqrt(self.values)
        out[:, self.values <= 0] = np.nan
        return out


def decomposed(own: Scatter, shift: list[int], components: int) -> Whitener:
    """The exact n R - s s^T over n squared, each entry rounded once, and its leading eigenvectors."""
    n, d = own.n, len(shift)
    exact = own.products * n - np.outer(own.sums, own.sums)
    v = np.array([[e / (n * n) for e in row] for row in exact.tolist()], float).reshape(d, d)
    sums = [int(s) + n * c for s, c in zip(own.sums.tolist(), shift, strict=True)]
    k = min(components, d)
    # The decomposition of a matrix of size about 1: squares of its entries stay within range.
    trace = sum(exact[i, i] for i in range(d)) / (n * n)
    scale = trace or 1.0
    e, q = np.linalg.eigh(v / scale)
    e, q = e[::-1][:k].copy(), q[:, ::-1][:, :k].copy()
    e[e <= max(d, 1) * np.finfo(float).eps * max(e.max(initial=0), 0)] = 0.0
    for j in range(k):
        q[:, j] *= 1.0 if q[np.abs(q[:, j]).argmax(), j] > 0 else -1.0
    return Whitener(n, sums, q, e * scale, e * scale / trace if trace else np.zeros(k))


def _tree(parts, zero, add):
    """The sum over the tasks' rows, in a tree."""
    return parts.treeAggregate(zero, add, add, depth=3) if parts.getNumPartitions() else zero


def _both(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}


def distinct_integers(df: DataFrame, vector: str) -> DataFrame:
    """The distinct integer vectors of df, packed: _d (length), _x; combined in the tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in whole_vectors(batch.column(0)):
                rows = list(dict.fromkeys(packed(to_integers(m))))
                yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["_d", "_x"])

    return df.select(F.col(quoted(vector)).alias("_v")).mapInArrow(run, "_d int, _x binary").distinct()


def _blocks(rows) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of (d, x) as matrices of some thousand vectors of one length."""
    held: dict[int, list[bytes]] = {}
    for d, x in rows:
        own = held.setdefault(d, [])
        own.append(bytes(x))
        if len(own) == ROWS:
            yield d, unpacked(held.pop(d), d)
    for d, own in held.items():
        yield d, unpacked(own, d)


def fitted(df: DataFrame, vector: str, components: int = 4) -> dict[int, Whitener]:
    """The whitener of the distinct integer vectors of df, for each length that there is.

    What a task adds up, what is merged in a tree and what the driver decomposes is a matrix of the vectors' length
    squared, whatever the number of rows.
    """
    rows = stage(distinct_integers(df, vector), "vectors")
    shifts = {r._d: unpacked([bytes(r.x)], r._d)[0].tolist() for r in rows.groupBy("_d").agg(F.min("_x").alias("x")).collect()}
    pairs = rows.select("_d", "_x").rdd.map(tuple)

    def added(own) -> Iterator[dict]:
        total: dict[int, Scatter] = {}
        for d, x in _blocks(own):
            total = _both(total, {d: scatter(x, shifts[d])})
        yield total

    models = {d: decomposed(own, shifts[d], components) for d, own in _tree(pairs.mapPartitions(added), {}, _both).items()}

    def measured(own) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for d, x in _blocks(own):
            w = np.nan_to_num(models[d].whitened(models[d].deviations(x)[0]))
            w = np.hstack([np.ones((len(w), 1)), w])
            total = _both(total, {d: w.T @ w})
        yield total

    for d, m in _tree(pairs.mapPartitions(measured), {}, _both).items():
        own = models[d]
        mean, live = m[0, 1:] / own.n, np.flatnonzero(own.values > 0)
        cov = m[1:, 1:] / own.n - np.outer(mean, mean)
        own.error = float(np.abs((cov - np.eye(len(cov)))[np.ix_(live, live)]).max()) if len(live) else None
    return models


def whiten(df: DataFrame, id_: str, vector: str, components: int = 4) -> DataFrame:
    """Every vector of finite entries on the leading principal components of all distinct ones: id, component (from 1) and

    * n: distinct integer vectors; x = floor(256 entry) is the integer vector of a row, S their sums;
    * deviation: the sum over dimensions of (n x - S)^2, exact; null where it is above the longs;
    * whitened: x - S / n on the component, over the root of its eigenvalue; explained: the eigenvalue's share of the variance;
    * identity_error: the largest entry by which the covariance of what was whitened departs from the identity, as measured.

    Rows whose vector is null, or holds a null or an entry that isn't finite, have no result. Repeated vectors count once in
    the fit, and each row, repeated ids and null ids included, has its results. Vectors of another length are fitted and
    whitened apart; an empty one has no component. A component without variance (all vectors equal, or fewer than
    dimensions) has a null whitened and 0 as explained, and doesn't count in identity_error, which is null without any.
    Entries whose integer is beyond the longs take the nearest long. Of the columns only the two named are read.
    """
    models = fitted(df, vector, components)
    rows = df.select(F.col(quoted(id_)).alias("_i"), F.col(quoted(vector)).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in whole_vectors(batch.column(1)):
                if not len(at) or not m.shape[1]:
                    continue
                own = models[m.shape[1]]
                centred, deviation = own.deviations(to_integers(m))
                w = own.whitened(centred)
                k = w.shape[1]
                again = lambda values: pa.array([v for v in values for _ in range(k)])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(again(at.tolist())),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(k * len(at), own.n)),
                        pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                        pa.array(w.ravel(), from_pandas=True),
                        pa.array(np.tile(own.shares, len(at))),
                        pa.array([own.error] * (k * len(at)), pa.float64()),
                    ],
                    ["_i", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["_i"].dataType.simpleString()
    return rows.mapInArrow(run, f"_i {kind}, {SCHEMA}").withColumnRenamed("_i", id_)
