"""Whitening against exact fractions on small tables, and its integers against plain ones."""

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def entry(c):
    return min(max(math.floor(Fraction(c) * 256), -(2**63)), 2**63 - 1)


def vectors(seed=1, n=200, d=6):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d))
    rows = [(i, (rng.standard_normal(d) @ mix * (3 if i % 5 else 0.2) + np.arange(d)).astype(np.float32).tolist(), i % 3) for i in range(n)]
    rows += [(n + i, rows[0][1], 9) for i in range(60)] + [(None, rows[1][1], None), (3, rows[2][1], 3)]
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * (d - 2), 1), (902, [float("nan")] * d, 1), (903, [float("inf")] + [0.0] * (d - 1), 1), (904, [-0.0] * d, 1)]
    return rows


def brute(rows, k=4):
    """Per row id and component: n, deviation, whitened, explained, by exact sums and one decomposition."""
    good = [(i, [entry(c) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    cov = [[Fraction(sum((x[a] * n - s[a]) * (x[b] * n - s[b]) for x in fit), n**3) for b in range(d)] for a in range(d)]
    e, q = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    trace = float(sum(cov[j][j] for j in range(d)))
    out = []
    for i, x in good:
        u = [x[j] * n - s[j] for j in range(d)]
        w = (np.array([float(Fraction(v, n)) for v in u]) @ q) / np.sqrt(e)
        out += [(i, c + 1, n, sum(v * v for v in u), w[c], e[c] / trace) for c in range(min(k, d))]
    return out


def test_against_fractions(spark):
    rows = vectors()
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4), "vec_id", "embedding")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got, want = got.collect(), brute(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[3], r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in (1, 2, 3, 4):
        a, b = (np.array([r[4] for r in x if r[1] == c]) for x in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        [share] = {r[5] for r in got if r[1] == c}
        assert share == pytest.approx(next(r[5] for r in want if r[1] == c), rel=1e-9)
    assert len({r[6] for r in got}) == 1 and 0 <= got[0][6] < 1e-9


def test_entries_far_from_zero_are_exact(spark):
    """A covariance that is lost in double precision without a shift, and entries at the ends of the longs."""
    rng = random.Random(2)
    rows = [(i, [2.0**40 + rng.randint(-3, 3) / 256, -(2.0**41) + rng.randint(-9, 9) / 256, float(rng.randint(0, 2))]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = whitening.whiten(df, "vec_id", "embedding").collect(), brute(rows)
    assert len({tuple(v) for _, v in rows}) < 300 and got[0].n == len({tuple(v) for _, v in rows})
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got) == sorted(r[:4] for r in want)
    assert {(r.component, round(r.explained, 9)) for r in got} == {(r[1], round(r[5], 9)) for r in want} and got[0].identity_error < 1e-9
    ends = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e18, 2.0]), (4, [5.0, 2.5])], "vec_id long, embedding array<double>")
    out = whitening.whiten(ends, "vec_id", "embedding", 1).collect()
    assert [(r.n, r.deviation) for r in out] == [(4, None)] * 4 and out[0].identity_error < 1e-9


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4).flatmap(lambda d: st.lists(st.lists(st.one_of(st.integers(-300, 300), st.integers(-(2**63), 2**63 - 1)), min_size=d, max_size=d), min_size=1, max_size=12)))
def test_scatter_is_exact(rows):
    """Sums and products of any longs, against Python's integers, and the covariance whatever the shift."""
    x, d, n = np.array(rows, np.int64), len(rows[0]), len(rows)
    assert (whitening.unpacked(whitening.packed(x), d) == x).all()
    assert len(set(whitening.packed(x))) == len(set(map(tuple, rows)))
    found = set()
    for shift in (rows[0], [0] * d, rows[-1]):
        own = whitening.scatter(x[: n // 2], shift) + whitening.scatter(x[n // 2 :], shift)
        less = [[v - c for v, c in zip(r, shift, strict=True)] for r in rows]
        assert own.n == n and own.sums.tolist() == [sum(r[a] for r in less) for a in range(d)]
        assert own.products.tolist() == [[sum(r[a] * r[b] for r in less) for b in range(d)] for a in range(d)]
        found.add(str((own.products * n - np.outer(own.sums, own.sums)).tolist()))
    assert len(found) == 1


def test_more_rows_than_a_product_takes():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**30), 2**30, (whitening.ROWS * 2 + 17, 3))
    own = whitening.scatter(x, [7, -7, 2**29])
    less = x.astype(object) - np.array([7, -7, 2**29], object)
    assert (own.sums == less.sum(0)).all() and (own.products == less.T.dot(less)).all()


def test_integers_of_entries():
    c = [0.0, -0.0, 0.001, -0.001, 1.5, 1e300, -1e300, 2.0**55, -(2.0**55), 2.0**54]
    assert whitening.to_integers(np.array([c])).tolist() == [[entry(v) for v in c]]
    [(at, m)] = list(whitening.whole_vectors(pa.array([[1.0, None], None, [1.0, 2.0], [float("nan"), 1.0]], pa.list_(pa.float32()))))
    assert at.tolist() == [2] and m.tolist() == [[1.0, 2.0]]


def test_odd(spark):
    """No rows, one vector, equal vectors, fewer dimensions than components, several lengths, clashing names."""
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty, "vec_id", "embedding").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1)], SCHEMA), "vec_id", "embedding").count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 1) for i in range(5)], SCHEMA).withColumnRenamed("label", "whitened")
    out = whitening.whiten(same, "vec_id", "embedding").collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out] == [(1, 0, None, 0.0, None)] * 15
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(9)] + [(100 + i, [float(i % 4)]) for i in range(9)] + [(200, [])]
    out = whitening.whiten(spark.createDataFrame(rows, "component long, v array<double>").withColumnRenamed("component", "k"), "k", "v").collect()
    assert {(r.n, r.component) for r in out if r.k < 100} == {(9, 1), (9, 2)} and {(r.n, r.component) for r in out if r.k >= 100} == {(4, 1)}
    assert len(out) == 27 and all(r.identity_error < 1e-9 for r in out)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.5]) for i in range(6)], "vec_id long, embedding array<double>")
    out = whitening.whiten(line, "vec_id", "embedding").collect()
    assert [r.whitened is None for r in sorted(out, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 6
    assert {r.explained for r in out if r.component > 1} == {0.0} and all(abs(r.explained - 1) < 1e-12 for r in out if r.component == 1)
