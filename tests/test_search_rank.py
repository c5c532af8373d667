"""Cover density against covers found by trying all stretches."""

import random
import re

from tessera.operators import search
from tessera.plans import library


def brute_density(places, ways):
    """A cover is a stretch that holds a way and of which no shorter part does; of equal ends the shortest."""
    good = [(a, b) for a in range(len(places)) for b in range(a, len(places)) if any(w <= {p[1] for p in places[a : b + 1]} for w in ways)]
    least = [(a, b) for a, b in good if not any((c, d) != (a, b) and a <= c and d <= b for c, d in good)]
    total = 0.0
    for a, b in least:
        inner = places[b][0] - places[a][0] - (b - a)
        total += (b - a + 1) / sum(1 / p[2] for p in places[a : b + 1]) / (1 + inner)
    return total


def test_density():
    rng = random.Random(3)
    for _ in range(500):
        at = sorted(rng.sample(range(60), rng.randint(0, 14)))
        places = [(i, rng.choice("abcd"), rng.choice([1.0, 0.4, 0.2, 0.1])) for i in at]
        ways = rng.choice([[frozenset("ab")], [frozenset("abc")], [frozenset("a")], [frozenset("ab"), frozenset("cd")]])
        assert abs(search.density(places, ways) - brute_density(places, ways)) < 1e-12


def test_documents_are_ranked_by_density(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.rank for r in library.fts_cover_density(spark, sf).collect()}
    ways = [frozenset(("the", "with")), frozenset(("und", "von"))]
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        fields = [(r.source, 1.0), (r.text, 0.2), (r.lang, 0.1)]
        every = [(w, k) for x, k in fields for w in re.findall(r"[^\W_]+", (x or "").lower())]
        places = [(i, w, k) for i, (w, k) in enumerate(every) if w in ("the", "with", "und", "von")]
        if any(w <= {p[1] for p in places} for w in ways):
            want[r.doc_id] = round(search.density(places, ways), 6)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[i] - want[i]) < 2e-6 for i in want)
