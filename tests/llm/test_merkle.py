"""The manifest against trees built by plain loops."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, corpus, odd

from tessera.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fan):
    """The root, and of each leaf the list of (place, siblings)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for k, i in enumerate(at):
            run = runs[i // fan]
            paths[k].append((i % fan, run[: i % fan] + run[i % fan + 1 :]))
        at, level = [i // fan for i in at], [sha("".join(r)) for r in runs]
    return level[0], paths


def fold(own, path):
    for place, siblings in path:
        own = sha("".join([*siblings[:place], own, *siblings[place:]]))
    return own


def brute(rows, fan=16):
    """rows: (doc_id, text, lang, source, n_chars)."""
    row = lambda r, text: leaf([r[0], r[3], r[2], r[4], text])
    by = {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, row(r, r[1]))):
        by.setdefault(r[3], []).append(r)
    own = [(rs, *tree([row(r, r[1]) for r in rs], fan)) for rs in by.values()]
    if not own:
        return []
    root, over = tree([top for _, top, _ in own], fan)
    out = []
    for (rs, top, paths), above in zip(own, over, strict=True):
        for r, path in zip(rs, paths, strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            path = path + above
            found = fold(row(r, text), path)
            out.append((r[0], row(r, r[1]), top, root, sha("".join(s for _, own in path for s in own)), found, found == root))
    return sorted(out, key=str)


def rows_(n=60):
    rng = random.Random(4)
    rows = [(i, t, g, s, c) for i, t, g, s, c in corpus(5, n)]
    rows += [(10_000 + i, f"Hot Row {i}" if i % 7 else None, "en", "hot", i) for i in range(600)]
    rows += [(20_000 + i, f"Alone {i}", None, f"s{i}", None) for i in range(40)] + [(30_000 + i, f"Run {i}", "de", "seventeen", 1) for i in range(17)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_against_plain_loops(spark, fan):
    rows = rows_()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = merkle.manifest(df, now={"text": merkle.tampered()}, fan=fan, paths=True)
    got = out.collect()
    want = brute(rows, fan)
    assert sorted((tuple(r)[:7] for r in got), key=str) == want
    assert {r[6] for r in want} == {True, False} and len({r[2] for r in want}) > 40
    for r in got:
        assert merkle.root_of(r.leaf, r.proof) == r.root
        assert r.verified or merkle.root_of(r.leaf, r.proof) != r.folded_root


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 256, 257])
def test_sizes(spark, n):
    """Lone leaves, full runs, runs of one, one group, none."""
    rows = [(i * 7 - 5, f"Text {i}", "en", "a", i) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(df, now={"text": merkle.tampered()})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    if n == 1:
        r = got.first()
        assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")


def test_a_change_is_found_where_it_is(spark):
    """Any field of any row: that row fails, the others stay; and a proof doesn't fit another leaf."""
    rows = rows_(20)[:200]
    df = spark.createDataFrame(rows, SCHEMA)
    victim = rows[17][0]
    hit = F.col("doc_id") == victim
    for name, value in (("lang", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1), ("text", F.concat("text", F.lit(" "))), ("source", F.lit("elsewhere"))):
        df2 = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.coalesce("n_chars", F.lit(0))).withColumn("lang", F.coalesce("lang", F.lit("x")))
        out = merkle.manifest(df2, now={name: F.when(hit, value).otherwise(F.col(name))}).collect()
        assert {r.doc_id for r in out if not r.verified} == {victim}
    assert all(r.verified and r.folded_root == r.root for r in merkle.manifest(df).collect())
    proved = merkle.manifest(df, paths=True).collect()
    assert sum(merkle.root_of(a.leaf, b.proof) == a.root for a in proved[:15] for b in proved[:15]) == 15


def test_the_same_however_dealt(spark):
    rows = rows_(30)
    first = None
    for parts in (1, 6):
        got = sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()), key=str)
        first = first or got
        assert got == first


def test_odd(spark):
    """Null ids, repeated rows, null and empty fields told apart, clashing names, very long texts."""
    df = odd(spark).withColumns({"leaf": F.lit("x"), "_tree": F.lit(1), "source": F.lit(None).cast("string")})
    got = merkle.manifest(df, fields=["doc_id", "text"], now={"text": merkle.tampered()}).collect()
    assert len(got) == 6 and len({r.root for r in got}) == 1 and [r.doc_id for r in got].count(5) == 3
    rows = [(1, "Same", "en", "a", 1)] * 40 + [(None, None, None, None, None)] * 3 + [(None, "", "", "", 0)] * 3 + [(7, "Ab" * 1_000_000, "en", "a", 2_000_000)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), now={"text": merkle.tampered()}).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r.leaf for r in got} >= {leaf([None] * 5), leaf([None, "", "", 0, ""])}
