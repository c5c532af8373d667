"""Near-duplicates by circulant MinHash.

One permutation scatters a document's shingles over a fixed universe; a second, shifted circularly by 1, 2, ...,
gives all signature coordinates. Bands of the signature make candidate pairs, which are confirmed by the exact
Jaccard similarity of the full shingle sets.

Documents with equal shingle sets are one vertex. In each bucket the members are first compared with one of them,
the one whose buckets are the fullest, so a large group of copies of one text costs a pair for each copy. Where a
bucket then still holds members of different components, all pairs across components follow whose signatures
leave a chance of a link.

Buckets with many members of different components would make pairs by the square of their size. Documents that
meet in such buckets form families; parts of a family are compared exactly as matrices of shingles, two parts in
a task, and a task emits no more links than join its components. A large family is dealt anew before that, by
shingles that are rare in it: of a set of n shingles, ordered from the rarest, one of the first
n - ceil(n * threshold) + 1 is among those of any set that similar. Texts that have a template in common, and each its
own rest, have no rare shingle in common and meet nowhere; only where many members of different components share
even a rare one are they compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK, chunks, joined, lowered, mix64, quoted, range_hash, settled, stage, texts_of, word_hashes
from tessera.llm.graph import components, small

UNIVERSE = 1 << 20
BANDS, ROWS = 26, 5
COORDINATES = BANDS * ROWS
#: Members of an open bucket of which pairs are made; those of larger ones form families.
CROWD = 64
#: Members of a family that a task compares with as many others.
PART = 500
#: Members of a family that is compared as a whole, each set being sent to FAMILY / PART tasks; larger ones are dealt by rare shingles.
FAMILY = 8 * PART
#: Shingles that are columns of one matrix.
COLUMNS = 8192
#: Documents whose keys and numbers a task writes.
NUMBERS = 20_000
#: Documents without an id get one above all others, made from the text.
NAMELESS = 1 << 62


class Circulant:
    """The two permutations of the universe."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(UNIVERSE).astype(np.int64)
        ring = rng.permutation(UNIVERSE).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.append(ring, ring[: COORDINATES - 1]), COORDINATES)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Coordinate k is the least value that the ring, shifted by k, has at a scattered shingle."""
        at = self.scatter[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        least = self.windows[at[:1024]].min(0)
        for i in range(1024, len(at), 1024):
            np.minimum(least, self.windows[at[i : i + 1024]].min(0), out=least)
        return least


_made: dict[int, Circulant] = {}


def shingle_sets(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; a shorter text has one of all its words."""
    out: list[np.ndarray] = []
    for i, j in chunks(texts):
        buf, offsets = joined(texts[i:j])
        starts, _, hashes = word_hashes(lowered(buf))
        edges = np.searchsorted(starts, offsets)
        lo, hi = edges[:-1], edges[1:]
        full = np.arange(max(0, len(hashes) - size + 1))
        grams = range_hash(hashes, full, full + size) if len(full) else np.zeros(0, np.uint64)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                out.append(range_hash(hashes, np.array([a]), np.array([b])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sets(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if seed not in _made:
            _made[seed] = Circulant(seed)
        for batch in batches:
            texts = texts_of(batch, "_text")
            for i, j in chunks(texts, 4 * CHUNK):
                n, d1, d2, bands, sigs = [], [], [], [], []
                for s in shingle_sets(texts[i:j], size):
                    n.append(len(s))
                    d1.append(int(mix64(s).sum(dtype=np.uint64)))
                    d2.append(int(mix64(s ^ np.uint64(0x5DEECE66D2B79F89)).sum(dtype=np.uint64)))
                    if not len(s):
                        bands.append(b"")
                        sigs.append(b"")
                        continue
                    sig = _made[seed].signature(s)
                    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
                    key = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
                    bands.append(key.tobytes())
                    sigs.append(sig.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(d1, np.uint64).view(np.int64)),
                        pa.array(np.array(d2, np.uint64).view(np.int64)),
                        pa.array(bands, pa.binary()),
                        pa.array(sigs, pa.binary()),
                    ],
                    ["_id", "_n", "_d1", "_d2", "_bands", "_sig"],
                )

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands = batch.column(1).to_pylist()
        keys = np.frombuffer(b"".join(bands), np.int64)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], ["v", "key"])


def _shingles(text: bytes | None, size: int) -> set[bytes]:
    words = (text or b"").lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes | None, set[bytes]] = (None, set())
        for batch in batches:
            ok = []
            for ta, tb in zip(texts_of(batch, "ta"), texts_of(batch, "tb"), strict=True):
                if ta != held[0]:
                    held = (ta, _shingles(ta, size))
                a, b = held[1], _shingles(tb, size)
                both = len(a & b)
                ok.append(bool(a) and bool(b) and 100 * both >= percent * (len(a) + len(b) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            yield kept

    return run


def _across(percent: int):
    """Pairs across components within a bucket whose signatures leave a chance; pairs of one family are left to it."""
    p = percent / 100
    least = int(COORDINATES * p - 6 * (COORDINATES * p * (1 - p)) ** 0.5)

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sig = np.frombuffer(b"".join(x[3] for x in rows), np.uint8).reshape(-1, COORDINATES)
        label, family = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
        for i in range(len(rows) - 1):
            ok = (label[i + 1 :] != label[i]) & ((family[i + 1 :] != family[i]) | (family[i] < 0))
            for j in np.flatnonzero(ok & ((sig[i] == sig[i + 1 :]).sum(1) >= least)).tolist():
                yield rows[i][0], rows[i + 1 + j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for k, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    out.extend(pairs(rows))
                    key, rows = k, []
                rows.append(row)
            if len(out) > 20_000:
                yield _pair_batch(out)
                out = []
        out.extend(pairs(rows))
        yield _pair_batch(out)

    return run


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products of 0-1 matrices over blocks of columns."""
    out = np.zeros((len(a), len(b)), np.float32)
    every, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    both = np.zeros(len(every), bool)
    in_a = np.zeros(len(every), bool)
    in_a[at[rows < len(a)]] = True
    both[at[rows >= len(a)]] = True
    both &= in_a
    column = np.cumsum(both) - 1
    use = both[at]
    rows, cols = rows[use], column[at[use]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for lo in range(0, int(both.sum()), COLUMNS):
        i, j = np.searchsorted(cols, [lo, lo + COLUMNS])
        m = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        m[rows[i:j], cols[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _families(percent: int):
    """Links across components between two parts of a family, as many as join them."""

    def links(a: list[tuple], b: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [[np.frombuffer(x[2], np.uint64) for x in side] for side in (a, b)]
        sizes = [np.array([len(x) for x in side]) for side in sets]
        shared = shared_counts(*sets).astype(np.int64)
        label = [np.array([x[1] for x in side]) for side in (a, b)]
        hit = (100 * shared >= percent * (sizes[0][:, None] + sizes[1][None] - shared)) & (label[0][:, None] != label[1][None])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
            x, y = find(int(label[0][i])), find(int(label[1][j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                yield a[i][0], b[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, ([], []), []

        def finish() -> None:
            if key is not None and sides[0]:
                out.extend(links(sides[0], sides[0] if key[1] == key[2] else sides[1]) if key[1] == key[2] or sides[1] else ())

        for batch in batches:
            for f, p1, p2, own, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (f, p1, p2) != key:
                    finish()
                    key, sides = (f, p1, p2), ([], [])
                sides[0 if own == p1 else 1].append(row)
        finish()
        yield _pair_batch(out)

    return run


def _set_bytes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "_text")
            for i, j in chunks(texts, 4 * CHUNK):
                sets = [x.tobytes() for x in shingle_sets(texts[i:j], size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], ["v", "_set"])

    return run


def _set_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a set, with the set's size."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        n = [len(x) for x in sets]
        rows = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.repeat(n, n).astype(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["family", "v", "n", "key"])


def _pair_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that are links."""
    one = pairs.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("tb")).hint("merge"), "b")
    two = one.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")
    return stage(two.mapInArrow(_confirm(size, percent), "a long, b long"), "links")


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """Of family, v, _set: key, v for the shingles of the set that a similar set of its family must share one of."""
    tokens = stage(sets.select("family", "v", "_set").mapInArrow(_set_tokens, "family long, v long, n long, key long"), "family_tokens")
    often = stage(tokens.groupBy("family", "key").agg(F.count("*").alias("df")).where("df > 1"), "family_counts")
    # Shingles of one set only come first in the order and meet nothing.
    own = tokens.join(often, ["family", "key"]).groupBy("family", "v", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("_own"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1 - (F.col("n") - F.size("_own"))
    kept = own.select("v", "family", F.explode(F.slice("_own", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("_t"))
    return kept.select(F.xxhash64("family", "_t.key").alias("key"), "v")


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    return members.join(small(label), "v", "left").withColumn("label", F.coalesce("label", "v"))


def _open(members: DataFrame) -> DataFrame:
    """Of key, v, label: the buckets with members of different components, their size and a member."""
    spread = members.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("m"), F.min("v").alias("hub"))
    return spread.where("l1 < l2").select("key", "m", "hub")


def _families_of(members: DataFrame, spread: DataFrame) -> DataFrame:
    """v, family of the members of crowded open buckets."""
    crowds = members.join(spread.where(F.col("m") > CROWD), "key")
    return stage(components(crowds.select(F.col("v").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "family"), "families")


def _as_matrices(family: DataFrame, label: DataFrame, own_sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of families in different components, each part of a family compared with each."""
    sizes = stage(family.groupBy("family").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "sizes")
    dealt = _labelled(family.join(sizes, "family"), label)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("p1"), F.greatest("own", "other").alias("p2"), "own", "v", "label")
    rows = stage(dealt, "dealt").join(own_sets, "v").select("family", "p1", "p2", "own", "v", "label", "_set")
    whole = rows.repartition("family", "p1", "p2").sortWithinPartitions("family", "p1", "p2").mapInArrow(_families(percent), "a long, b long")
    return stage(whole, "links")


def _by_rare_shingles(family: DataFrame, label: DataFrame, own_sets: DataFrame, links: DataFrame, vertices: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The same for large families, of members that share a shingle that is rare in them."""
    members = stage(rare_shingles(own_sets.join(family, "v"), percent), "rare")
    named = stage(_labelled(members, label), "named")
    spread = stage(_open(named), "open")
    few = named.join(spread.where(F.col("m") <= CROWD).select("key"), "key").join(vertices.select("v", "_sig"), "v")
    few = few.select("key", "v", "label", F.lit(-1).cast("long").alias("family"), "_sig")
    across = few.repartition("key").sortWithinPartitions("key").mapInArrow(_across(percent), "a long, b long").distinct()
    more = _links(stage(across, "pairs"), texts, size, percent)
    if spread.where(F.col("m") > CROWD).isEmpty():
        return more
    if not more.isEmpty():
        label = stage(components(links.unionByName(more)).withColumnRenamed("component", "label"), "labels")
        named = stage(_labelled(members, label), "named")
        spread = stage(_open(named), "open")
    dense = _families_of(named, spread)
    return more if dense.isEmpty() else more.unionByName(_as_matrices(dense, label, own_sets, percent))


def _within_families(family: DataFrame, label: DataFrame, links: DataFrame, vertices: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members of families that are in different components."""
    own_sets = texts.join(family.select(F.col("v").alias("_id")), "_id", "left_semi").select("_id", "_text").mapInArrow(_set_bytes(size), "v long, _set binary")
    own_sets = stage(own_sets, "family_sets")
    large = stage(family.groupBy("family").agg(F.count("*").alias("m")).where(F.col("m") > FAMILY).select("family"), "large_families")
    if large.isEmpty():
        return _as_matrices(family, label, own_sets, percent)
    few = _as_matrices(family.join(large, "family", "left_anti"), label, own_sets, percent)
    many = stage(family.join(large, "family", "left_semi"), "families")
    return few.unionByName(_by_rare_shingles(many, label, own_sets, links, vertices, texts, size, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, seed: int = 1) -> DataFrame:
    """The near-duplicate group of every row: _id, _n (set size) and _component, and kept.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of size words
    (fewer words: all as one; none: an empty set, linked with nothing). Documents with 100 * intersection >=
    percent * union are linked; a component is named by its smallest id. Pairs of that similarity share a band
    with a probability of over 1 - 1e-6 at 85 percent and 1 - 3e-5 at 80.

    Rows of one id are one document, linked if any of its texts is. A row without id gets one of its text above
    2**62, so equal texts without id are one. An empty table gives an empty result.
    """
    text = F.col(quoted(text_col)).cast("string")
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(text), 3)
    base = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), nameless).alias("_id"), text.alias("_text"))
    return settled(docs.sparkSession, lambda: _groups(base, size, percent, seed), "groups")


def _groups(base: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    sets = stage(base.mapInArrow(_sets(size, seed), "_id long, _n long, _d1 long, _d2 long, _bands binary, _sig binary"), "sets")
    # Tables of a few numbers for each document are written by as many tasks as they have rows for.
    files = 1 + sets.count() // NUMBERS
    tops = stage(sets.where("_n > 0").groupBy("_d1", "_d2").agg(F.min("_id").alias("v")).coalesce(files), "tops")
    tops = small(tops)
    of = stage(sets.where("_n > 0").select("_id", "_d1", "_d2").join(tops, ["_d1", "_d2"]).select("_id", "v").distinct().coalesce(files), "vertices")
    vertices = sets.join(tops, (F.col("_id") == F.col("v")) & (sets["_d1"] == tops["_d1"]) & (sets["_d2"] == tops["_d2"])).select("v", "_bands", "_sig")
    vertices = stage(vertices, "signatures")
    banded = vertices.select("v", "_bands").mapInArrow(_explode, "v long, key long")
    full = stage(banded.groupBy("key").agg(F.count("*").alias("c"), F.min("v").alias("v1"), F.max("v").alias("v2")).where("v1 < v2").select("key", "c").coalesce(2 * files), "buckets")
    members = stage(banded.join(full, "key"), "members")
    score = members.groupBy("v").agg(F.sum("c").alias("score"))
    scored = members.join(stage(score.coalesce(files), "scores"), "v")
    hubs = stage(scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("v")).alias("v"))).alias("h")).select("key", (-F.col("h.v")).alias("hub")).coalesce(2 * files), "hubs")
    star = members.join(hubs, "key").where("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct()
    # The texts that can be asked for are fetched once; they are joined by sorting at any size, as they are what is large.
    texts = stage(base.join(members.select(F.col("v").alias("_id")).distinct().hint("merge"), "_id", "left_semi"), "texts")
    links = _links(stage(star.coalesce(2 * files), "pairs"), texts, size, percent)
    # Texts of one id are one document.
    first = of.groupBy("_id").agg(F.min("v").alias("a"))
    links = links.unionByName(of.join(first, "_id").where("v <> a").select("a", F.col("v").alias("b")))
    label = stage(components(links).withColumnRenamed("component", "label"), "labels")
    named = stage(_labelled(members.drop("c"), label), "named")
    spread = stage(_open(named), "open")
    family = _families_of(named, spread)
    few = named.join(spread.where(F.col("m") <= CROWD).select("key"), "key").join(small(family), "v", "left").join(vertices.select("v", "_sig"), "v")
    few = few.select("key", "v", "label", F.coalesce("family", F.lit(-1)).alias("family"), "_sig")
    across = few.repartition("key").sortWithinPartitions("key").mapInArrow(_across(percent), "a long, b long").distinct()
    more = _links(stage(across.coalesce(2 * files), "pairs"), texts, size, percent)
    if not family.isEmpty():
        more = more.unionByName(_within_families(family, label, links, vertices, texts, size, percent))
    if not more.isEmpty():
        label = stage(components(links.unionByName(more)).withColumnRenamed("component", "label"), "labels")
    group = of.join(small(label), "v", "left").groupBy("_id").agg(F.min(F.coalesce("label", "v")).alias("_component"))
    out = sets.select("_id", "_n").join(group, "_id", "left").withColumn("_component", F.coalesce("_component", "_id"))
    return out.withColumn("kept", F.col("_id") == F.col("_component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the document with the smallest id, one row for it: of rows with that id the one whose text has the least hash, so reruns agree."""
    text = F.col(quoted(text_col)).cast("string")
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(text), 3)
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select("_id").distinct()
    whole = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(whole.alias("_row"), F.coalesce(F.col(quoted(id_col)).cast("long"), nameless).alias("_id"), F.xxhash64(text).alias("_h"))
    one = rows.join(kept, "_id", "left_semi").groupBy("_id").agg(F.min_by("_row", "_h").alias("_row"))
    return one.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
