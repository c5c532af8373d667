"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Documents are read in windows as long as an item, in words. A window and an item of n shingles each that are
similar by t share 2 n t / (1 + t) of them at least; windows with fewer shingles of items of that length are passed
over. A document of m shingles, fewer than the item's, is one window as a whole, with a bound of (n + m) t / (1 + t).
Of the others a 64-bit SimHash is made from the window's shingles. An index over
eight blocks of the items' fingerprints finds every item within the radius: of blocks that differ in RADIUS bits
together, one differs in RADIUS // 8 at most. What it finds is verified by the exact weighted Jaccard similarity
of the shingles, the weight of a shingle being how often it occurs.

The benchmark is broadcast if it is small. The items of a larger one are joined to documents by the shingles that
are rare among items: of an item's n, ordered from the rarest, one of the first n - ceil(n * threshold) + 1 is in any
document that holds the item. Each document then meets these items only, in the same way.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, column, given, id_key, joined, mix64, quoted, range_hash, stage, texts_of, word_hashes

SHINGLE = 5
#: Hamming distance of 64-bit fingerprints: at a similarity of 0.8 it is 10 on average, with a deviation of 3.
RADIUS = 23
BLOCKS = 8
#: Bytes of benchmark text that are broadcast; the items of a larger one are joined to the documents that can hold them.
ITEM_BYTES = 8 << 20
#: A-Z to lower case, ASCII punctuation to spaces.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _PLAIN[_a:_b] = 32
_PLAIN[0:9] = _PLAIN[14:32] = 32
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingles(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and the hashes of all runs of SHINGLE words of a buffer."""
    starts, _, hashes = word_hashes(_PLAIN[buf])
    at = np.arange(max(0, len(hashes) - SHINGLE + 1))
    return starts, range_hash(hashes, at, at + SHINGLE) if len(at) else np.zeros(0, np.uint64)


def _bits(grams: np.ndarray) -> np.ndarray:
    """Rows of 64 signs, 1 or -1, of each shingle."""
    raw = np.unpackbits(mix64(grams).view(np.uint8).reshape(-1, 8), axis=1)
    return raw.astype(np.int32) * 2 - 1


def simhashes(grams: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints, as 8 bytes each, of the windows of n shingles that begin at first."""
    sums = np.zeros((len(grams) + 1, 64), np.int32)
    np.cumsum(_bits(grams), axis=0, out=sums[1:])
    return np.packbits(sums[first + n] > sums[first], axis=1)


class Items:
    """Benchmark items by length, with their fingerprints and the index over the blocks of these."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.by_length: dict[int, list[tuple[int, np.ndarray, Counter]]] = defaultdict(list)
        grams: list[np.ndarray] = []
        for item, text in rows:
            starts, own = shingles(joined([text])[0])
            if len(own):
                prints = simhashes(own, np.zeros(1, np.int64), len(own))[0]
                self.by_length[len(own)].append((item, prints, Counter(own.tolist())))
                grams.append(own)
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.of_length = {n: set().union(*(c for _, _, c in own)) for n, own in self.by_length.items()}
        near = [[v for v in range(256) if _ONES[v ^ w] <= RADIUS // BLOCKS] for w in range(256)]
        self.index: dict[int, list[dict[int, list[int]]]] = {}
        for n, items in self.by_length.items():
            tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
            for i, (_, prints, _) in enumerate(items):
                for table, byte in zip(tables, prints.tolist(), strict=True):
                    for v in near[byte]:
                        table[v].append(i)
            self.index[n] = tables

    def within(self, n: int, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of all fingerprints within RADIUS."""
        own = np.array([p for _, p, _ in self.by_length[n]])
        w, i = [], []
        for b, table in enumerate(self.index[n]):
            for value in np.unique(prints[:, b]).tolist():
                if hits := table.get(value):
                    rows = np.flatnonzero(prints[:, b] == value)
                    w.append(np.repeat(rows, len(hits)))
                    i.append(np.tile(hits, len(rows)))
        if not w:
            return
        pairs = np.unique(np.concatenate(w) * len(own) + np.concatenate(i))
        w, i = pairs // len(own), pairs % len(own)
        distance = _ONES[prints[w] ^ own[i]].sum(1)
        ok = distance <= RADIUS
        yield from zip(w[ok].tolist(), i[ok].tolist(), distance[ok].tolist(), strict=True)


def _similarity(a: Counter, b: Counter) -> float:
    both = sum(min(c, b[g]) for g, c in a.items() if g in b)
    return both / (a.total() + b.total() - both)


def matches(items: Items, text: bytes, grams: np.ndarray, hits: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
    """Of one document, its best window for each item it holds: item, first word, words, distance, similarity."""
    best: dict[int, tuple] = {}
    spots = list(zip(hits.tolist(), grams[hits].tolist(), strict=True))
    for n, own in items.by_length.items():
        held = [i for i, g in spots if g in items.of_length[n]]
        size = min(n, len(grams))
        need = (n + size) * least / (1 + least) - 1e-9
        if len(held) < need:
            continue
        flags = np.zeros(len(grams) + 1, np.int64)
        flags[np.array(held) + 1] = 1
        sums = np.cumsum(flags)
        first = np.flatnonzero(sums[size:] - sums[:-size] >= need)
        for part in np.split(first, np.flatnonzero(np.diff(first) > 1) + 1):
            for lo in range(0, len(part), 4096):
                at = part[lo : lo + 4096]
                region = grams[at[0] : at[-1] + size]
                prints = simhashes(region, at - at[0], size)
                for w, i, distance in items.within(n, prints):
                    start = int(at[w])
                    sim = _similarity(own[i][2], Counter(grams[start : start + size].tolist()))
                    if sim >= least:
                        row = (-sim, start, size + SHINGLE - 1, distance)
                        item = own[i][0]
                        if item not in best or row < best[item]:
                            best[item] = row
    return [(item, start, words, distance, -s) for item, (s, start, words, distance) in sorted(best.items())]


def _found(items: Items, texts: list[bytes | None], least: float) -> Iterator[tuple[int, tuple[int, int, int, int, float]]]:
    """The text's number and a match, for all of a batch."""
    for i, j in chunks(texts):
        buf, offsets = joined(texts[i:j])
        starts, grams = shingles(buf)
        edges = np.searchsorted(starts, offsets)
        at = np.minimum(np.searchsorted(items.grams, grams), max(0, len(items.grams) - 1))
        hit = np.flatnonzero(items.grams[at] == grams) if len(items.grams) else np.zeros(0, np.int64)
        doc = np.searchsorted(edges, hit, "right") - 1
        hit, doc = hit[hit + SHINGLE <= edges[doc + 1]], doc[hit + SHINGLE <= edges[doc + 1]]
        for d in np.unique(doc).tolist():
            own = grams[edges[d] : edges[d + 1] - SHINGLE + 1]
            for m in matches(items, texts[i + d], own, hit[doc == d] - edges[d], least):
                yield i + d, m


_FOUND = [("_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int64()), ("similarity", pa.float64())]


def _of_batch(sent, least: float):
    """A function that gives the matches of a batch: of the broadcast items, or of each row's own in _items."""
    items = None if sent is None else Items(sent.value)

    def found(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[int, int, int, int, float]]]:
        texts = texts_of(batch, "_text")
        if items is not None:
            yield from _found(items, texts, least)
            return
        for d, own in enumerate(column(batch, "_items")):
            if own:
                yield from ((d, m) for _, m in _found(Items([(x["i"], x["t"].encode()) for x in own]), [texts[d]], least))

    return found


def _scan(sent, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _of_batch(sent, least)
        for batch in batches:
            ids = column(batch, "_id")
            out = [(ids[d], *m) for d, m in found(batch)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _FOUND, strict=True)], [n for n, _ in _FOUND])

    return run


def _clean(sent, least: float, names: list[str]):
    """The rows of a batch whose _text holds no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _of_batch(sent, least)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[d for d, _ in found(batch)]] = False
            yield batch.select(names).filter(pa.array(clean))

    return run


def _grams_of(keep: str, once: bool):
    """Rows of keep and the shingles of _text, each once or as often as it is there, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(keep)).to_numpy(zero_copy_only=False)
            own = [shingles(joined([t])[0])[1] for t in texts_of(batch, "_text")]
            own = [np.unique(g) if once else g for g in own]
            n = [len(g) for g in own]
            grams = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n)), pa.array(grams), pa.array(np.repeat(n, n).astype(np.int64))], [keep, "gram", "n"])

    return run


def candidates(texts: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """_th and _items for the texts (_th, _text) that can hold items (i, t); _th is a hash of the text, and texts that share one share their items."""
    known = items.distinct().select("i", "t", F.xxhash64("i", "t").alias("k"), F.col("t").alias("_text"))
    tokens = stage(known.select("k", "_text").mapInArrow(_grams_of("k", False), "k long, gram long, n long"), "item_grams")
    often = stage(tokens.groupBy("gram").agg(F.count("*").alias("df")), "item_counts")
    own = tokens.join(often, "gram").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("own"))
    first = (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")
    rare = stage(own.select("k", F.explode(F.slice("own", F.lit(1), first)).alias("x")).select("k", "x.gram").distinct(), "rare")
    held = texts.mapInArrow(_grams_of("_th", True), "_th long, gram long, n long").join(rare, "gram").select("_th", "k").distinct()
    return stage(held.join(known.select("k", "i", "t"), "k").groupBy("_th").agg(F.collect_set(F.struct("i", "t")).alias("_items")), "candidates")


def _with_items(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, least: float) -> tuple[DataFrame, object]:
    """rows, which have _text, and the broadcast of a small benchmark; of a larger one the rows with their own _items, and None."""
    items = benchmark.select(F.col(quoted(item_col)).cast("long").alias("i"), F.col(quoted(item_text)).cast("string").alias("t")).where("i is not null and t is not null")
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) <= ITEM_BYTES:
        return rows, benchmark.sparkSession.sparkContext.broadcast([(r.i, r.t.encode()) for r in items.toLocalIterator()])
    rows = rows.withColumn("_th", F.xxhash64("_text"))
    found = candidates(rows.select("_th", "_text"), items, least)
    return rows.join(found, "_th", "left").drop("_th"), None


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.8
) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, start_word, n_words, hamming, similarity.

    Words have A-Z lower-cased and ASCII punctuation taken as space; shingles are of five words, and an item
    under five words never matches. A row for each item and each row of docs with a window of the item's length
    of that similarity, for its best and then first window; a document shorter than the item is one window. Ids may be null or repeat. Null texts and empty
    tables match nothing. A benchmark of at most ITEM_BYTES is sent to all tasks; see above for a larger one.
    """
    base = docs.select(id_key(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).cast("string").alias("_text"))
    rows, sent = _with_items(base, benchmark, item_col, item_text, least)
    found = rows.mapInArrow(_scan(sent, least), "_id long, item_id long, start_word long, n_words long, hamming long, similarity double")
    return found.select(given("_id").alias("doc_id"), "item_id", "start_word", "n_words", "hamming", "similarity")


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.8
) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, with their columns. Each row is judged by itself: with a small benchmark nothing is shuffled; ids aren't used."""
    held = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(quoted(c)).alias(h) for c, h in zip(docs.columns, held, strict=True)], F.col(quoted(text_col)).cast("string").alias("_text"))
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in held)
    rows, sent = _with_items(rows, benchmark, item_col, item_text, least)
    clean = rows.mapInArrow(_clean(sent, least, held), fields)
    return clean.select(*[F.col(h).alias(c) for c, h in zip(docs.columns, held, strict=True)])
