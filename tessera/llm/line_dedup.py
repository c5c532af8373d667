"""Line de-duplication across documents with a pair of Bloom filters.

The hashes of line keys go into two filters of one geometry: the first holds what was seen once, the second what
was found in the first already. Then only lines that hit the second filter shuffle, as suspected repeats; their
keys are compared exactly and the smallest doc_id keeps its lines.

The filters are dealt in blocks, each made by one task from the distinct hashes that other tasks send it. While
the second filter is small it is broadcast; a larger one stays dealt, and the 8-byte hashes of the lines are sent to
its blocks, which return the suspects. A block that a very common line makes hot is sent out several times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, column, id_key, others, quoted, settled, stage, texts_of

STRIP = b" \t\n\x0b\x0c\r"
#: A filter is dealt in blocks of 2**BLOCK bits; a hash stays within one.
BLOCK = 17
PROBES = 4
#: Hashes that a task holds before it sends the distinct ones on.
HELD = 1 << 20
#: Lines that one task looks up in a block, about.
LOOKUPS = 2_000_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space with A-Z lower-cased; None if under min_chars code points."""
    key = line.strip(STRIP).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _bits(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and, as rows, its bits within the block."""
    block = (hashes >> np.uint64(40)) % np.uint64(n_blocks)
    a, b = hashes & np.uint64(0xFFFFF), (hashes >> np.uint64(20)) | np.uint64(1)
    probes = (a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) & np.uint64((1 << BLOCK) - 1)
    return block.astype(np.int64), probes.astype(np.int64)


class Pair:
    """One block of the once-seen and of the twice-seen filter."""

    def __init__(self):
        self.once, self.again = np.zeros(1 << BLOCK, bool), np.zeros(1 << BLOCK, bool)

    def add(self, hashes: np.ndarray, twice: np.ndarray) -> None:
        """Take hashes; twice marks those known to repeat. Distinct ones of a call are looked up before any is put in."""
        order = np.argsort(hashes, kind="stable")
        first = np.append(True, hashes[order][1:] != hashes[order][:-1]) if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        if not len(at):
            return
        repeat = (np.diff(np.append(at, len(order))) > 1) | np.logical_or.reduceat(twice[order], at)
        _, p = _bits(hashes[order][at], 1)
        repeat |= self.once[p].all(1)
        self.once[p.ravel()] = True
        self.again[p[repeat].ravel()] = True


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _hash(keys: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, keys)), np.uint64)


def _emit(n_blocks: int, min_chars: int):
    """Distinct hashes of a task's lines, and whether more of its documents hold one."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        block, _ = _bits(hashes, n_blocks)
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(hashes.view(np.int64)), pa.array(counts > 1)], ["block", "hash", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for text in texts_of(batch, "_text"):
                held.append(_hash(list(_keys(text, min_chars))))
                size += len(held[-1])
                if size >= HELD:
                    yield sent(held)
                    held, size = [np.zeros(0, np.uint64)], 0
        yield sent(held)

    return run


def _by_block(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of sorted batches with one block each."""
    for batch in batches:
        block = batch.column(at).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j:
                yield int(block[i]), batch.slice(i, j - i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-seen filter of each block, of rows sorted by block."""
    now, pair = None, Pair()

    def made() -> pa.RecordBatch:
        some = now is not None and pair.again.any()
        bits = [np.packbits(pair.again).tobytes()] if some else []
        return pa.RecordBatch.from_arrays([pa.array([now] * len(bits), pa.int64()), pa.array(bits, pa.binary())], ["block", "bits"])

    for block, rows in _by_block(batches):
        if block != now:
            yield made()
            now, pair = block, Pair()
        pair.add(rows.column(1).to_numpy(zero_copy_only=False).view(np.uint64), rows.column(2).to_numpy(zero_copy_only=False))
    yield made()


def _all_set(bits: bytes, probes: np.ndarray) -> np.ndarray:
    """Whether all of a row's probes are set in a packed block, which stays packed."""
    return ((np.frombuffer(bits, np.uint8)[probes >> 3] >> (7 - (probes & 7)).astype(np.uint8)) & 1).astype(bool).all(1)


def _suspects(bits, n_blocks: int, min_chars: int):
    """Lines that hit the broadcast blocks of the twice-seen filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = bits.value
        for batch in batches:
            ids, ths, keys = [], [], []
            for i, th, text in zip(column(batch, "_id"), column(batch, "_th"), texts_of(batch, "_text"), strict=True):
                own = _keys(text, min_chars)
                ids.extend([i] * len(own))
                ths.extend([th] * len(own))
                keys.extend(own)
            block, probes = _bits(_hash(keys), n_blocks)
            hit = np.zeros(len(keys), bool)
            for b in np.unique(block):
                if (again := blocks.get(int(b))) is not None:
                    rows = np.flatnonzero(block == b)
                    hit[rows] = _all_set(again, probes[rows])
            at = np.flatnonzero(hit).tolist()
            yield _suspect_batch([(ids[x], ths[x], keys[x]) for x in at])

    return run


def _suspect_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["_id", "_th", "_key"])


def _lookups(n_blocks: int, min_chars: int):
    """The hash of each distinct line of a document, with its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_hash(list(_keys(t, min_chars))) for t in texts_of(batch, "_text")]
            hashes, n = np.concatenate([np.zeros(0, np.uint64), *own]), [len(x) for x in own]
            cols = [np.repeat(np.array(column(batch, c), np.int64), n) for c in ("_id", "_th")]
            yield pa.RecordBatch.from_arrays([pa.array(_bits(hashes, n_blocks)[0]), *map(pa.array, cols), pa.array(hashes.view(np.int64))], ["block", "_id", "_th", "hash"])

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block and salt, the filter's row first: the lines that hit it."""
    key, again = None, None
    for block, rows in _by_block(batches):
        salts, lines = rows.column(1).to_pylist(), rows.column(2).to_pylist()
        cuts = [0, *[i for i in range(1, len(salts)) if salts[i] != salts[i - 1]], len(salts)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if (block, salts[i]) != key:
                key, again = (block, salts[i]), None
            if not lines[i]:
                again, i = rows.column(6)[i].as_py(), i + 1
            if again is not None and i < j:
                part = rows.slice(i, j - i)
                _, probes = _bits(part.column(5).to_numpy(zero_copy_only=False).view(np.uint64), 1)
                yield part.select(["_id", "_th", "hash"]).filter(pa.array(_all_set(again, probes)))


def _named(min_chars: int):
    """The keys of the lines of a document that have one of the suspected hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, th, text, asked in zip(column(batch, "_id"), column(batch, "_th"), texts_of(batch, "_text"), column(batch, "_hashes"), strict=True):
                asked, keys = set(asked), list(_keys(text, min_chars))
                out.extend((i, th, k) for k, h in zip(keys, _hash(keys).view(np.int64).tolist(), strict=True) if h in asked)
            yield _suspect_batch(out)

    return run


def suspected(base: DataFrame, n_bits: int, min_chars: int, max_filter_bits: int) -> DataFrame:
    """_id, _th, _key of the lines that hit the twice-seen filter of n_bits; base has _id, _th and _text."""
    n_blocks = max(1, n_bits >> BLOCK)
    sent = base.select("_text").mapInArrow(_emit(n_blocks, min_chars), "block long, hash long, twice boolean")
    blocks = sent.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block long, bits binary")
    if n_bits <= max_filter_bits:
        bits = base.sparkSession.sparkContext.broadcast({r.block: bytes(r.bits) for r in blocks.toLocalIterator()})
        return base.mapInArrow(_suspects(bits, n_blocks, min_chars), "_id long, _th long, _key binary")
    lines = base.mapInArrow(_lookups(n_blocks, min_chars), "block long, _id long, _th long, hash long")
    load = stage(lines.groupBy("block").agg(F.ceil(F.count("*") / LOOKUPS).cast("int").alias("salts")), "loads")
    none = F.lit(0).cast("long")
    filters = blocks.join(load, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    filters = filters.select("block", "salt", F.lit(False).alias("line"), none.alias("_id"), none.alias("_th"), none.alias("hash"), "bits")
    asked = lines.join(load, "block").withColumn("salt", F.pmod(F.xxhash64("_id", "_th"), "salts"))
    asked = asked.select("block", "salt", F.lit(True).alias("line"), "_id", "_th", "hash", F.lit(None).cast("binary").alias("bits"))
    rows = filters.unionByName(asked).repartition("block", "salt").sortWithinPartitions("block", "salt", "line")
    hits = rows.mapInArrow(_probe, "_id long, _th long, hash long").groupBy("_id", "_th").agg(F.collect_set("hash").alias("_hashes"))
    return base.join(stage(hits, "suspects"), ["_id", "_th"]).mapInArrow(_named(min_chars), "_id long, _th long, _key binary")


def _drop_lines(min_chars: int, text_name: str, keep_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, totals, dropped = [], [], []
            for text, gone in zip(texts_of(batch, "_text"), column(batch, "_drop"), strict=True):
                lines = (text or b"").split(b"\n")
                left = lines
                if gone:
                    gone = set(gone)
                    left = [x for x in lines if line_key(x, min_chars) not in gone]
                totals.append(len(lines))
                dropped.append(len(lines) - len(left))
                kept.append(text if text is None or not dropped[-1] else b"\n".join(left))
            out = [batch.column(batch.schema.get_field_index(n)) for n in keep_names]
            out += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*keep_names, text_name, "n_lines", "n_dropped"])

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, bits_per_line: int = 12, max_filter_bits: int = 1 << 28
) -> DataFrame:
    """Drop every line that a document with a smaller id holds too.

    Lines are compared by their key (white space stripped, A-Z lower-cased); keys under min_chars code points
    are never dropped, and a document's own repeats stay. Returns the input columns with the text replaced,
    and n_lines (before dropping) and n_dropped as longs; input columns of those names are replaced.

    Rows of one id are one document: they keep a common line together. A null id counts as the largest. A
    null text is one empty line and stays null. An empty table gives an empty result.

    Both filters are used at every size. A twice-seen filter of at most max_filter_bits (32 MB) is broadcast; for a
    larger one the lines' hashes are sent to its blocks.
    """
    keep = [c for c in others(docs, "n_lines", "n_dropped") if c != text_col]
    text = F.col(quoted(text_col)).cast("string")
    # Rows without an id are told apart by their text, so that no list holds the lines of all of them.
    at = [id_key(quoted(id_col)).alias("_id"), F.when(id_key(quoted(id_col)) == F.lit(NO_ID), F.xxhash64(text)).otherwise(F.lit(0).cast("long")).alias("_th")]
    base = docs.select(*at, text.alias("_text"))
    breaks = F.octet_length("_text") - F.octet_length(F.replace(F.col("_text"), F.lit("\n"), F.lit("")))
    n_lines = base.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0
    n_bits = 1 << max(BLOCK, int(n_lines * bits_per_line).bit_length())

    def dropped() -> DataFrame:
        suspects = stage(suspected(base, n_bits, min_chars, max_filter_bits), "lines")
        ends = suspects.groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
        # Staged, as a join of two plain exchanges is one that Spark can split where a key is hot.
        repeats = stage(ends.where("_first < _last").drop("_last"), "repeats")
        return suspects.join(repeats, "_key").where("_id > _first").groupBy("_id", "_th").agg(F.collect_set("_key").alias("_drop"))

    drop = settled(docs.sparkSession, dropped, "dropped")
    rows = docs.select(
        *[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(keep)],
        text.alias("_text"),
        *at,
    )
    whole = rows.join(drop, ["_id", "_th"], "left").drop("_id", "_th")
    fields = ", ".join([f"_c{i} {rows.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(keep))] + ["_text string, n_lines long, n_dropped long"])
    out = whole.mapInArrow(_drop_lines(min_chars, "_text", [f"_c{i}" for i in range(len(keep))]), fields)
    back = {c: F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)} | {text_col: F.col("_text").alias(text_col)}
    return out.select(*[back[c] for c in others(docs, "n_lines", "n_dropped")], "n_lines", "n_dropped")
