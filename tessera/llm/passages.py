"""Repeated windows across documents: the distributed part that suffix sorting and phrase automata share.

A window is a run of W units (bytes or words) of one document; wanted are all windows whose content also starts
somewhere else. Each window is assigned to one anchor in it: of its runs of k units, the leftmost with the least
hash. Equal windows have equal anchors at equal offsets, so they meet in one group. Neighbouring windows with the
same anchor form a fragment, the run of units that they cover together.

1. Count anchors; those found once have no repeated window. Partial sums keep very common ones cheap.
2. Of the rest, list the fragments by document, and mark one place of each distinct fragment.
3. Fetch the bytes of each distinct fragment once, with the number of its copies, group them by anchor and let a
   solver say which windows of each fragment also occur elsewhere, in a copy or in another fragment. An anchor
   with more than HOT distinct fragments is split: its fragments are cut into blocks of neighbouring windows and
   grouped anew by what all windows of a block share, which is nearly a window; what is hot still, into single
   windows. The same solver takes the groups of every level.

Documents are told apart by id and text hash; rows equal in both repeat each other's windows, as any copies do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _BYTE, CHUNK, chunks, column, id_key, joined, quoted, range_hash, released, settled, stage, texts_of, word_hashes, word_spans

#: Distinct fragments of one anchor that a task takes as a group; those of larger groups are split by content.
HOT = 200
_POS = np.uint64((1 << 28) - 1)

#: A solver takes the fragments of anchors, (anchor, f, copies, offset, n, bytes) each, and yields (anchor, f, first, last) offsets that repeat.
Solver = Callable[[Iterator[tuple]], Iterator[tuple[int, int, int, int]]]


class Unit:
    """What a window is made of: bytes, or words in a canonical text with single spaces."""

    def __init__(self, kind: str, window: int, k: int):
        if not 1 <= k <= window < 1024:
            raise ValueError("1 <= k <= window < 1024")
        self.kind, self.window, self.k = kind, window, k
        #: Windows in a block of a hot fragment.
        self.block = max(1, round((window - k + 1) ** 0.5))

    def canonical(self, text: bytes | None) -> bytes:
        return (text or b"") if self.kind == "bytes" else b" ".join((text or b"").split())

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Starts and ends of the units of a canonical text, None for bytes."""
        return None if self.kind == "bytes" else word_spans(np.frombuffer(text, np.uint8))

    def cut(self, text: bytes, spans: tuple[np.ndarray, np.ndarray] | None, i: int, j: int) -> bytes:
        return text[i:j] if spans is None else text[int(spans[0][i]) : int(spans[1][j - 1])]

    def runs(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window start of each fragment, its anchor's position and hash, over documents with these starts and ends."""
        n, none = len(codes), np.zeros(0, np.int64)
        if n < self.window:
            return none, none, none, none.view(np.uint64)
        at = np.arange(n - self.k + 1)
        grams = range_hash(codes, at, at + self.k)
        least, width, size = (grams & ~_POS) | at.astype(np.uint64), self.window - self.k + 1, 1
        while size * 2 <= width:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        end = np.repeat(ends, np.diff(np.append(starts, n)))
        start = np.flatnonzero(np.arange(len(least)) + self.window <= end[: len(least)])
        if not len(start):
            return none, none, none, none.view(np.uint64)
        pos = (least[start] & _POS).astype(np.int64)
        first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        last = np.append(first[1:], len(pos)) - 1
        return start[first], start[last], pos[first], grams[pos[first]]


def _pieces(unit: Unit, texts: list[bytes]) -> Iterator[tuple]:
    """Unit codes in pieces of bounded size: codes, the documents' starts and ends in them, the text, its spans, the piece's first unit and document, the documents' first units."""
    for i, j in chunks(texts):
        buf, offsets = joined(texts[i:j])
        whole = buf.tobytes()
        if unit.kind == "bytes":
            # The line feed after a text isn't part of it.
            spans, codes, starts, ends = None, None, offsets[:-1], offsets[1:] - 1
        else:
            *spans, codes = word_hashes(buf)
            edges = np.searchsorted(spans[0], offsets)
            starts, ends = edges[:-1], edges[1:]
        n = int(ends[-1])
        step = 2 * CHUNK if n > 2 * CHUNK else max(n, 1)
        for a in range(0, max(n, 1), step):
            b = min(n, a + step + unit.window - 1)
            part = _BYTE[buf[a:b]] if codes is None else codes[a:b]
            yield part, np.clip(starts, a, b) - a, np.clip(ends, a, b) - a, whole, spans, a, i, starts


def anchor_counts(unit: Unit, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of canonical texts and how many fragments have each."""
    found = [unit.runs(codes, starts, ends)[3] for codes, starts, ends, *_ in _pieces(unit, texts)]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


def fragments(unit: Unit, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of canonical texts, arrays of document, first window, number of windows, the anchor's offset from the first, anchor and content hash of all fragments."""
    digest = xxhash.xxh3_64_intdigest
    for codes, starts, ends, whole, spans, base, doc0, begun in _pieces(unit, texts):
        lo, hi, pos, anchors = unit.runs(codes, starts, ends)
        if not len(lo):
            continue
        doc = np.searchsorted(starts, lo, "right") - 1
        if spans is None:
            b0, b1 = lo + base, hi + base + unit.window
        else:
            b0, b1 = spans[0][lo + base], spans[1][hi + base + unit.window - 1]
        view = memoryview(whole)
        content = [digest(view[x:y]) for x, y in zip(b0.tolist(), b1.tolist(), strict=True)]
        yield doc + doc0, lo + base - begun[doc], hi - lo + 1, pos - lo, anchors, np.array(content, np.uint64)


def _parts(unit: Unit, batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts that windows are taken from: whole canonical texts, or the runs in _within; with the row and the first unit of each."""
    texts = [unit.canonical(t) for t in texts_of(batch, "_text")]
    if "_within" not in batch.schema.names:
        return texts, np.arange(len(texts)), np.zeros(len(texts), np.int64)
    runs = [(i, r["s"], r["e"]) for i, own in enumerate(column(batch, "_within")) for r in own or ()]
    return [texts[i][s:e] for i, s, e in runs], np.array([i for i, _, _ in runs], np.int64), np.array([s for _, s, _ in runs], np.int64)


def _anchors(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, counts = anchor_counts(unit, _parts(unit, batch)[0])
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(counts, pa.int64())], ["_anchor", "_c"])

    return run


def _occurrences(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("_id")).to_numpy(zero_copy_only=False)
            ths = batch.column(batch.schema.get_field_index("_th")).to_numpy(zero_copy_only=False)
            texts, rows, first = _parts(unit, batch)
            for doc, lo, n, off, anchor, content in fragments(unit, texts):
                cols = [ids[rows[doc]], ths[rows[doc]], ((lo + first[doc]) << 20) | (n << 10) | off, anchor.view(np.int64), content.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["_id", "_th", "_at", "_anchor", "_f"])

    return run


def cut_places(unit: Unit, batch: pa.RecordBatch, fields: tuple[str, ...], most: int = 4000) -> Iterator[tuple]:
    """The places in _asked, about most at a time: the row of each, its first unit, number of windows and anchor's offset, the other fields as arrays, and the bytes."""
    asked = batch.column(batch.schema.get_field_index("_asked"))
    edges = np.append(0, np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False)))
    flat = asked.flatten()
    at = flat.field("_at").to_numpy(zero_copy_only=False)
    lo, n, off = at >> 20, at >> 10 & 1023, at & 1023
    end = lo + n - 1 + unit.window
    others, row = [flat.field(f).to_numpy(zero_copy_only=False) for f in fields], np.repeat(np.arange(batch.num_rows), np.diff(edges))
    data: list[bytes] = []
    done = 0
    for i, text in enumerate(texts_of(batch, "_text")):
        a, b = int(edges[i]), int(edges[i + 1])
        text = unit.canonical(text)
        spans = unit.spans(text)
        x, y = (lo[a:b], end[a:b]) if spans is None else (spans[0][lo[a:b]], spans[1][end[a:b] - 1])
        data.extend([text[s:e] for s, e in zip(x.tolist(), y.tolist(), strict=True)])
        if len(data) >= most or i == batch.num_rows - 1:
            part = slice(done, b)
            yield row[part], lo[part], n[part], off[part], [o[part] for o in others], data
            data, done = [], b


def _fetch(unit: Unit):
    """The bytes of the fragments that are asked for, with the number of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, n, off, (anchor, f, copies), data in cut_places(unit, batch, ("_anchor", "_f", "_n")):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(f), pa.array(copies), pa.array(off), pa.array(n), pa.array(data, pa.binary())], _FRAGMENT)

    return run


_FRAGMENT = ["_anchor", "_f", "_n", "_off", "_wins", "_bytes"]
FRAGMENT = "_anchor long, _f long, _n long, _off long, _wins long, _bytes binary"
_OFFSETS = "_anchor long, _f long, _o1 long, _o2 long"


def rows_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of longs, and of bytes where a name is _bytes."""
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "_bytes" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)


def row_tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _solve(solver: Solver):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for x in solver(row_tuples(batches)):
            found.append(x)
            if len(found) >= 20_000:
                yield rows_batch(found, ["_anchor", "_f", "_o1", "_o2"])
                found = []
        yield rows_batch(found, ["_anchor", "_f", "_o1", "_o2"])

    return run


def grouped(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Runs of rows with one anchor, each fragment once."""
    group: dict[int, tuple] = {}
    anchor = None
    for row in rows:
        if group and row[0] != anchor:
            yield list(group.values())
            group = {}
        anchor = row[0]
        group.setdefault(row[1], row)
    if group:
        yield list(group.values())


def _blocks(unit: Unit, width: int):
    """Hot fragments cut by the anchor's offset into blocks of width windows: rows of parent, new group, fragment; the group is the hash of what all windows of a block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_pa", "_pf", *_FRAGMENT]
        for batch in batches:
            out: list[tuple] = []
            for anchor, f, n, off, wins, data in row_tuples(iter([batch])):
                spans = unit.spans(data)
                for b in range((off - wins + 1) // width, off // width + 1):
                    lo, hi = max(b * width, off - wins + 1), min(b * width + width - 1, off)
                    core = unit.cut(data, spans, off - b * width, off - b * width + unit.window - width + 1)
                    own = unit.cut(data, spans, off - hi, off - lo + unit.window)
                    key = xxhash.xxh3_64_intdigest(core, (anchor * 31 + b) % 2**64) - 2**63
                    out.append((anchor, f, key, xxhash.xxh3_64_intdigest(own, hi) - 2**63, n, hi, hi - lo + 1, own))
                if len(out) >= 4000:
                    yield rows_batch(out, names)
                    out = []
            yield rows_batch(out, names)

    return run


def solve(parts: DataFrame, unit: Unit, solver: Solver, widths: tuple[int, ...]) -> DataFrame:
    """_anchor, _f and offsets _o1 to _o2 that repeat, of staged distinct fragments with their copies; hot anchors are split into blocks of each of the widths in turn."""
    some_hot = False
    if widths:
        hot = stage(parts.groupBy("_anchor").agg(F.count("*").alias("_m")).where(F.col("_m") > HOT).select("_anchor"), "hot")
        some_hot = not hot.isEmpty()
    cool = parts.join(hot, "_anchor", "left_anti") if some_hot else parts
    solved = cool.repartition("_anchor").sortWithinPartitions("_anchor").mapInArrow(_solve(solver), _OFFSETS)
    if not some_hot:
        return solved
    cut = stage(parts.join(hot, "_anchor", "left_semi").mapInArrow(_blocks(unit, widths[0]), f"_pa long, _pf long, {FRAGMENT}"), "blocks")
    inner = cut.groupBy("_anchor", "_f")
    inner = inner.agg(F.sum("_n").alias("_n"), F.first("_off").alias("_off"), F.first("_wins").alias("_wins"), F.first("_bytes").alias("_bytes"))
    found = stage(solve(stage(inner.select(*_FRAGMENT), "fragments"), unit, solver, widths[1:]).distinct(), "solved")
    back = cut.select("_pa", "_pf", "_anchor", "_f").join(found, ["_anchor", "_f"])
    return solved.unionByName(back.select(F.col("_pa").alias("_anchor"), F.col("_pf").alias("_f"), "_o1", "_o2"))


class Repeats:
    """Staged tables of the fragments whose anchor is found again.

    base has _id, _th, _text, and _within (runs of units as [s, e)) where windows are taken from these only.
    again lists every place of such a fragment: _id, _th, _at, _anchor, _f.
    """

    def __init__(self, base: DataFrame, unit: Unit):
        counts = base.select(*[c for c in base.columns if c in ("_text", "_within")]).mapInArrow(_anchors(unit), "_anchor long, _c long")
        # Tables joined to on hot keys are staged: a join of plain exchanges is one that Spark can split.
        anchors = stage(counts.groupBy("_anchor").agg(F.sum("_c").alias("_c")).where("_c > 1").select("_anchor"), "anchors")
        found = base.mapInArrow(_occurrences(unit), "_id long, _th long, _at long, _anchor long, _f long")
        self.again = stage(found.join(anchors, "_anchor").select("_id", "_th", "_at", "_anchor", "_f"), "occurrences")
        self.base, self.unit = base, unit

    def parts(self) -> DataFrame:
        """Every distinct fragment once with the number of its copies and its bytes, staged."""
        distinct = self.again.groupBy("_anchor", "_f").agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_th", "_at")).alias("_from"))
        out = stage(self.fetched(distinct.select("_from.*", "_anchor", "_f", "_n"), _fetch(self.unit), FRAGMENT), "fragments")
        released(self.base.sparkSession)
        return out

    def fetched(self, places: DataFrame, fetch: Callable, fields: str) -> DataFrame:
        """fetch over the documents of places (_id, _th, and others that come as structs in _asked), each document read once."""
        asked = places.groupBy("_id", "_th").agg(F.collect_set(F.struct(*[c for c in places.columns if c not in ("_id", "_th")])).alias("_asked"))
        return self.base.select("_id", "_th", "_text").join(asked, ["_id", "_th"]).mapInArrow(fetch, fields)

    def ranges(self, parts: DataFrame, solver: Solver) -> DataFrame:
        """_anchor, _f and _ranges, the offsets [_o1, _o2] that repeat."""
        widths = (self.unit.block, 1) if self.unit.block > 1 else (1,)
        return solve(parts, self.unit, solver, widths).groupBy("_anchor", "_f").agg(F.collect_list(F.struct("_o1", "_o2")).alias("_ranges"))

    def runs(self, solver: Solver) -> DataFrame:
        """For documents with repeated windows: _id, _th and _runs, the covered runs of units as [s, e), unsorted and overlapping."""
        ranges = settled(self.base.sparkSession, lambda: self.ranges(self.parts(), solver), "solved")
        lo, off = F.shiftright("_at", 20), F.col("_at").bitwiseAND(F.lit(1023))
        run = lambda r: F.struct((lo + off - r["_o2"]).alias("s"), (lo + off - r["_o1"] + F.lit(self.unit.window)).alias("e"))
        found = self.again.join(ranges, ["_anchor", "_f"]).select("_id", "_th", F.transform("_ranges", run).alias("_runs"))
        return found.groupBy("_id", "_th").agg(F.flatten(F.collect_set("_runs")).alias("_runs"))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: object) -> DataFrame:
    text = F.col(quoted(text_col)).cast("string")
    return docs.select(id_key(quoted(id_col)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"), *more)


def merged(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Covered runs as sorted, separate [start, end)."""
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in runs or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
