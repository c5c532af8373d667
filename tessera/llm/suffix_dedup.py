"""Exact removal of byte strings that repeat anywhere, by sorting suffixes the deep-shallow way.

Only suffixes at anchors are sorted (passages.py says what these are and how they meet). Of the fragments of one
anchor, the suffixes from it and the reversed prefixes before it are each sorted: multikey quicksort to a shallow
depth past what all have in common, then blind tries for the groups that are still equal there. The common prefix
of any two is the least of the neighbouring ones between them, so from both orders follows, for each pair, how far
they agree to the left and to the right, and with that which windows of a fragment occur in another. Copies of a
fragment are one string with a number, its neighbour in the order being itself.

Two lengths are asked for. What repeats for the shorter one is found first; the longer strings that repeat lie
within runs of it, so only those runs are looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, others, quoted, settled, stage, texts_of
from tessera.llm.passages import Repeats, Unit, grouped, keyed, merged

#: Bytes past the common prefix that quicksort looks at before blind tries take over.
SHALLOW = 6


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """A compacted trie that keeps branching depths and bytes only; a string's own bytes are compared once, with one leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        node, path = self.root, []
        while isinstance(node, tuple):
            path.append(node)
            branch = node[1]
            node = branch.get(self._byte(i, node[0])) or next(iter(branch.values()))
        met = node[0]
        same = common_prefix(self.strings[i], self.strings[met])
        if same == len(self.strings[i]) == len(self.strings[met]):
            node.append(i)
            return
        above = None
        for x in path:
            if x[0] >= same:
                break
            above = x
        below = self.root if above is None else above[1][self._byte(met, above[0])]
        if isinstance(below, tuple) and below[0] == same:
            below[1][self._byte(i, same)] = [i]
            return
        new = (same, {self._byte(met, same): below, self._byte(i, same): [i]})
        if above is None:
            self.root = new
        else:
            above[1][self._byte(met, above[0])] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of the strings, a string before those that it is a prefix of."""
    if len(strings) < 2:
        return list(range(len(strings)))
    start = common_prefix(min(strings), max(strings))
    out: list[int] = []
    stack = [(list(range(len(strings))), start)]
    while stack:
        part, depth = stack.pop()
        if len(part) < 2:
            out.extend(part)
        elif depth - start >= SHALLOW:
            trie = BlindTrie(strings)
            for i in part:
                trie.add(i)
            out.extend(trie.order())
        else:
            byte = {i: strings[i][depth] if depth < len(strings[i]) else -1 for i in part}
            pivot = sorted(byte[part[x]] for x in (0, len(part) // 2, -1))[1]
            less, same, more = [], [], []
            for i in part:
                (less if byte[i] < pivot else more if byte[i] > pivot else same).append(i)
            stack.append((more, depth))
            if pivot < 0:  # all ended: equal
                stack.append((same[:1], depth))
                stack.extend(([i], depth) for i in same[1:])
            else:
                stack.append((same, depth + 1))
            stack.append((less, depth))
    return out


def _neighbours(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, ranks, and the common prefix of each string in the order with the one before it."""
    order = np.array(deep_shallow(strings))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    shared = [common_prefix(strings[a], strings[b]) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
    return order, rank, np.array([0, *shared], np.int64)


def _agreement(i: int, order: np.ndarray, rank: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The common prefix of string i with each, by string (its own: 0)."""
    r, out = rank[i], np.zeros(len(order), np.int64)
    if r + 1 < len(order):
        out[order[r + 1 :]] = np.minimum.accumulate(shared[r + 1 :])
    if r:
        out[order[:r]] = np.minimum.accumulate(shared[r:0:-1])[::-1]
    return out


def repeated_offsets(group: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """For fragments of one anchor, (anchor, f, copies, offset, windows, bytes) each, offsets of the anchor in windows that occur in another one or a copy."""
    right, left = [x[5][x[3] :] for x in group], [x[5][: x[3]][::-1] for x in group]
    forward, backward = _neighbours(right), _neighbours(left)
    for i, x in enumerate(group):
        first, last = x[3] - x[4] + 1, x[3]
        rights, lefts = _agreement(i, *forward), _agreement(i, *backward)
        if x[2] > 1:
            rights[i], lefts[i] = len(right[i]), len(left[i])
        lo, hi = np.maximum(window - rights, first), np.minimum(lefts, last)
        ok = lo <= hi
        ok[i] &= x[2] > 1
        if ok.any():
            marks = np.zeros(window + 2, np.int64)
            np.add.at(marks, lo[ok], 1)
            np.add.at(marks, hi[ok] + 1, -1)
            edges = np.flatnonzero(np.diff(np.append(0, np.cumsum(marks) > 0).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                yield x[0], x[1], a, b - 1


def pair_offsets(group: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """repeated_offsets for one or two fragments, whose order needs no sorting: the neighbour is the copy or the other one."""
    rights, lefts = (common_prefix(*[x[5][x[3] :] for x in group]), common_prefix(*[x[5][: x[3]][::-1] for x in group])) if len(group) == 2 else (-1, -1)
    for x in group:
        first, last = x[3] - x[4] + 1, x[3]
        lo, hi = (first, last) if x[2] > 1 else (max(window - rights, first), min(lefts, last))
        if lo <= hi:
            yield x[0], x[1], lo, hi


def _solver(window: int):
    def solve(rows: Iterator[tuple]) -> Iterator[tuple[int, int, int, int]]:
        for group in grouped(rows):
            yield from (repeated_offsets if len(group) > 2 else pair_offsets)(group, window)

    return solve


def _long_runs(least: int):
    """Keeps documents with covered runs of least units or more, and these runs as _within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for batch in batches:
            within = [[{"s": s, "e": e} for s, e in merged(runs) if e - s >= least] for runs in column(batch, "_runs")]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in ("_id", "_th", "_text")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(within, kind)], ["_id", "_th", "_text", "_within"]).filter(pa.array([bool(w) for w in within], pa.bool_()))

    return run


def _remove(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, spans, short = [], [], [], [], []
            for text, runs, more in zip(texts_of(batch, "_text"), column(batch, "_runs"), column(batch, "_shorter"), strict=True):
                text, gone = text or b"", merged(runs)
                out, at = [], 0
                for s, e in gone:
                    out.append(text[at:s])
                    at = e
                kept.append(b"".join([*out, text[at:]]))
                sizes.append(len(text))
                removed.append(sum(e - s for s, e in gone))
                spans.append(len(gone))
                short.append(sum(e - s for s, e in merged(more)))
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            cols += [pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans, short)]]
            yield pa.RecordBatch.from_arrays(cols, [*names, *MADE])

    return run


MADE = ("kept", "n_bytes", "n_removed", "n_spans", "n_shared")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, anchor: int = 64, shorter: int | None = None) -> DataFrame:
    """Remove every byte covered by a string of window bytes that also starts anywhere else.

    Texts are UTF-8 bytes (null: empty); matches never cross documents and are judged on the input. Returns the
    columns of docs without the text, and kept (binary: the remaining bytes, which can break within a character),
    n_bytes, n_removed, n_spans and n_shared; columns of those names are replaced. n_shared is the number of bytes
    covered by strings of shorter bytes (half of window if not given, at most window) that repeat: it tells of passages too short to be
    removed. Ids may be null or repeat: rows equal in id and text are copies like any others and lose what they
    share. An empty table gives an empty result.
    """
    shorter = max(1, window // 2) if shorter is None else shorter
    if not 0 < shorter <= window:
        raise ValueError("0 < shorter <= window")
    base = keyed(docs, id_col, text_col)
    k = max(1, min(anchor, shorter * anchor // window))
    spark = docs.sparkSession
    short = settled(spark, lambda: Repeats(base, Unit("bytes", shorter, k)).runs(_solver(shorter)), "shorter")
    runs = short
    if shorter < window:
        fields = "_id long, _th long, _text string, _within array<struct<s: long, e: long>>"
        near = base.join(short, ["_id", "_th"]).select("_id", "_th", "_text", "_runs")

        def longer() -> DataFrame:
            within = stage(near.mapInArrow(_long_runs(window), fields), "within")
            return Repeats(within, Unit("bytes", window, anchor)).runs(_solver(window))

        runs = settled(spark, longer, "longer")
    both = short.select("_id", "_th", F.col("_runs").alias("_shorter")).join(runs.select("_id", "_th", "_runs"), ["_id", "_th"], "left")
    names = [c for c in others(docs, *MADE) if c != text_col]
    rows = keyed(docs, id_col, text_col, *[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(names)])
    held = [f"_c{i}" for i in range(len(names))]
    fields = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in held] + ["kept binary", *[f"{c} long" for c in MADE[1:]]])
    out = rows.join(both, ["_id", "_th"], "left").mapInArrow(_remove(held), fields)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], *MADE)
