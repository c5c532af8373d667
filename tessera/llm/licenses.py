"""Licences in texts: word-bigram Dice coefficient against templates.

Compared are the segments of a text that can be a notice or a licence: each line, each block of several lines without
a blank one between, the whole text if it has more than one block, and, for each template of 40 bigrams or more, the
stretches of lines that are made of it: a line counts two for each of its bigrams that the template has, less one for
each bigram; a stretch is a run of lines of the largest sum (of equal ones the shortest, then the first), and the same
again to its left and right. All stretches are found in one pass over the lines (Ruzzo and Tompa). Of segments that
overlap, the one that shares most with its licence stays (bigrams shared times coefficient; of equals the shortest), so
a notice within a licence, or a licence that resembles a longer one, gives way to it. A segment with x distinct bigrams can reach
a coefficient c only with templates of between x * c / (2 - c) and x * (2 - c) / c; templates outside these bounds
are never compared.

Before that, segments are told from ordinary text by hashes of bigrams that templates have: c * b / (2 - c) bigrams
are shared with a template of b, and c * x / (2 - c) of the segment's own are, so that one with fewer known
bigrams has no template. This is counted for all segments of a batch at once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _GAP, chunks, column, given, id_key, joined, quoted, range_hash, texts_of, word_hashes

# Names of licences and texts of their usual notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

#: Full texts of licences, each in a file of its name, as published.
BODIES = {p.stem: p.read_text("ascii") for p in sorted(Path(__file__).with_name("notices").glob("*.txt"))}
for _name, _text in BODIES.items():
    TEMPLATES[_name] = (*TEMPLATES.get(_name, ()), _text)

_WORD = re.compile(r"[^\W_]+")
_SMALL = {i: i + 32 for i in range(65, 91)}
#: A-Z as a-z; what isn't an ASCII letter or digit as a space.
_PLAIN = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123)):
    _PLAIN[_a:_b] = np.arange(_a, _b)
_PLAIN[65:91] = np.arange(97, 123)


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words of the normalised text: A-Z in lower case, punctuation as space; start and end count as words, so that one word has two."""
    words = _WORD.findall(text.translate(_SMALL))
    return frozenset(zip(["^", *words], [*words, "$"], strict=True)) if words else frozenset()


def _grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the ASCII words of a buffer and the hashes of neighbouring pairs."""
    starts, _, hashes = word_hashes(_PLAIN[buf])
    at = np.arange(max(0, len(hashes) - 1))
    return starts, range_hash(hashes, at, at + 2) if len(at) else np.zeros(0, np.uint64)


def stretches(values: list[int]) -> list[tuple[int, int]]:
    """The run of largest positive sum, and so on to its left and right, in one pass: first and last place of each, in order."""
    held: list[tuple[int, int, int, int]] = []  # first, last, sum before, sum with it
    total = 0
    for k, v in enumerate(values):
        total += v
        if v <= 0:
            continue
        now = (k, k, total - v, total)
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= now[2]:
                j -= 1
            if j < 0 or held[j][3] >= now[3]:
                held.append(now)
                break
            now = (held[j][0], k, held[j][2], total)
            del held[j:]
    return [(a, b) for a, b, _, _ in held]


def _hashes(text: str) -> np.ndarray:
    return _grams(np.frombuffer(text.encode("ascii"), np.uint8))[1]


#: Distinct bigrams from which on a template is looked for in stretches of lines.
LONG = 40


class Templates:
    """Templates, which are ASCII texts, ordered by size."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], least: float):
        self.least = least
        made = sorted(((bigrams(t), name, t) for name, texts in templates.items() for t in texts), key=lambda x: (len(x[0]), x[1], sorted(x[0])))
        self.rows = [(b, name) for b, name, _ in made if b]
        self.sizes = [len(b) for b, _ in self.rows]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hashes(t) for texts in templates.values() for t in texts)]))
        #: Templates that are looked for in stretches of lines, which of the known bigrams each has, and how many of them a stretch has at least.
        long = [(b, t) for b, _, t in made if len(b) >= LONG]
        self.member = np.array([np.isin(self.known, _hashes(t)) for _, t in long], bool).reshape(len(long), len(self.known))
        self.needs = np.array([max(1, int(np.ceil(len(b) * least / (2 - least) - 1e-9)) - 2) for b, _ in long], np.int64)
        #: Of the bigrams that a segment shares with the smallest template, two at most are with its start and end.
        self.need = max(0, int(np.ceil(min(self.sizes, default=0) * least / (2 - least) - 1e-9)) - 2)
        self.largest = max(self.sizes, default=0) * (2 - least) / least + 1e-9

    def matches(self, segment: str) -> dict[str, tuple[float, float]]:
        """The licence with the highest coefficient, if that reaches the threshold, and that coefficient times the bigrams shared; of equal ones all."""
        own = bigrams(segment)
        x, found, c = len(own), {}, self.least
        lo, hi = bisect_left(self.sizes, x * c / (2 - c) - 1e-9), bisect_right(self.sizes, x * (2 - c) / c + 1e-9)
        for b, name in self.rows[lo:hi] if x else ():
            shared = len(own & b)
            dice = 2 * shared / (x + len(b))
            if dice >= c:
                found[name] = max((dice, shared * dice), found.get(name, (0.0, 0.0)))
        top = max((dice for dice, _ in found.values()), default=0.0)
        return {name: x for name, x in found.items() if x[0] == top}

    def best(self, segment: str) -> dict[str, float]:
        """The licence with the highest coefficient, if that reaches the threshold; of equal ones all."""
        return {name: dice for name, (dice, _) in self.matches(segment).items()}

    def _stretches(self, line: np.ndarray, which: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int]]:
        """First and last line of a text's stretches, from the line, number among the known and known or not of each bigram."""
        places, held = which[hit], line[hit]
        enough = np.flatnonzero(self.member[:, places].sum(1) >= self.needs)
        if not len(enough):
            return
        lines, at = np.unique(line, return_inverse=True)
        size, at = np.bincount(at), at[hit]
        for t in enough.tolist():
            hits = np.bincount(at[self.member[t, places]], minlength=len(lines))
            sums = np.append(0, np.cumsum(hits))
            for a, b in stretches((2 * hits - size).tolist()):
                if sums[b + 1] - sums[a] >= self.needs[t]:
                    yield int(lines[a]), int(lines[b])

    def segments(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, bytes]]:
        """Text, first line, first byte and bytes of the segments that can have a template."""
        for i, j in chunks(texts):
            buf, offsets = joined(texts[i:j])
            starts, grams = _grams(buf)
            at = np.minimum(np.searchsorted(self.known, grams), max(0, len(self.known) - 1))
            hit = self.known[at] == grams if len(self.known) else np.zeros(len(grams), bool)
            hits = np.append(0, np.cumsum(hit))
            ink = np.append(0, np.cumsum(~_GAP[buf]))
            ends = np.flatnonzero(buf == 10)
            begins = np.append(0, ends[:-1] + 1)
            doc = np.searchsorted(offsets, begins, "right") - 1
            first = np.searchsorted(begins, offsets[:-1])
            full = ink[ends] > ink[begins]
            opens = full & np.append(True, ~full[:-1] | (doc[1:] != doc[:-1]))
            closes = full & np.append(~full[1:] | (doc[1:] != doc[:-1]), True)
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            n_blocks = np.bincount(doc[a], minlength=len(offsets) - 1)
            several, many = a < b, np.flatnonzero(n_blocks > 1)
            tops = np.concatenate([np.flatnonzero(full), a[several], first[many]])
            spans = np.concatenate([begins[tops[: int(full.sum())]], begins[a[several]], offsets[many]])
            tails = np.concatenate([ends[full], ends[b[several]], offsets[many + 1] - 1])
            w0, w1 = np.searchsorted(starts, spans), np.searchsorted(starts, tails)
            inner = np.maximum(w1 - w0 - 1, 0)
            count = np.where(inner > 0, hits[np.maximum(w1 - 1, 0)] - hits[np.minimum(w0, len(hits) - 1)], 0)
            for k in np.flatnonzero(count >= self.need).tolist():
                s, e = int(spans[k]), int(tails[k])
                own = grams[w0[k] : max(int(w0[k]), int(w1[k]) - 1)]
                # Words with other letters fall apart here, so of these only the exact bigrams tell.
                if not (buf[s:e] & 0x80).any():
                    x, distinct = len(np.unique(own)) + 2, len(np.unique(own[hit[w0[k] : w0[k] + len(own)]])) + 2
                    if x > self.largest or distinct < x * self.least / (2 - self.least) - 1e-9:
                        continue
                d = int(doc[tops[k]])
                yield i + d, int(tops[k] - first[d]), s - int(offsets[d]), buf[s:e].tobytes()
            edges = np.searchsorted(starts, offsets)
            least = int(self.needs.min(initial=len(hits) + 1))
            lasts = np.maximum(edges[1:] - 1, edges[:-1])
            for d in np.flatnonzero(hits[np.minimum(lasts, len(hits) - 1)] - hits[np.minimum(edges[:-1], len(hits) - 1)] >= least).tolist():
                w = slice(int(edges[d]), int(lasts[d]))
                line = np.searchsorted(begins, starts[w], "right") - 1
                for p, q in set(self._stretches(line, at[w], hit[w])):
                    yield i + d, p - int(first[d]), int(begins[p] - offsets[d]), buf[begins[p] : ends[q]].tobytes()

    def scan(self, texts: list[bytes | None]) -> list[dict[str, tuple[float, int, int]]]:
        """For each text and licence found: best coefficient, first line of a segment that has it, number of such segments, which don't overlap."""
        found: dict[int, dict[tuple[int, int], tuple[float, int, dict[str, tuple[float, float]]]]] = {}
        for i, line, start, segment in self.segments(texts):
            span = (start, start + len(segment))
            if span not in found.get(i, ()) and (names := self.matches(segment.decode("utf-8", "replace"))):
                found.setdefault(i, {})[span] = (max(w for _, w in names.values()), line, names)
        out: list[dict[str, tuple[float, int, int]]] = [{} for _ in texts]
        for i, spans in found.items():
            kept: list[tuple[int, int]] = []
            for s, e in sorted(spans, key=lambda x: (-spans[x][0], x[1] - x[0], x)):
                k = bisect_left(kept, (s, e))
                if k and kept[k - 1][1] > s or k < len(kept) and kept[k][0] < e:
                    continue
                insort(kept, (s, e))
                _, line, names = spans[s, e]
                for name, (dice, _) in names.items():
                    was = out[i].get(name, (0.0, line, 0))
                    out[i][name] = (max(dice, was[0]), min(line, was[1]), was[2] + 1)
        return out


def _scan(templates: Mapping[str, tuple[str, ...]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in batches:
            found = known.scan(texts_of(batch, "_text"))
            rows = [(i, name, *x) for i, own in zip(column(batch, "_id"), found, strict=True) for name, x in sorted(own.items())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["_id", "license", "dice", "first_line", "n_segments"])

    return run


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """Licences noticed in each row's whole text: doc_id, license, dice (the best), first_line (from 0), n_segments.

    A row for each row of docs and licence; texts without one, null and empty ones give none. Ids may be null or
    repeat. n_segments counts segments that don't overlap. templates maps names to ASCII texts and goes to every task (the default: notices of one line, and the
    full texts of widespread licences, 140 kB). Licences that are variants of one another, as the MIT and similar
    ones, go by the closest one.
    """
    base = docs.select(id_key(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).cast("string").alias("_text"))
    out = base.mapInArrow(_scan(templates, least), "_id long, license string, dice double, first_line long, n_segments long")
    return out.select(given("_id").alias("doc_id"), "license", "dice", "first_line", "n_segments")
