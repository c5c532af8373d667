"""Removal of word passages that repeat anywhere, located with Aho-Corasick automata.

1. Passages that recur are confirmed: a task counts the windows of the fragments that share an anchor (passages.py
   says what these are), each weighted with its copies, and joins consecutive recurring ones to passages.
2. The passages are dealt to shards by anchor, and each shard is compiled into an automaton over word numbers.
3. All documents stream through the automata: what stands at every place of every document where the anchor of a passage
   is found is sent to that anchor's shard, so a document meets only the shards that can hold a passage of it. Places
   with the same words are one fragment, which streams once, and what is found in it holds for all its places. What
   the automata report is what goes; the counts of the first step only say which passages they are made of.

A shard through which much streams is compiled in several tasks, which share that out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, others, quoted, settled, stage, texts_of
from tessera.llm.passages import Repeats, Unit, grouped, keyed, merged, row_tuples, rows_batch

#: Words of the passages compiled into one automaton, about: it takes some 60 bytes for each.
SHARD_WORDS = 100_000
#: Words that one task streams through an automaton, about.
STREAM_WORDS = 1_000_000


def recurring(group: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """For fragments of one anchor, (anchor, f, copies, offset, windows, bytes) each, offsets of the anchor in windows that occur twice or more, copies counted."""
    counts: dict[tuple[bytes, ...], int] = {}
    keys = []
    for x in group:
        if len(group) == 1:
            if x[2] > 1:
                yield x[0], x[1], x[3] - x[4] + 1, x[3]
            return
        w = x[5].split(b" ")
        own = [tuple(w[i : i + window]) for i in range(x[4])]
        keys.append(own)
        for key in own:
            counts[key] = counts.get(key, 0) + x[2]
    for x, own in zip(group, keys, strict=True):
        begin = None
        for i, key in enumerate([*own, None]):
            if key is not None and counts[key] > 1:
                begin = i if begin is None else begin
            elif begin is not None:
                yield x[0], x[1], x[3] - (i - 1), x[3] - begin
                begin = None


def _solver(window: int):
    def solve(rows: Iterator[tuple]) -> Iterator[tuple[int, int, int, int]]:
        for group in grouped(rows):
            yield from recurring(group, window)

    return solve


def _passages(unit: Unit):
    """Of fragments with their recurring offsets, the passages: consecutive recurring windows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, words = [], []
            for anchor, off, data, ranges in zip(*(column(batch, n) for n in ("_anchor", "_off", "_bytes", "_ranges")), strict=True):
                spans = unit.spans(data)
                # Windows i to j - 1 of the fragment, as runs of neighbours.
                for i, j in merged([{"s": off - r["_o2"], "e": off - r["_o1"] + 1} for r in ranges]):
                    out.append((anchor, unit.cut(data, spans, i, j - 1 + unit.window)))
                    words.append(j - i - 1 + unit.window)
            made = rows_batch(out, ["_anchor", "_bytes"])
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(words, pa.int64())], ["_anchor", "_bytes", "_words"])

    return run


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard, its passages first: compile these, then stream the others and report where in them passages stand."""
    import ahocorasick

    key, passage, numbers, automaton, out = None, True, {}, None, []
    for shard, salt, streamed, anchor, f, data in row_tuples(batches):
        if (shard, salt) != key:
            key, passage, numbers = (shard, salt), True, {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        if not streamed:
            automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in data.split(b" ")]))
            continue
        if passage:
            passage = False
            automaton.make_automaton()
        hits = automaton.iter(tuple([numbers.get(w, 0) for w in data.split(b" ")])) if len(automaton) else ()
        out.extend((anchor, f, s, e) for s, e in merged([{"s": end + 1 - size, "e": end + 1} for end, size in hits]))
        if len(out) >= 20_000:
            yield rows_batch(out, ["_anchor", "_f", "s", "e"])
            out = []
    yield rows_batch(out, ["_anchor", "_f", "s", "e"])


def located(repeats: Repeats, window: int) -> DataFrame:
    """For documents with recurring passages: _id, _th and _runs, the runs of words that automata found, unsorted and overlapping."""
    spark, parts = repeats.base.sparkSession, repeats.parts()

    def confirmed() -> DataFrame:
        cut = parts.join(repeats.ranges(parts, _solver(window)), ["_anchor", "_f"]).select("_anchor", "_off", "_bytes", "_ranges")
        return cut.mapInArrow(_passages(repeats.unit), "_anchor long, _bytes binary, _words long").distinct()

    passages = settled(spark, confirmed, "passages")
    shards = 1 + (passages.agg(F.sum("_words")).first()[0] or 0) // SHARD_WORDS
    shard = lambda a: F.pmod(F.xxhash64(a), F.lit(shards)).alias("_shard")
    held = parts.join(stage(passages.select("_anchor").distinct(), "found"), "_anchor", "left_semi")
    load = stage(held.groupBy(shard("_anchor")).agg(F.ceil(F.sum(F.col("_wins") - 1 + F.lit(window)) / STREAM_WORDS).cast("int").alias("_salts")), "shards")
    none = F.lit(0).cast("long")
    known = passages.select(shard("_anchor"), "_bytes").join(load, "_shard").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    known = known.select("_shard", "_salt", F.lit(False).alias("_streamed"), none.alias("_anchor"), none.alias("_f"), "_bytes")
    stream = held.select("_anchor", "_f", "_bytes", shard("_anchor")).join(load, "_shard")
    stream = stream.select("_shard", F.pmod(F.xxhash64("_anchor", "_f"), "_salts").alias("_salt"), F.lit(True).alias("_streamed"), "_anchor", "_f", "_bytes")
    rows = known.unionByName(stream).repartition("_shard", "_salt").sortWithinPartitions("_shard", "_salt", "_streamed")

    def reported() -> DataFrame:
        found = rows.mapInArrow(_locate, "_anchor long, _f long, s long, e long")
        return found.groupBy("_anchor", "_f").agg(F.collect_list(F.struct("s", "e")).alias("_found"))

    lo = F.shiftright("_at", 20)
    runs = F.transform("_found", lambda r: F.struct((lo + r["s"]).alias("s"), (lo + r["e"]).alias("e"))).alias("_runs")
    places = repeats.again.join(settled(spark, reported, "reported"), ["_anchor", "_f"]).select("_id", "_th", runs)
    return places.groupBy("_id", "_th").agg(F.flatten(F.collect_set("_runs")).alias("_runs"))


def _remove(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed = [], [], []
            for text, runs in zip(texts_of(batch, "_text"), column(batch, "_runs"), strict=True):
                words, gone = (text or b"").split(), merged(runs)
                out, at = [], 0
                for s, e in gone:
                    out.extend(words[at:s])
                    at = e
                out.extend(words[at:])
                kept.append(b" ".join(out))
                sizes.append(len(words))
                removed.append(len(words) - len(out))
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            cols += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "kept", "n_words", "n_removed"])

    return run


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, anchor: int = 6) -> DataFrame:
    """Remove every word covered by window consecutive words of a document that also start anywhere else.

    Words are runs without ASCII white space, compared unchanged (null: none); windows are judged on the input.
    Returns the columns of docs without the text, and kept (remaining words joined by one space), n_words and
    n_removed; columns of those names are replaced. Ids may be null or repeat: rows equal in id and text are
    copies like any others and lose what they share. An empty table gives an empty result.
    """
    unit = Unit("words", window, anchor)
    runs = settled(docs.sparkSession, lambda: located(Repeats(keyed(docs, id_col, text_col), unit), window), "phrases")
    names = [c for c in others(docs, "kept", "n_words", "n_removed") if c != text_col]
    rows = keyed(docs, id_col, text_col, *[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(names)])
    held = [f"_c{i}" for i in range(len(names))]
    fields = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in held] + ["kept string, n_words long, n_removed long"])
    out = rows.join(runs, ["_id", "_th"], "left").mapInArrow(_remove(held), fields)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "kept", "n_words", "n_removed")
