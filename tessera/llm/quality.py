"""Quality rules under weak supervision.

Rules vote for (1) or against (0) a document or abstain (-1). How often each pattern of votes occurs is counted
over all documents; expectation-maximisation over those counts estimates each rule's accuracy for good and for
bad documents and the share of good ones, without labels. A document is kept if its posterior probability of
being good is high enough. There are at most 3**rules patterns, so the counts are small whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, joined, mix64, others, quoted, stage, texts_of, word_hashes

SYMBOLS = b"#*$%&|<>"
#: Frequent function words of the languages served. Fixed values.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were "
    "de la le les des et en un une du que qui dans pour par sur au avec ce il est pas plus "
    "el los las del se y por con no para al lo como más su sus una "
    "der die das und zu den von mit ist des im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
).split()
COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stops n_upper n_letters n_marks n_lone longest_run n_distinct".split()


def _chars(buf: np.ndarray) -> np.ndarray:
    """True for the first byte of each code point."""
    return (buf & 0xC0) != 0x80


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!#*$%&|<>{}[]^~=_@")] = True


def _word_set(words: list[str]) -> np.ndarray:
    buf, _ = joined([w.encode() for w in words])
    return np.unique(word_hashes(buf)[2])


_STOPS = _word_set(STOP_WORDS)


def _dup_lines(text: bytes | None) -> int:
    lines = [x for x in (text or b"").split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts that rules use, for each text; a null text counts as empty."""
    buf, offsets = joined(texts)
    starts, ends, hashes = word_hashes(buf)
    first = _chars(buf)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(first, out=points[1:])
    doc = np.searchsorted(offsets, starts, "right") - 1
    n, n_docs = len(starts), len(texts)
    edges = np.searchsorted(doc, np.arange(n_docs + 1))
    out = {
        "n_words": np.diff(edges),
        "word_chars": np.bincount(doc, points[ends] - points[starts], n_docs).astype(np.int64),
        "n_symbols": _per_doc(_IS_SYMBOL[buf], offsets),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
    }
    covered = np.zeros(n + 2, bool)
    if n >= 3:
        a, b, c = hashes[:-2], hashes[1:-1], hashes[2:]
        own = doc[:-2] == doc[2:]
        grams = mix64(mix64(mix64(a) + b) + c + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(own)
        order = at[np.argsort(grams[at], kind="stable")]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = grams[order][1:] == grams[order][:-1]
        again = order[same[1:] | same[:-1]]
        for k in range(3):
            covered[again + k] = True
    count = lambda flags: np.bincount(doc[flags], minlength=n_docs).astype(np.int64)
    out["n_repeat_words"] = count(covered[:n])
    low = word_hashes(np.where(_IS_UPPER[buf], buf + 32, buf).astype(np.uint8))[2]
    out["n_stops"] = count(np.isin(low, _STOPS))
    out["n_upper"] = _per_doc(_IS_UPPER[buf], offsets)
    out["n_letters"] = _per_doc(_IS_LETTER[buf], offsets)
    marks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_IS_MARK[buf], out=marks[1:])
    bad = marks[ends] > marks[starts]
    out["n_marks"] = count(bad)
    out["n_lone"] = count(bad & (marks[ends] - marks[starts] == ends - starts))
    # The longest run of one word repeated.
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    begins = np.flatnonzero(~same)
    runs = np.diff(np.append(begins, n))
    out["longest_run"] = np.zeros(n_docs, np.int64)
    np.maximum.at(out["longest_run"], doc[begins], runs)
    order = np.lexsort((low, doc))
    new = np.ones(n, bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    out["n_distinct"] = np.bincount(doc[order][new], minlength=n_docs).astype(np.int64)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch, "_text")
        rest = [n for n in batch.schema.names if n != "_text"]
        for i, j in chunks(texts):
            made = measure(texts[i:j])
            cols = [batch.column(batch.schema.get_field_index(n)).slice(i, j - i) for n in rest]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(made[c], pa.int64()) for c in COUNTS]], [*rest, *COUNTS])


def counted(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep and the counts of every whole text."""
    rows = docs.select(*[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(quoted(text_col)).cast("string").alias("_text"))
    kept = [f"_k{i} {rows.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return rows.mapInArrow(_counts, ", ".join(kept + [f"{c} long" for c in COUNTS]))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(-1)).cast("byte")


def rules() -> dict[str, Column]:
    """The rules: each a vote of the counts."""
    words = F.col("n_words")
    share = lambda name: F.col(name) / F.greatest(words, F.lit(1))
    return {
        "repeats": _vote(share("n_repeat_words") < 0.3, share("n_repeat_words") > 0.5),
        "runs": _vote(F.col("longest_run") <= 3, F.col("longest_run") >= 8),
        "marks": _vote(share("n_marks") < 0.05, share("n_marks") > 0.2),
        "symbols": _vote(share("n_symbols") < 0.05, share("n_symbols") > 0.2),
        "upper": _vote(F.col("n_upper") < 0.2 * F.col("n_letters"), F.col("n_upper") > 0.5 * F.col("n_letters")),
        "stops": _vote(share("n_stops") > 0.12, (share("n_stops") < 0.04) & (words >= 20)),
        "length": _vote(words >= 80, words < 20),
        "word_size": _vote((share("word_chars") > 2.5) & (share("word_chars") < 9), (share("word_chars") > 14) | (share("word_chars") < 1.5)),
        "lines": _vote(share("n_dup_lines") < 0.02, share("n_dup_lines") > 0.1),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = 0.9, trust: float = 20.0) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of good documents and, for each rule, the probabilities of a vote for and against given
    that it votes: shape (rules, 2 classes bad and good, 2 votes). trust is the weight in documents of the
    starting belief that rules are right more often than not; it settles which class is the good one.
    """
    if not patterns:
        return prior, np.zeros((0, 2, 2))
    votes = np.array([p for p, _ in patterns], np.int8)
    weight = np.array([c for _, c in patterns], float)
    start = np.array([[0.8, 0.2], [0.1, 0.9]])  # class bad, good; vote against, for
    table, good = np.repeat(start[None], votes.shape[1], 0), prior
    for _ in range(rounds):
        post = posterior(votes, good, table)
        mass = np.stack([(1 - post) * weight, post * weight])
        new = np.stack([[[(m * (votes[:, r] == v)).sum() for v in (0, 1)] for m in mass] for r in range(votes.shape[1])]) + trust * start
        new /= new.sum(2, keepdims=True)
        share = (mass[1].sum() + trust * prior) / (weight.sum() + trust)
        done = abs(share - good) + np.abs(new - table).max() < 1e-10
        table, good = new, share
        if done:
            break
    return float(good), table


def posterior(votes: np.ndarray, good: float, table: np.ndarray) -> np.ndarray:
    """Probability of the good class for rows of votes; abstentions say nothing."""
    odds = np.full(len(votes), np.log(good) - np.log1p(-good))
    for r in range(votes.shape[1]):
        step = np.log(table[r, 1]) - np.log(table[r, 0])
        odds += np.where(votes[:, r] < 0, 0.0, step[np.maximum(votes[:, r], 0)])
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judged(counts: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds base_failed, good_probability and kept to a frame with the counts; counts is read twice and should be staged."""
    named = rules()
    voted = counts.withColumn("_votes", F.concat_ws(",", *[v.cast("string") for v in named.values()]))
    # At most 3**rules rows reach the driver.
    found = sorted((tuple(map(int, r._votes.split(","))), r.n) for r in voted.groupBy("_votes").agg(F.count("*").alias("n")).collect())
    good, table = fit(found)
    post = posterior(np.array([p for p, _ in found], np.int8), good, table) if found else []
    rows = [(",".join(map(str, p)), float(q)) for (p, _), q in zip(found, post, strict=True)]
    scored = counts.sparkSession.createDataFrame(rows, "_votes string, good_probability double")
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    out = voted.join(F.broadcast(scored), "_votes", "left").drop("_votes").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("good_probability", F.lit(0.0)) >= F.lit(float(least))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Counts and verdict of every row: doc_id, the counts, base_failed, good_probability, kept.

    Each row is judged by its own whole text; ids may be null or repeat. A null or empty text has no words and
    fails the base rule. An empty table gives an empty result.
    """
    counts = stage(counted(docs, text_col, (id_col,)).withColumnRenamed("_k0", "doc_id"), "quality")
    return judged(counts, least)


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that are judged good, with the columns they came with."""
    names = others(docs)
    rows = stage(counted(docs, text_col, tuple(names)), "quality")
    good = judged(rows, least).where("kept")
    return good.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)])
