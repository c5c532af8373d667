"""What the training-data operators share: shared-folder staging, words, hashes."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: A row without doc_id counts as a document whose id is above all others.
NO_ID = 2**63 - 1
#: Bytes of text that a task turns into arrays at once.
CHUNK = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROOT = 0x9E3779B97F4A7C15 | 1


class _Own(threading.local):
    """What a thread has staged: calls side by side in one session know nothing of each other's tables."""

    def __init__(self):
        self.paths: list[str] = []


_staged = _Own()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Survives lost executors, as the files are in shared storage. They stay until clear_staged(), which is for
    when the results that read them have been written.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """stage() what make gives, and delete the tables that were staged on the way: nothing reads them any more."""
    before = len(_staged.paths)
    out = stage(make(), label)
    _delete(spark, _staged.paths[before:-1])
    del _staged.paths[before:-1]
    released(spark)
    return out


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done: it does so when their handles are collected on the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_staged(spark: SparkSession) -> int:
    """Delete what this thread has staged; returns how many tables that were."""
    n = len(_staged.paths)
    _delete(spark, _staged.paths)
    _staged.paths.clear()
    return n


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def given(name: str) -> Column:
    """The inverse of id_key for a column made with it."""
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name))


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns of df that an operator passes on; columns named like its results are replaced."""
    low = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in low]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses, n of each at least."""
    if "p" not in _cache or len(_cache["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _cache["p"] = _powers(size, _ROOT)
        _cache["q"] = _powers(size, pow(_ROOT, -1, 2**64))
    return _cache["p"][:n], _cache["q"][:n]


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[s:e] for each pair, equal for equal runs wherever they stand."""
    p, q = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a UTF-8 buffer."""
    gap = np.empty(len(buf) + 2, bool)
    gap[0] = gap[-1] = True
    np.take(_GAP, buf, out=gap[1:-1])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a buffer, taken in pieces of bounded size."""
    starts, ends = word_spans(buf)
    if len(buf) <= 4 * CHUNK:
        return starts, ends, range_hash(_BYTE[buf], starts, ends)
    hashes, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 4 * CHUNK, "right")))
        a, b = starts[i], ends[j - 1]
        hashes[i:j] = range_hash(_BYTE[buf[a:b]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return starts, ends, hashes


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z made lower-case, all other bytes as they are."""
    return _LOW[buf]


def chunks(texts: list[bytes | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about limit bytes together, one text at least."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j] or b"") <= limit):
            total += len(texts[j] or b"")
            j += 1
        yield i, j
        i = j


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by a line feed, and the start of each with the end of all."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=offsets[1:])
    return np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8), offsets


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()
