"""Queues and event streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.jobs import CHECKPOINTS


def event_stream(spark: SparkSession, path: str, schema: str | StructType, max_files: int | None = None) -> DataFrame:
    """A directory of parquet files as a stream; max_files a micro-batch is the back-pressure."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def timed(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """With a watermark; timestamps without zone are taken as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark, with state that expires."""
    return timed(events, ts, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, width: str, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Tumbling counts of each key."""
    return timed(events, ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, gap: str, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sessions of each key that end after a gap."""
    groups = timed(events, ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return groups.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def job_states(events: DataFrame, job: str, required: tuple[str, ...]) -> DataFrame:
    """State of each job as checkpoint events come in, an update for each micro-batch that has some: job, checkpoints, status.

    The state of a job is its checkpoints' flags; a flag once set stays set. They are a streaming aggregate, so a batch's
    events of a job are merged before they are shuffled, and no row goes to Python.
    """
    flags = events.groupBy(job).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in CHECKPOINTS])
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c)
    return flags.select(job, *CHECKPOINTS, F.when(complete, "completed").otherwise("pending").alias("status"))


def as_messages(events: DataFrame, kind: str) -> DataFrame:
    """Events as JSON messages with a kind, for a message sink."""
    return events.select(F.to_json(F.struct(F.lit(kind).alias("type"), *events.columns)).alias("value"))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there in micro-batches, then stop; each batch goes to a function that writes its tables."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def appending(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends all that is there to a parquet directory."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append all that is there to a parquet directory and return what it holds."""
    appending(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
