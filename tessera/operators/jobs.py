"""Job and link queues: states folded from events, claims, retries, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.media import backoff_seconds

# Stages of a job and its checkpoints.
STAGES = ("assemble", "thumbnail", "ai_enrichment")
CHECKPOINTS = ("faces", "clip", "tags", "poses")


def folded(events: DataFrame, job: str, required: tuple[str, ...]) -> DataFrame:
    """State of each job from its checkpoint events: once done stays done, and a job is completed when all required ones are.

    events: job and a boolean for each checkpoint.
    """
    done = events.groupBy(job).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in CHECKPOINTS])
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c)
    return done.withColumn("status", F.when(complete, "completed").otherwise("pending")).withColumn("current_stage", F.when(complete, "completed").otherwise("ai_enrichment"))


def reclaimed(jobs: DataFrame, now: Column, minutes: int = 15, most: int = 3) -> DataFrame:
    """Processing jobs that stalled go back to pending, or fail once they were tried often enough."""
    stalled = (F.col("status") == "processing") & (F.col("updated_at") < now - F.make_interval(mins=F.lit(minutes)))
    return jobs.withColumn("status", F.when(stalled, F.when(F.col("attempts") >= most, "failed").otherwise("pending")).otherwise(F.col("status")))


def claimable(jobs: DataFrame, stage: str, most: int = 3) -> DataFrame:
    """Pending jobs of a stage; an unknown stage has none."""
    if stage not in STAGES:
        return jobs.where(F.lit(False))
    return jobs.where((F.col("status") == "pending") & (F.col("current_stage") == stage) & (F.col("attempts") < most))


def claimed(ready: DataFrame, n: int, order: str = "created_at", id_: str = "id") -> DataFrame:
    """The n oldest, one attempt up and processing. A single writer claims, so rows need no locks."""
    return ready.orderBy(order, id_).limit(n).withColumn("attempts", F.col("attempts") + 1).withColumn("status", F.lit("processing"))


def batch_committed(jobs: DataFrame, batch_id: str, payload: str = "payload") -> DataFrame:
    """Staged jobs of a batch become pending together."""
    hit = (F.col("status") == "staged") & (F.get_json_object(payload, "$.batch_id") == batch_id)
    return jobs.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def links_enqueued(queue: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The link queue after links are given again: failed ones start anew, others stay as they are, unknown ones come in.

    Both have the keys, status and attempts; new has one row for each key.
    """
    asked = new.select(*keys).distinct().withColumn("_again", F.lit(True))
    out = queue.join(asked, keys, "left")
    reset = F.coalesce("_again", F.lit(False)) & (F.col("status") == "failed")
    out = out.withColumn("attempts", F.when(reset, 0).otherwise(F.col("attempts"))).withColumn("status", F.when(reset, "pending").otherwise(F.col("status"))).drop("_again")
    return out.unionByName(new.join(queue.select(*keys), keys, "left_anti"))


def links_ready(queue: DataFrame, now: Column) -> DataFrame:
    return queue.where(F.col("status").isin("pending", "rate_limited") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))


def retried(queue: DataFrame, message: Column, now: Column) -> DataFrame:
    """Links after a failed attempt: failed at the limit of attempts, else waiting; the wait is without jitter."""
    limited, wait = backoff_seconds(message, F.col("attempts"))
    status = F.when(F.col("attempts") >= F.col("max_attempts"), "failed").when(limited, "rate_limited").otherwise("pending")
    return queue.withColumn("next_retry_at", now + F.make_interval(secs=wait)).withColumn("status", status)


def gate(events: DataFrame, partition: str, order: list[str]) -> DataFrame:
    """Whether work is paused after each event: batches opened (+1) and closed (-1) within each partition, as open and paused."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("open", F.greatest(F.sum("delta").over(w), F.lit(0)))
    return out.withColumn("paused", F.col("open") > 0)


def status_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "skipped", "error")])


def duplicates(assets: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of rows with equal content: keys, n, first_id, whether all are in the trash, and what an upload is told."""
    out = assets.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.bool_and(F.col("deleted_at").isNotNull()).alias("in_trash"))
    message = F.when(F.col("in_trash"), "Already exists in trash").otherwise("Already exists in library")
    return out.where("n > 1").withColumn("message", message)
