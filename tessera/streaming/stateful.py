"""Keyed state over micro-batches: a queue of links with timers, and people known by exemplars of their faces."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries with processors are to be started in this: their state store is one that holds more than memory does."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


# --- links ---


@dataclass
class Link:
    """One link of the queue. due: when what waits is released, or what is worked on counts as stalled; None if neither."""

    status: str = "unknown"
    attempts: int = 0
    due: int | None = None
    waits: bool = False

    def timed(self, until: int, stall: int, most: int) -> Iterator[tuple[int, str]]:
        """What time alone has changed by then: a wait is over, or work has stalled and is given back or given up."""
        while self.due is not None and self.due <= until:
            at = self.due
            self.due = None
            if self.waits:
                self.waits = False
                yield at, "released"
            elif self.attempts >= most:
                self.status = "failed"
                yield at, "stalled"
            else:
                self.status = "pending"
                yield at, "requeued"

    def told(self, at: int, kind: str, limited: bool, stall: int, most: int) -> str | None:
        """What an event changes, if anything."""
        if kind == "enqueue" and self.status in ("unknown", "failed"):
            self.status, self.attempts, self.due, self.waits = "pending", 0, None, False
            return "enqueued"
        if kind == "claim" and self.status in ("pending", "rate_limited") and not self.waits:
            self.status, self.attempts, self.due = "processing", self.attempts + 1, at + stall
            return "claimed"
        if self.status != "processing":
            return None
        if kind == "beat":
            self.due = at + stall
            return None
        if kind == "done":
            self.status, self.due = "completed", None
            return "completed"
        if kind != "error":
            return None
        if self.attempts >= most:
            self.status, self.due = "failed", None
            return "failed"
        wait = 180 * 2 ** min(max(self.attempts, 1) - 1, 3) if limited else 35
        self.status, self.due, self.waits = "rate_limited" if limited else "pending", at + 1000 * wait, True
        return "delayed"


class LinkQueue(StatefulProcessor):
    """Enqueue, claim, heartbeat, completion and error of links, with retries released when due and stalled work reclaimed.

    A key is a share of the links: a call of Python and of the state store costs far more than a link does, so there are
    a few of them for a share and none for a link. What a share holds are columns: one row of its links, one of each lot of events.

    Event time: events are held until the watermark has passed them, and applied in the order of time and id, so neither
    their order of arrival nor the batches matter; a repeated event (one id and time) counts once. Timed changes bear
    the time at which they were due. Processing time: an event is applied when it comes, at the clock's time.
    """

    def __init__(self, event_time: bool = True, stall_ms: int = 15 * 60_000, most: int = 3):
        self.event_time, self.stall, self.most = event_time, stall_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.links = handle.getValueState("links", "link array<string>, status array<string>, attempts array<int>, due array<long>, waits array<boolean>")
        self.held = handle.getListState("held", "at array<long>, id array<long>, kind array<string>, limited array<boolean>, link array<string>")
        self.passed: set[tuple] = set()

    def _run(self, events: Iterable[tuple], until: int, later: Iterable[tuple] = ()) -> Iterator[pd.DataFrame]:
        """Apply events in order and what time alone changes by then; the next timer is for what is due first."""
        links = {link: Link(*own) for link, *own in zip(*self.links.get(), strict=True)} if self.links.exists() else {}
        out, last = [], {}
        for at, id_, kind, limited, link in events:
            if last.get(link) == (at, id_):
                continue
            last[link] = at, id_
            own = links.setdefault(link, Link())
            out += [(link, due, change, own.status, own.attempts) for due, change in own.timed(at, self.stall, self.most)]
            if change := own.told(at, kind, limited, self.stall, self.most):
                out.append((link, at, change, own.status, own.attempts))
        for link, own in links.items():
            out += [(link, due, change, own.status, own.attempts) for due, change in own.timed(until, self.stall, self.most)]
        known = [(link, x.status, x.attempts, x.due, x.waits) for link, x in links.items() if x.status != "unknown"]
        if known and (last or out):
            self.links.update(tuple(map(list, zip(*known, strict=True))))
        waiting = [x.due for x in links.values() if x.due is not None] + [e[0] for e in later]
        if waiting:
            self.handle.registerTimer(min(waiting))
        if out:
            yield pd.DataFrame(out, columns=["link", "at", "change", "status", "attempts"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lots = [pdf.loc[pdf["link"].notna(), ["at", "id", "kind", "limited", "link"]] for pdf in rows]
        lots = [pdf for pdf in lots if len(pdf)]
        if not lots:
            return
        if not self.event_time:
            now = timerValues.getCurrentProcessingTimeInMs()
            new = sorted(e for pdf in lots for e in pdf.itertuples(index=False, name=None))
            yield from self._run([(now, *e[1:]) for e in new], now)
            return
        self.held.appendList([tuple(pdf[c].tolist() for c in pdf) for pdf in lots])
        self.handle.registerTimer(min(int(pdf["at"].min()) for pdf in lots))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Of a share's timers that expire in one batch the first does it all.
        if key in self.passed:
            return
        self.passed.add(key)
        if not self.event_time:
            yield from self._run([], timerValues.getCurrentProcessingTimeInMs())
            return
        until = timerValues.getCurrentWatermarkInMs()
        held = sorted(e for lot in self.held.get() for e in zip(*lot, strict=True))
        n = bisect_right(held, until, key=itemgetter(0))
        ready, later = held[:n], held[n:]
        if ready:
            self.held.put([tuple(map(list, zip(*later, strict=True)))]) if later else self.held.clear()
        yield from self._run(ready, until, later)

    def close(self) -> None:
        pass


def link_changes(
    events: DataFrame, link: str, event_time: bool = True, delay: str = "1 hour", stall_minutes: int = 15, most: int = 3, shares: int = 1024
) -> DataFrame:
    """What happens to each link: link, at, change, status, attempts. Start it in keyed_state().

    events: the link, ts, id, kind (enqueue, claim, beat, done, error) and message. A link that is enqueued again stays as it is
    unless it failed; a claim takes what is pending and doesn't wait; an error waits 35 s, or as a rate limit 180 s doubling
    up to 8 times, and fails at the limit of attempts, as does work without heartbeat for so many minutes.
    In event time, events later than the watermark are left out, and the last ones come when it has passed them.
    The links are dealt to so many shares by hash; a task takes one share at a time into memory, its links and the events
    that it holds. The number belongs to the checkpoint: a query that goes on must have the one that it began with.
    """
    ts = F.col("ts").cast("timestamp")
    limited = F.coalesce(F.lower("message").rlike("429|feedback_required|checkpoint|rate limit"), F.lit(False))
    rows = events.withColumn("ts", ts)
    if event_time:
        rows = rows.withWatermark("ts", delay)
    kind = events.schema[link].dataType.simpleString()
    # Links go to Python as text and numbers without nulls, which pandas would turn into floats.
    text = (F.base64(link) if kind == "binary" else F.col(link).cast("string"), lambda c: F.unbase64(c) if kind == "binary" else c.cast(kind))
    id_ = F.col("id").cast("long")
    whole = F.col(link).isNotNull() & F.col("ts").isNotNull() & id_.isNotNull()
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    # Rows without link, time or id go in the processor: a filter would be moved ahead of the watermark, which a closing row is to advance.
    own = [F.when(whole, text[0]).alias("link"), "ts", number(F.unix_millis("ts")).alias("at"), number(id_).alias("id"), F.coalesce("kind", F.lit("")).alias("kind")]
    rows = rows.select(*own, limited.alias("limited"))
    share = F.pmod(F.xxhash64("link", F.when(F.col("link").isNull(), F.col("id"))), F.lit(shares)).cast("int")
    processor = LinkQueue(event_time, stall_minutes * 60_000, most)
    dealt = rows.withColumn("share", share).groupBy("share")
    changes = dealt.transformWithStateInPandas(processor, "link string, at long, change string, status string, attempts int", "append", "eventtime" if event_time else "processingtime")
    return changes.select(text[1](F.col("link")).alias("link"), F.timestamp_millis("at").alias("at"), "change", "status", "attempts")


# --- people ---


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-6)


def matched(known: dict[int, list], faces: list[tuple[object, np.ndarray]], match: float, diverse: float, most: int, cached: int) -> Iterator[tuple]:
    """Faces of one image against known people: (face, person, similarity, whether the person is new).

    known: of each person the number of faces and the exemplars. A face is the person with the most similar exemplar, of
    those that no other face of the image is, if that is similar enough and the exemplars' centroid is nearly so; else
    a new one. While the image is looked at, a new view is an exemplar, up to most; what stays afterwards is, up to
    cached, the first face and then the centroid after each image.
    """
    floor = max(match - 0.05, 0.60)
    work = {p: (list(x), np.array(x)) for p, (_, x) in known.items()}
    changed: dict[int, np.ndarray] = {}
    claimed: set[int] = set()
    for face, v in faces:
        x, best, top = _unit(np.asarray(v, float)), None, -1.0
        for p, (_, m) in work.items():
            if p not in claimed and (s := float((m @ x).max())) > top:
                best, top = p, s
        if best is not None and top >= match and float(_unit(work[best][1].mean(0)) @ x) >= floor:
            own = work[best][0]
            if top < diverse and len(own) < most:
                own.append(x)
                work[best] = (own, np.array(own))
            known[best][0] += 1
            changed[best] = _unit(work[best][1].mean(0))
            claimed.add(best)
            yield face, best, top, False
        else:
            p = len(known)
            known[p] = [1, [x]]
            work[p] = ([x], x[None])
            claimed.add(p)
            yield face, p, 1.0, True
    for p, centroid in changed.items():
        if len(known[p][1]) < cached:
            known[p][1].append(centroid)


class People(StatefulProcessor):
    """The people of a user: for each the number of faces and a few exemplars, whatever the number of faces."""

    def __init__(self, match: float, diverse: float, most: int, cached: int):
        self.rule = match, diverse, most, cached

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.people = handle.getMapState("people", "person long", "faces long, exemplars array<array<double>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {int(p[0]): [int(v[0]), [np.array(x, float) for x in v[1]]] for p, v in self.people.iterator()}
        before = {p: (n, len(x)) for p, (n, x) in known.items()}
        out = []
        for image in pd.concat(list(rows)).sort_values("image").itertuples(index=False):
            ends = np.cumsum(image.sizes)
            faces = list(zip(image.faces, np.split(np.asarray(image.vectors, float), ends[:-1]), strict=True))
            out += [(*key, image.image, *found) for found in matched(known, faces, *self.rule)]
        for p, (n, x) in known.items():
            if before.get(p) != (n, len(x)):
                self.people.updateValue((p,), (n, [v.tolist() for v in x]))
        yield pd.DataFrame(out, columns=["user", "image", "face", "person", "similarity", "is_new"])

    def close(self) -> None:
        pass


def people_of_faces(images: DataFrame, user: str, image: str, faces: str, match: float = 0.72, diverse: float = 0.82, most: int = 16, cached: int = 5) -> DataFrame:
    """Who is on each image: user, image, face, person (from 0 for each user), similarity, is_new. Start it in keyed_state().

    images: the user, a number in whose order a user's images are taken, and the faces as an array of (face, vector). Images of
    one batch are put in order; batches are to come in order, and how images are dealt to them doesn't matter. Rows without user, image
    or faces are left out.
    """
    whole = images.where(F.col(user).isNotNull() & F.col(image).isNotNull() & (F.size(faces) > 0))
    # Faces go to Python as flat lists: lists of structs that hold lists end the workers on their way to pandas.
    vectors = F.transform(faces, lambda f: f["vector"].cast("array<double>"))
    own = {"faces": F.transform(faces, lambda f: f["face"].cast("long")), "sizes": F.transform(vectors, F.size), "vectors": F.flatten(vectors)}
    rows = whole.select(F.col(user).cast("long").alias("user"), F.col(image).cast("long").alias("image"), *[c.alias(n) for n, c in own.items()])
    out = "user long, image long, face long, person long, similarity double, is_new boolean"
    return rows.groupBy("user").transformWithStateInPandas(People(match, diverse, most, cached), out, "append", "none")


# --- running ---


def flushed(spark: SparkSession, start: Callable[[DataFrame], object], stream: DataFrame, closing: str, ts: str = "ts") -> None:
    """Run a stream on all that is there, then once more with a row far in the future, so that the watermark passes everything.

    start(stream) starts a query with a checkpoint of its own, available now, and gives it. closing is a folder for the last
    row; it has null in all columns but ts, and no filter before the watermark may drop it. What is flushed is closed:
    the query can't go on with further events.
    """
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(closing)
    last = spark.readStream.schema(stream.schema).parquet(closing)
    start(stream.unionByName(last)).awaitTermination()
    row = spark.range(1).select(*[(F.lit("2200-01-01").cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in stream.schema])
    row.write.mode("append").parquet(closing)
    start(stream.unionByName(last)).awaitTermination()
