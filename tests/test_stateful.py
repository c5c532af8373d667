"""Streams with state against plain loops over the same events, however they are dealt to batches."""

import os
import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.streaming import stateful

EVENTS = "link string, ts timestamp, id long, kind string, message string"
START = datetime(2024, 1, 1)


def written(spark, rows, schema, folder, parts):
    """rows in order in so many files, which are read in that order."""
    os.makedirs(folder)
    size = -(-len(rows) // parts)
    for i in range(parts):
        path = f"{folder}/{i}"
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(path)
        [name] = [x for x in os.listdir(path) if x.endswith(".parquet")]
        os.rename(f"{path}/{name}", f"{folder}/{i:03}.parquet")
        os.utime(f"{folder}/{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def run(spark, stream, at):
    """Append all results to a table."""
    with stateful.keyed_state(spark):
        return stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()


# --- links ---


def history(seed, links=12, n=260):
    """Events of links in order of time: work that stalls, errors, repeats."""
    rng = random.Random(seed)
    rows, t = [], START
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, 1, 20, 60, 300, 1000]))
        kind = rng.choices(["enqueue", "claim", "beat", "done", "error", "noise"], [4, 6, 2, 1, 4, 1])[0]
        rows.append((f"l{rng.randrange(links)}", t, i, kind, rng.choice(["HTTP 429", "Rate limit hit", "timeout", None]) if kind == "error" else None))
    return rows


def plain(rows, stall=15):
    """One event after the other, with all that is due before it."""
    out, state = [], {}
    say = lambda key, at, what: out.append((key, at, what, state[key]["s"], state[key]["a"]))

    def pass_time(key, until):
        st = state[key]
        if st["due"] is not None and st["due"] <= until:
            at, st["due"] = st["due"], None
            if st["wait"]:
                st["wait"] = False
                say(key, at, "released")
            else:
                st["s"] = "failed" if st["a"] >= 3 else "pending"
                say(key, at, "stalled" if st["a"] >= 3 else "requeued")

    for key, at, _, kind, message in sorted(set(rows), key=lambda r: (r[1], r[2])):
        st = state.setdefault(key, {"s": "unknown", "a": 0, "due": None, "wait": False})
        pass_time(key, at)
        if kind == "enqueue" and st["s"] in ("unknown", "failed"):
            st.update(s="pending", a=0, due=None, wait=False)
            say(key, at, "enqueued")
        elif kind == "claim" and st["s"] in ("pending", "rate_limited") and not st["wait"]:
            st.update(s="processing", a=st["a"] + 1, due=at + timedelta(minutes=stall))
            say(key, at, "claimed")
        elif st["s"] == "processing" and kind == "beat":
            st["due"] = at + timedelta(minutes=stall)
        elif st["s"] == "processing" and kind == "done":
            st.update(s="completed", due=None)
            say(key, at, "completed")
        elif st["s"] == "processing" and kind == "error" and st["a"] >= 3:
            st.update(s="failed", due=None)
            say(key, at, "failed")
        elif st["s"] == "processing" and kind == "error":
            limited = "429" in (message or "") or "rate limit" in (message or "").lower()
            st.update(s="rate_limited" if limited else "pending", due=at + timedelta(seconds=180 * 2 ** (st["a"] - 1) if limited else 35), wait=True)
            say(key, at, "delayed")
    for key in state:
        pass_time(key, datetime(9999, 1, 1))
    return sorted(out)


def naive(t):
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


@pytest.mark.parametrize("parts,shuffled", [(1, True), (4, True)])
def test_links_however_dealt(spark, tmp_path, parts, shuffled):
    """Out of order within the delay, and a fifth of the events repeated: the changes are those of the plain loop."""
    rng = random.Random(parts)
    rows = history(7)
    given = rows + rng.sample(rows, len(rows) // 5)
    given.sort(key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, 3000) if shuffled else 0))
    utc = [(r[0], r[1].replace(tzinfo=timezone.utc), *r[2:]) for r in given]
    stream = written(spark, utc, EVENTS, f"{tmp_path}/in", parts)
    start = lambda s: run(spark, stateful.link_changes(s, "link"), tmp_path)
    stateful.flushed(spark, start, stream, f"{tmp_path}/closing")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")).collect()]
    want = [(k, at.strftime("%Y-%m-%d %H:%M:%S"), *rest) for k, at, *rest in plain(rows)]
    assert sorted(got) == sorted(want)
    assert {r[2] for r in want} == {"enqueued", "claimed", "delayed", "released", "requeued", "stalled", "failed", "completed"} or len({r[2] for r in want}) >= 7


def test_links_are_released_by_the_clock(spark, tmp_path):
    """In processing time a stalled link is given back without any further event."""
    rows = [("a", START, 1, "enqueue", None), ("a", START, 2, "claim", None), ("b", START, 3, "enqueue", None), ("b", START, 4, "enqueue", None)]
    stream = written(spark, rows, EVENTS, f"{tmp_path}/in", 1)
    changes = stateful.link_changes(stream, "link", event_time=False, stall_minutes=0)
    with stateful.keyed_state(spark):
        query = changes.writeStream.format("memory").queryName("links").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and "requeued" not in {r.change for r in spark.table("links").collect()}:
            time.sleep(1)
        got = sorted((r.link, r.change, r.status, r.attempts) for r in spark.table("links").collect())
        assert got == [("a", "claimed", "processing", 1), ("a", "enqueued", "pending", 0), ("a", "requeued", "pending", 1), ("b", "enqueued", "pending", 0)]
    finally:
        query.stop()


# --- people ---

IMAGES = "user long, image long, faces array<struct<face: long, vector: array<double>>>"


def albums(seed=3, users=3, images=30):
    """Faces of a few people from several sides, one to three on an image."""
    rng = np.random.default_rng(seed)
    rows = []
    people = rng.standard_normal((5, 12))
    for i in range(images * users):
        some = rng.choice(5, rng.integers(1, 4), replace=False)
        faces = [(10 * i + k, (people[p] + rng.uniform(0.2, 0.9) * rng.standard_normal(12)).tolist()) for k, p in enumerate(some)]
        rows.append((i % users, i, faces))
    return rows


def loop(rows, match=0.72, diverse=0.82, most=16, cached=5):
    unit = lambda v: v / max(np.linalg.norm(v), 1e-6)
    users, out = {}, []
    for user, image, faces in sorted(rows, key=lambda r: r[1]):
        cache = users.setdefault(user, [])
        work = [list(e) for e in cache]
        taken, fresh = set(), set()
        for face, v in faces:
            x = unit(np.array(v))
            sims = [(max(float(e @ x) for e in own), -p) for p, own in enumerate(work) if p not in taken]
            top, p = max(sims) if sims else (-1, 0)
            p = -p
            if sims and top >= match and float(unit(np.mean(work[p], 0)) @ x) >= max(match - 0.05, 0.6):
                if top < diverse and len(work[p]) < most:
                    work[p].append(x)
                out.append((user, image, face, p, top, False))
            else:
                p = len(work)
                work.append([x])
                cache.append([x])
                fresh.add(p)
                out.append((user, image, face, p, 1.0, True))
            taken.add(p)
        for p in taken - fresh:
            if len(cache[p]) < cached:
                cache[p].append(unit(np.mean(work[p], 0)))
    return sorted(out), users


@pytest.mark.parametrize("parts", [1, 5])
def test_people_however_dealt(spark, tmp_path, parts):
    rows = albums()
    want, users = loop(rows)
    rng = random.Random(1)
    size = -(-len(rows) // parts)
    dealt = [r for i in range(0, len(rows), size) for r in rng.sample(rows[i : i + size], len(rows[i : i + size]))]
    stream = written(spark, dealt, IMAGES, f"{tmp_path}/in", parts)
    run(spark, stateful.people_of_faces(stream, "user", "image", "faces"), tmp_path).awaitTermination()
    got = sorted((r.user, r.image, r.face, r.person, r.similarity, r.is_new) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want]) and any(len(c) == 5 for u in users.values() for c in u)
    with stateful.keyed_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "people").load(f"{tmp_path}/state")
        kept = {(r.key.user, r.user_map_key.person): (r.user_map_value.faces, len(r.user_map_value.exemplars)) for r in state.collect()}
    assert {k: n for k, (_, n) in kept.items()} == {(u, p): len(c) for u, cache in users.items() for p, c in enumerate(cache)}
    assert max(n for _, n in kept.values()) == 5 and sum(n for n, _ in kept.values()) == len(got)


def test_people_after_a_restart(spark, tmp_path):
    """The second half is read by a query that begins at the first one's checkpoint."""
    rows = albums(8)
    half = len(rows) // 2
    schema = spark.createDataFrame([], IMAGES).schema
    os.makedirs(f"{tmp_path}/in")
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run(spark, stateful.people_of_faces(stream, "user", "image", "faces"), tmp_path).awaitTermination()
        got = sorted((r.user, r.image, r.face, r.person) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert got == [w[:4] for w in loop(rows[: half if i == 0 else len(rows)])[0]]


def test_queries_against_loops(spark):
    """The registered streams on the given tables."""
    from tessera.plans import ingest

    sf = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long")).collect():
        rows.append((f"{r.user_id}/{r.k // 10}", r.ts.replace(microsecond=r.ts.microsecond // 1000 * 1000), r.event_id, ingest.LINK_EVENTS[r.event_type], "HTTP 429" if r.event_id % 2 == 0 else "timeout"))
    got = spark.read.parquet(*ingest.stream_links(spark, sf).inputFiles()).withColumn("at", F.col("at").cast("timestamp_ntz")).collect()
    assert sorted(map(tuple, got)) == plain(rows, 2880) and len({r.change for r in got}) >= 5
    images = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        images.setdefault(r.vec_id // 3, []).append((r.vec_id, list(r.embedding)))
    want, _ = loop([(i // 200, i, faces) for i, faces in images.items()], 0.3, 0.5)
    got = sorted((r.user, r.image, r.face, r.person) for r in ingest.stream_people(spark, sf).collect())
    assert got == [w[:4] for w in want] and len({w[3] for w in want}) > 5
