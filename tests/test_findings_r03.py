"""Cases of the third round's findings."""

from datetime import timezone

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_stateful import history, naive, plain, run, written

from tessera.llm import graph
from tessera.operators import text_index
from tessera.plans import ingest, scalars, views
from tessera.streaming import queues, stateful


def test_assets_that_are_not_listed_keep_their_positions(spark, tmp_path):
    """Album 37 has assets up to 15,000, which are turned, and greater ones, which aren't."""
    keys = [3, 9, 14_999, 15_000, 15_001, 20_000, 90_000]
    rows = [(k, 37) for k in keys] + [(k + 1, 38) for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(tuple(r) for r in ingest.reorder_positions(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ingest.ORACLE_SQL["reorder_positions"]).fetchall())
    assert [p for a, _, p in got if a == 37] == [6, 5, 4, 3, 4, 5, 6]


def test_faces_go_to_python_as_flat_lists(spark, tmp_path):
    """Lists of structs with lists in them crashed the workers at some sizes: 4 users, 200 images each, three faces of 64 numbers."""
    rng = np.random.default_rng(5)
    rows = [(i % 4, i, [(3 * i + k, rng.standard_normal(64).tolist()) for k in range(3)]) for i in range(800)]
    schema = "user long, image long, faces array<struct<face: long, vector: array<double>>>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    images = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    with stateful.keyed_state(spark):
        found = stateful.people_of_faces(images, "user", "image", "faces", match=0.3)
        given = found._jdf.queryExecution().analyzed().children().apply(0).schema().catalogString()
        assert "array<struct" not in given and "array<array" not in given
        got = queues.to_table(found, f"{tmp_path}/out", f"{tmp_path}/state").select("user", "image", "face").collect()
    assert sorted(map(tuple, got)) == sorted((u, i, f) for u, i, faces in rows for f, _ in faces)


def test_postings_are_made_in_pieces_of_bounded_words():
    """A batch of many long documents: no array is longer than a piece or the longest document, and the postings are those of the whole."""
    rng = np.random.default_rng(2)
    texts = [[f"w{x}" for x in rng.integers(0, 50, n)] for n in (0, 70_000, 3, 0, 90_000, 200_000, 5, 60_000, 60_000, 0)]
    columns = [pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts, pa.list_(pa.string())), pa.array([[len(t)] for t in texts], pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays(columns, ["id", "block", "tokens", "counts"])
    for given in (batch, batch.slice(3)):
        cut = list(text_index.pieces(given))
        assert sum(len(c) for c in cut) == len(given) and max(len(c.column(2).flatten()) for c in cut if len(c) > 1) <= text_index.TOKENS
        made = list(text_index._postings([1.0], [0])([given]))
        assert len(made) > 1 and max(sum(map(len, m.column(5).to_pylist())) for m in made) <= 200_000
        got = {(i, t): (n, p) for m in made for t, _, i, n, _, p in zip(*[c.to_pylist() for c in m.columns], strict=True)}
        want = {}
        for i, words in zip(given.column(0).to_pylist(), given.column(2).to_pylist(), strict=True):
            for k, w in enumerate(words):
                want.setdefault((i, w), (len(words), []))[1].append(4 * k)
        assert got == want


def test_job_states_go_on_and_send_no_rows_to_python(spark, tmp_path):
    """Flags are kept from batch to batch, whatever is null; the state is a streaming aggregate."""
    schema = "job long, faces boolean, clip boolean, tags boolean, poses boolean"
    parts = [[(1, True, None, None, None), (2, None, False, None, True), (3, True, True, None, None)], [(1, None, True, False, None), (2, True, None, None, None)]]
    at, out = f"{tmp_path}/in", []
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        states = queues.job_states(spark.readStream.schema(schema).parquet(at), "job", ("faces", "clip"))
        assert states.columns == ["job", "faces", "clip", "tags", "poses", "status"]
        assert "InPandas" not in states._jdf.queryExecution().analyzed().toString()
        queues.run_available(states, lambda df, _: out.append(sorted(tuple(r) for r in df.collect())), f"{tmp_path}/state", "update")
    assert [rows for rows in out if rows] == [
        [(1, True, False, False, False, "pending"), (2, False, False, False, True, "pending"), (3, True, True, False, False, "completed")],
        [(1, True, True, False, False, "completed"), (2, True, False, False, True, "pending")],
    ]


def test_variants_are_made_once_and_by_all_tasks(spark):
    """No filter holds the making of an address or the splitting of a body, and one file's parts are dealt."""
    df = scalars.playlists_read(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and not any("regexp" in line or "split(" in line for line in filters)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_tags_are_grouped_by_more_tasks_as_lines_grow(spark, monkeypatch):
    """No task groups more lines than a bound, about, and nothing is grouped before the lines are dealt."""
    monkeypatch.setattr(views, "TAG_LINES", 500)
    tags = views.asset_tags(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    sizes = [len(x) for x in tags.rdd.glom().collect()]
    assert len(sizes) == lines // 500 > 4 and max(sizes) < 1000
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    assert sorted(map(tuple, tags.collect())) == sorted(con.execute(f"select * from {views.ASSET_TAGS_SQL}").fetchall())


def test_small_graphs_are_not_dealt_over_all_partitions(spark, monkeypatch):
    """A table of a file's rows at most is broadcast, a larger one isn't, and the components are the same either way."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 7] + [(100, i) for i in range(101, 140)], "a long, b long")
    plan = lambda: graph.small(edges)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan()
    want = sorted(map(tuple, graph.components(edges).collect()))
    monkeypatch.setattr(graph, "FILE_ROWS", 10)
    assert "broadcast" not in plan() and sorted(map(tuple, graph.components(edges).collect())) == want
    assert {c for _, c in want} == {1, 8, 15, 22, 29, 36, 43, 50, 57, 100}


def test_links_cost_calls_by_share_not_by_link(spark, tmp_path):
    """Some 300 links in 5 shares: timers and rows of state are of shares. Numbers as links stay exact beside rows without link, time or id."""
    number = lambda name: 2**60 + int(name[1:])
    rows = [(number(r[0]), r[1], 2**60 + r[2], *r[3:]) for r in history(11, links=300, n=2500)]
    lost = [(None, r[1], r[2], "enqueue", None) for r in rows[::7]] + [(r[0], None, r[2], "enqueue", None) for r in rows[::50]] + [(r[0], r[1], None, "enqueue", None) for r in rows[::60]]
    given = sorted(rows + lost, key=lambda r: r[1] or rows[0][1])
    utc = [(r[0], r[1] and r[1].replace(tzinfo=timezone.utc), *r[2:]) for r in given]
    schema = "link long, ts timestamp, id long, kind string, message string"
    stream, queries = written(spark, utc, schema, f"{tmp_path}/in", 3), []

    def start(events):
        queries.append(run(spark, stateful.link_changes(events, "link", shares=5), tmp_path))
        return queries[-1]

    stateful.flushed(spark, start, stream, f"{tmp_path}/closing")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.dtypes == [("link", "bigint"), ("at", "timestamp"), ("change", "string"), ("status", "string"), ("attempts", "int")]
    got = sorted(tuple(r) for r in found.withColumn("at", F.col("at").cast("timestamp_ntz")).collect())
    assert got == [(k, naive(at), *rest) for k, at, *rest in plain(rows)] and len({r[0] for r in got}) > 250
    progress = [p for q in queries for p in q.recentProgress]
    timers = [o["customMetrics"]["numRegisteredTimers"] for p in progress for o in p["stateOperators"]]
    assert sum(timers) > 0 and max(timers) <= 2 * 5
    with stateful.keyed_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "links").load(f"{tmp_path}/state").collect()
    assert len(state) <= 5 and sum(len(r.value.link) for r in state) > 250


def test_share_number_of_links_grows_with_the_events(spark, tmp_path, monkeypatch):
    """A share's memory doesn't grow with the table."""
    given = []
    monkeypatch.setattr(ingest, "SHARE_EVENTS", 8)
    monkeypatch.setattr(stateful, "link_changes", lambda events, *a, f=stateful.link_changes, **b: given.append(b["shares"]) or f(events, *a, **b))
    ingest.stream_links(spark, "/root/testdata/sf0.001")
    assert given == [spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() // 8] * 2
