"""Stateful streams against plain versions of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.streaming import clusters, queue
from orrery.streaming import events as s

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


def run_queue(spark, folder, batches, **settings):
    """The last states after the batches, each of which starts the stream anew from its checkpoint."""
    for rows in batches:
        frame = spark.createDataFrame(rows, "project long, job long, kind string, at long").withColumn("ts", F.timestamp_millis("at"))
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = s.stream_of(spark, f"{folder}/in", frame.schema, 100).withWatermark("ts", "0 seconds")
        writer = queue.job_states(stream, **settings).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/ck")
        writer.foreachBatch(s.changes_of_batch(f"{folder}/rows")).start().awaitTermination()
    return {(r.project, r.job): (r.status, r.attempts, r.changed) for r in s.latest(spark, f"{folder}/rows", queue.OUT, ["project", "job"]).collect()}


def test_queue_gates_retries_and_goes_on(rocks, tmp_path):
    """Two first jobs gate the third; a job that nobody ends runs out twice and fails; odd events change nothing."""
    first = [(1, j, "enqueue", j) for j in (1, 2, 3)] + [(1, 3, "claim", 10), (1, 1, "claim", 11), (1, 1, "complete", 20), (1, 2, "claim", 30), (1, 2, "claim", 31), (1, 9, "claim", 32), (1, 2, "shrug", 33), (None, 1, "enqueue", 1), (1, None, "enqueue", 2), (1, 3, "complete", 34)]
    second = [(1, 1, "fail", 40), (1, 3, "claim", 50), (1, 2, "claim", 1500), (2, 5, "enqueue", 1600), (2, 5, "claim", 1601), (2, 5, "fail", 1700), (2, 5, "claim", 1800), (2, 5, "enqueue", 1900)]
    third = [(1, 3, "claim", 2600), (2, 6, "enqueue", 2700)]
    got = run_queue(rocks, str(tmp_path), [first, second, third], first=2, lease=1, attempts=2)
    assert got == {(1, 1): ("ready", 1, 20), (1, 2): ("failed", 2, 2500), (1, 3): ("processing", 1, 2600), (2, 5): ("failed", 1, 1700), (2, 6): ("queued", 0, 2700)}


def test_reply_edges_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """A hot pair over two days has one edge, whatever the order; a smaller letter that comes later names its day; a batch may run twice."""
    from orrery.operators import graph

    letters = [(i, f"2020-01-0{1 + i % 2}", *(("A", "B") if i % 2 else ("b ", "a"))) for i in range(100, 140)] + [(1, "2020-01-01", "B", "A"), (2, "2020-01-05", "A", "B"), (3, None, "A", "B"), (4, "2020-01-03", "A", None), (5, "2020-01-04", "A", "A")]
    frame = spark.createDataFrame(letters, "doc_id long, date string, sender string, recipient string")
    run = s.reply_edges_of_batch(str(tmp_path))
    parts = [frame.filter("doc_id % 3 = 1 and doc_id > 50"), frame.filter("doc_id % 3 <> 1 and doc_id > 50"), frame.filter("doc_id < 50")]
    for number, part in enumerate(parts):
        run(part, number)
    run(parts[2], 2)
    key = lambda rows: sorted((r.a, r.b) for r in rows.collect())
    want = key(graph.reply_edges(frame))
    assert key(s.stored_reply_edges(spark, str(tmp_path))) == want and 1 <= len(want) < 10


def run_clusters(spark, folder, batches):
    """The last rows after the batches, each of which starts the stream anew from its checkpoint."""
    for rows in batches:
        frame = spark.createDataFrame(rows, "grp long, vec_id long, at long, embedding array<double>, cluster string")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = clusters.online_clusters(s.stream_of(spark, f"{folder}/in", frame.schema, 100))
        writer = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/ck")
        writer.foreachBatch(s.changes_of_batch(f"{folder}/rows")).start().awaitTermination()
    rows = s.latest(spark, f"{folder}/rows", clusters.OUT, ["grp", "kind", "id"]).collect()
    return {(r.grp, r.id): r.cluster for r in rows if r.kind == "vector"}, {(r.grp, r.id): (r.members, r.relabels, r.shown) for r in rows if r.kind == "cluster"}


def test_waiting_vectors_found_clusters_and_members_ask_for_labels(rocks, tmp_path):
    """The fifth vector that waits founds a cluster of three, named by the first of those with the most near ones; five more ask for a label; all goes on from the checkpoint."""
    e = np.eye(6)
    near = lambda k, j=0.0: [float(x) for x in e[k] + j * e[5]]
    odd = [(1, 90, 0, None, "x"), (1, 91, 0, [0.0] * 6, "x"), (1, 92, 0, [float("nan"), 1.0, 0.0, 0.0, 0.0, 0.0], "x"), (1, 93, 0, [], "x"), (None, 94, 0, near(0), "x"), (1, None, 0, near(0), "x"), (1, 95, 99, [1.0, 2.0], "x"), (1, 96, 99, [None] * 6, "x")]
    first = [(1, 30, 1, near(0), "x"), (1, 20, 2, near(0, 0.1), "x"), (1, 10, 3, near(1), "x"), (1, 40, 4, near(0, 0.2), "x"), (2, 7, 1, [1.0, 0.0], "x")]
    second = [(1, 50, 5, near(2), "x"), (1, 60, 6, near(0, 0.3), "x")]
    third = [(1, 61 + k, 7 + k, near(0), "x") for k in range(5)] + [(1, 70, 12, near(1), "x"), (1, 71, 13, near(1), "x"), (1, 72, 14, near(1, 0.1), "x"), (1, 73, 15, near(3), "x")]
    placed, held = run_clusters(rocks, str(tmp_path), [first + odd, second, third])
    one = {k: 30 for k in (30, 20, 40, 60, 61, 62, 63, 64, 65)} | {k: 10 for k in (10, 70, 71, 72)}
    assert placed == {**{(1, k): c for k, c in one.items()}, **{(1, k): None for k in (50, 73, 90, 91, 92, 93, 95, 96)}, (2, 7): None}
    # vector 71 is the fifth that waits with 10, 50, 70: no, four do; 72 makes five and founds with 10, 70 and 71
    assert held == {(1, 30): (9, 1, [30, 20, 40]), (1, 10): (4, 0, [10, 70, 71])}


def test_the_state_of_clusters_is_bounded(rocks, tmp_path, monkeypatch):
    """Vectors beyond the bound that came first stop waiting, and no more clusters are founded than the bound."""
    monkeypatch.setattr(clusters, "WAITING", 4)
    monkeypatch.setattr(clusters, "CLUSTERS", 1)
    e = [[float(x) for x in row] for row in np.eye(8)]
    rows = [(1, k, k, e[k], "x") for k in range(5)] + [(1, 10, 10, e[0], "x"), (1, 11, 11, e[0], "x"), (1, 12, 12, e[0], "x")] + [(1, 20 + k, 20 + k, e[7], "x") for k in range(6)]
    placed, held = run_clusters(rocks, str(tmp_path), [rows])
    assert placed[1, 0] is None and {placed[1, k] for k in (10, 11, 12)} == {10} and all(placed[1, 20 + k] is None for k in range(6)) and held == {(1, 10): (3, 0, [10, 11, 12])}


def test_jobs_of_a_project_lie_in_buckets(rocks, tmp_path, monkeypatch):
    """State is read and written by buckets that grow one by one, over restarts; each job is found again, and the results are those of a plain loop."""
    calls = []
    monkeypatch.setattr(queue, "BUCKET", 8)

    class Held(dict):
        def getValue(self, key):
            calls.append(key)
            return self.get(key)

        def updateValue(self, key, value):
            calls.append(key)
            self[key] = value

    work, held = queue.WorkQueue(2, 1, 2), Held()
    work.jobs, state = held, {}
    for start in range(0, 500, 100):
        work.count, work.done, work.buckets, work.running, work.soonest = *state.get("project", (0, 0, 1)), {}, None
        work.read, work.touched, work.written = {}, set(), set()
        for job in range(start, start + 100):
            work._take(queue.ORDER["enqueue"], job * 7 - 300, job)
        for bucket in work.written:
            held.updateValue((bucket,), (queue._packed(x for j, r in work.read[bucket].items() for x in (j, *r)),))
        state["project"] = work.count, work.done, work.buckets
    assert work.count == 500 and work.buckets == 63 == len(held) and len(calls) < 500
    work.read = {}
    assert [work._job(job * 7 - 300) for job in range(500)] == [("queued", job, 0, job) for job in range(500)] and work._job(2) is None
    assert max(len(work._rows(b)) for b in range(63)) < 60
    monkeypatch.undo()
    ends = [(1, j, "complete", 2000 + j) for j in range(0, 900, 3)]
    got = run_queue(rocks, str(tmp_path), [[(1, j, "enqueue", j + 1) for j in range(900)] + [(1, j, "claim", 1900) for j in range(900)], ends], first=2, lease=5, attempts=2)
    assert len(got) == 900 and got[1, 0] == ("ready", 1, 2000) and got[1, 1] == ("processing", 1, 1900) and got[1, 897] == ("queued", 0, 898)
