"""Streams run to the end of what is there and read back; their SQL is the batch equivalent."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from orrery.operators.usage import co_retrieval
from orrery.plans import graphs  # noqa: F401 (its SQL is that of the stream's edges)
from orrery.plans.registry import ORACLE_SQL, query
from orrery.plans.views import PROFILES, notices, profiles, table
from orrery.storage import shared_dir
from orrery.streaming import events as s
from orrery.streaming import clusters, queue


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/orrery-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"


@contextmanager
def rocks(spark):
    """The state store that keyed state asks for, while streams of it run."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _finished(spark, stream, mode: str, keys: list[str] = ()):
    """Runs a stream until its source is read out and returns the table that it leaves in the shared folder.

    Appended rows are the table; updates are the last state of each key; of
    complete results the last batch is.
    """
    root, last = _folder(spark), []
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/rows")
    keep = s.changes_of_batch(f"{root}/rows")

    def run(batch, number):
        keep(batch, number)
        last.append(number)

    writer.foreachBatch(run).start().awaitTermination()
    if mode == "update":
        return s.latest(spark, f"{root}/rows", stream.schema, list(keys))
    return spark.read.schema(stream.schema).parquet(f"{root}/rows/batch={last[-1]}")


def _events(spark, sf_dir):
    static = table(spark, sf_dir, "events")
    return s.timed(s.stream_of(spark, f"{sf_dir}/events.parquet*", static.schema))


def _files(spark, *frames, folder: str | None = None) -> str:
    """A folder with the frames' files, in that order of time, behind those that it has."""
    there, folder = folder is not None, folder or f"{_folder(spark)}/in"
    for i, frame in enumerate(frames):
        if i or there:
            time.sleep(1.1)  # files' times are told apart by seconds
        frame.write.mode("append").parquet(folder)
    return folder


@query("stream_tumbling", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return _finished(spark, s.tumbling(_events(spark, sf_dir)), "complete").select(F.to_date("start").alias("day"), "event_type", "n", "total")


@query("stream_sliding", "SELECT strftime(w, '%Y-%m-%d %H') AS hour, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR * CAST(hour(ts) % 6 AS INTEGER), date_trunc('hour', ts) - INTERVAL 1 HOUR * (CAST(hour(ts) % 6 AS INTEGER) + 6)]) AS w FROM events) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    rows = _finished(spark, s.tumbling(_events(spark, sf_dir), "12 hours", "6 hours"), "complete")
    return rows.groupBy(F.date_format("start", "yyyy-MM-dd HH").alias("hour")).agg(F.sum("n").alias("n"))


@query("stream_session", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
    g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    rows = _finished(spark, s.sessions(_events(spark, sf_dir)), "complete")
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("stream_dedupe", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedupe(spark, sf_dir):
    """Events in files that are out of order, half of them twice."""
    static = table(spark, sf_dir, "events")
    folder = _files(spark, static.unionByName(static.filter("event_id % 2 = 0")).repartition(3, F.xxhash64("event_id", F.rand(7))))
    root = _folder(spark)
    writer = s.stream_of(spark, folder, static.schema).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    writer.foreachBatch(s.stored_once(f"{root}/rows", "event_id", static.schema)).start().awaitTermination()
    return spark.read.schema(static.schema).parquet(f"{root}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_late", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2")
def stream_late(spark, sf_dir):
    """Days whose file comes after the watermark has passed them are left out; the mark that tells is that of the batch before."""
    static = table(spark, sf_dir, "events")
    late = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    odd = F.col("event_id") % 2 == 1
    folder = _files(spark, *(static.filter(c).coalesce(1) for c in (~late & odd, ~late & ~odd, late)))
    rows = _finished(spark, s.tumbling(s.timed(s.stream_of(spark, folder, static.schema))), "update", ["start", "event_type"])
    return rows.select(F.to_date("start").alias("day"), "event_type", "n")


@query("stream_join", "SELECT a.event_type, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type <> 'purchase' GROUP BY 1")
def stream_join(spark, sf_dir):
    """Events with a purchase of their user in the hour after them."""
    first, then = _events(spark, sf_dir).filter("event_type <> 'purchase'"), _events(spark, sf_dir).filter("event_type = 'purchase'")
    kinds = table(spark, sf_dir, "events").select("event_id", "event_type")
    return _finished(spark, s.joined(first, then), "append").join(kinds, "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_pairs", "WITH f AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS file FROM lineitem) SELECT a.file AS doc_a, b.file AS doc_b, count(*) AS cnt FROM f a JOIN f b ON a.i = b.i AND a.file < b.file GROUP BY 1, 2")
def stream_pairs(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    pairs = co_retrieval(line.select(F.col("l_orderkey").alias("interaction"), F.col("l_partkey").alias("file")))
    per_answer = pairs.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "cnt"))).select("doc_a", "doc_b")
    return _finished(spark, s.pair_counts(s.stream_of(spark, _files(spark, per_answer), per_answer.schema, 4)), "update", ["doc_a", "doc_b"])


@query("stream_reply_edges", ORACLE_SQL["edge_reply"])
def stream_reply_edges(spark, sf_dir):
    """Letters in three files that are not in order of time, a batch each."""
    letters = notices(spark, sf_dir).select("doc_id", "date", "sender", "recipient")
    folder, root = _files(spark, *(letters.filter(F.col("doc_id") % 3 == k).coalesce(1) for k in (1, 0, 2))), _folder(spark)
    writer = s.stream_of(spark, folder, letters.schema).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    writer.foreachBatch(s.reply_edges_of_batch(root)).start().awaitTermination()
    return s.stored_reply_edges(spark, root)


_DOT = "list_inner_product"


@query("stream_clusters", f"""WITH RECURSIVE {PROFILES}, e AS (SELECT grp, vec_id, row_number() OVER (PARTITION BY grp ORDER BY vec_id % 3, vec_id) AS i, list_transform(embedding, lambda v: v / sqrt({_DOT}(embedding, embedding))) AS x FROM profiles),
    s AS (SELECT grp, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, c DOUBLE[], n BIGINT, since INTEGER, due INTEGER, shown BIGINT[])[]) AS held, CAST([] AS STRUCT(id BIGINT, x DOUBLE[])[]) AS waits, CAST([] AS STRUCT(id BIGINT, cluster BIGINT)[]) AS moved FROM (SELECT DISTINCT grp FROM e)
        UNION ALL SELECT grp, i,
            CASE WHEN hit THEN list_transform(held, lambda k, o: CASE WHEN o = pos THEN {{'id': k.id, 'c': list_transform(k.c, lambda v, d: (v * k.n + x[d]) / sqrt(list_sum(list_transform(k.c, lambda u, f: (u * k.n + x[f]) * (u * k.n + x[f]))))), 'n': k.n + 1, 'since': (k.since + 1) % 5, 'due': k.due + CAST(k.since = 4 AS INTEGER), 'shown': k.shown}} ELSE k END)
                WHEN len(members) >= 3 THEN list_append(held, {{'id': seed.id, 'c': list_transform(total, lambda v: v / sqrt({_DOT}(total, total))), 'n': len(members), 'since': 0, 'due': 0, 'shown': list_transform(members[1:3], lambda m: m.id)}}) ELSE held END,
            CASE WHEN hit THEN waits WHEN len(members) >= 3 THEN list_filter(more, lambda w: NOT list_contains(list_transform(members, lambda m: m.id), w.id)) ELSE more END[-256:],
            CASE WHEN hit THEN [{{'id': vec_id, 'cluster': held[pos].id}}] WHEN len(members) >= 3 THEN list_concat(list_transform(members, lambda m: {{'id': m.id, 'cluster': seed.id}}), CASE WHEN list_contains(list_transform(members, lambda m: m.id), vec_id) THEN [] ELSE [{{'id': vec_id, 'cluster': NULL}}] END) ELSE [{{'id': vec_id, 'cluster': NULL}}] END
        FROM (SELECT *, list_transform(x, lambda v, d: coalesce(list_sum(list_transform(members, lambda m: m.x[d])), 0)) AS total
        FROM (SELECT *, CASE WHEN hit OR len(more) < 5 THEN [] ELSE list_filter(more, lambda b: {_DOT}(seed.x, b.x) >= 0.55) END AS members
        FROM (SELECT *, more[list_position(degrees, list_max(degrees))] AS seed
        FROM (SELECT *, list_transform(more, lambda a: len(list_filter(more, lambda b: {_DOT}(a.x, b.x) >= 0.55))) AS degrees
        FROM (SELECT *, coalesce(list_max(cosines) >= 0.55, FALSE) AS hit, list_position(cosines, list_max(cosines)) AS pos, list_append(waits, {{'id': vec_id, 'x': x}}) AS more
        FROM (SELECT s.grp, e.i, held, waits, vec_id, x, list_transform(held, lambda k: {_DOT}(k.c, x)) AS cosines FROM s JOIN e ON e.grp = s.grp AND e.i = s.i + 1)))))) q),
    v AS (SELECT grp, i, m.id AS vec_id, m.cluster FROM (SELECT grp, i, unnest(moved) AS m FROM s)), k AS (SELECT grp, unnest(held, recursive := true) FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY i DESC) = 1)
    SELECT CAST(grp AS BIGINT) AS grp, 'vector' AS kind, vec_id AS id, cluster, CAST(NULL AS BIGINT) AS members, CAST(NULL AS INTEGER) AS relabels, CAST(NULL AS VARCHAR) AS shown FROM v QUALIFY row_number() OVER (PARTITION BY grp, vec_id ORDER BY i DESC) = 1
    UNION ALL SELECT CAST(grp AS BIGINT), 'cluster', id, id, n, due, array_to_string(shown, ',') FROM k""")
def stream_clusters(spark, sf_dir):
    """Clusters of customers who order alike, in five groups, in three runs of the stream, the second and third from the checkpoint."""
    static = profiles(spark, sf_dir).select("grp", "vec_id", F.col("vec_id").alias("at"), "embedding")
    root, folder = _folder(spark), None
    with rocks(spark):
        for k in range(3):
            folder = _files(spark, static.filter(F.col("vec_id") % 3 == k), folder=folder)
            writer = clusters.online_clusters(s.stream_of(spark, folder, static.schema, 10_000)).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
            writer.foreachBatch(s.changes_of_batch(f"{root}/rows")).start().awaitTermination()
    rows = s.latest(spark, f"{root}/rows", clusters.OUT, ["grp", "kind", "id"])
    return rows.select("grp", "kind", "id", "cluster", "members", "relabels", F.array_join(F.transform("shown", lambda v: v.cast("string")), ",").alias("shown"))


def _queue_steps(name: str, gate: str) -> str:
    """A recursion over each job's events in order: leases that have run out first, then the event."""
    return f"""{name}(project, job, i, status, attempts, until, changed) AS (
        SELECT DISTINCT project, job, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM ev
        UNION ALL SELECT project, job, i, CASE WHEN kind = 'enqueue' THEN coalesce(s, 'queued') WHEN kind = 'claim' AND s = 'queued' AND {gate} THEN 'processing' WHEN kind IN ('complete', 'fail') AND s = 'processing' THEN CASE kind WHEN 'fail' THEN 'failed' ELSE 'ready' END ELSE s END,
            attempts + CASE WHEN kind = 'claim' AND s = 'queued' AND {gate} THEN 1 ELSE 0 END, CASE WHEN kind = 'claim' AND s = 'queued' AND {gate} THEN ms + 864000000 ELSE until END,
            CASE WHEN (kind = 'enqueue' AND s IS NULL) OR (kind = 'claim' AND s = 'queued' AND {gate}) OR (kind IN ('complete', 'fail') AND s = 'processing') THEN ms ELSE c END
        FROM (SELECT q.project, q.job, e.i, e.kind, e.ms, e.place, e.opened, q.attempts, q.until, CASE WHEN status = 'processing' AND until <= ms THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS s, CASE WHEN status = 'processing' AND until <= ms THEN until ELSE changed END AS c
            FROM {name} q JOIN {'ev' if name == 'free' else 'gated'} e ON e.job = q.job AND e.i = q.i + 1))"""


def _queue_last(name: str) -> str:
    late = "status = 'processing' AND until <= (SELECT max(ms) FROM ev)"
    return f"(SELECT project, job, CASE WHEN {late} THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status, attempts, CASE WHEN {late} THEN until ELSE changed END AS changed FROM {name} WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1)"


@query("stream_queue", f"""WITH RECURSIVE raw AS (SELECT o_orderkey AS job, o_custkey // 10 AS project, 'enqueue' AS kind, 2 AS o, epoch_ms(o_orderdate) AS ms FROM orders
        UNION ALL SELECT o_orderkey, o_custkey // 10, 'claim', 3, epoch_ms(l_shipdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT o_orderkey, o_custkey // 10, CASE l_returnflag WHEN 'N' THEN 'complete' ELSE 'fail' END, CASE l_returnflag WHEN 'N' THEN 0 ELSE 1 END, epoch_ms(l_shipdate) + 86400000 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'A'),
    places AS (SELECT o_orderkey AS job, row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders),
    ev AS (SELECT raw.*, place, row_number() OVER (PARTITION BY job ORDER BY ms, o) AS i, CAST(NULL AS BIGINT) AS opened FROM raw JOIN places USING (job)),
    {_queue_steps('free', 'TRUE')},
    ends AS (SELECT project, max(changed) AS opened FROM {_queue_last('free')} JOIN places USING (job) WHERE place < 20 GROUP BY project HAVING count(*) FILTER (status NOT IN ('ready', 'failed')) = 0),
    gated AS (SELECT ev.* REPLACE (ends.opened AS opened) FROM ev LEFT JOIN ends USING (project)),
    {_queue_steps('held', '(place < 20 OR coalesce(ms >= opened, FALSE))')}
    SELECT project, job, status, attempts, changed FROM {_queue_last('held')}""")
def stream_queue(spark, sf_dir):
    """Orders as jobs of projects of ten customers: each line claims its order, two of three ends tell how it went, the others' leases run out.

    The stream is stopped before the last file comes and started again from its checkpoint.
    """
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    job = [F.floor(F.col("o_custkey") / 10).alias("project"), F.col("o_orderkey").alias("job")]
    lines = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    ended = lines.filter("l_returnflag <> 'A'").select(*job, F.when(F.col("l_returnflag") == "N", "complete").otherwise("fail").alias("kind"), (F.col("l_shipdate") + F.expr("interval 1 day")).alias("ts"))
    rows = o.select(*job, F.lit("enqueue").alias("kind"), F.col("o_orderdate").alias("ts")).unionByName(lines.select(*job, F.lit("claim").alias("kind"), F.col("l_shipdate").alias("ts"))).unionByName(ended)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_millis("ts"))
    years = [F.year("ts") < 1997, F.year("ts").between(1997, 1998), F.year("ts") > 1998]
    root, folder = _folder(spark), None
    with rocks(spark):
        for parts in (years[:2], years[2:]):
            folder = _files(spark, *(rows.filter(c) for c in parts), folder=folder)
            stream = s.stream_of(spark, folder, rows.schema, 10_000).withWatermark("ts", "0 seconds")
            writer = queue.job_states(stream, lease=864_000).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
            writer.foreachBatch(s.changes_of_batch(f"{root}/rows")).start().awaitTermination()
    return s.latest(spark, f"{root}/rows", queue.OUT, ["project", "job"])
