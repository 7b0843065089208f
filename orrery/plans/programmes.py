"""Queries over a programme made of orders (tasks) and their order within a customer (links)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import programme as p
from orrery.plans.registry import query
from orrery.plans.views import table
from orrery.storage import stash


def tasks(spark, sf_dir):
    """Each order as a task in one of three revisions."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    planned = F.to_date("o_orderdate")
    length = (1 + k % 60).cast("int")
    start = F.date_add(planned, (k % 11).cast("int"))
    return o.select(
        (k % 3).alias("revision"), k.alias("task"), F.concat(F.lit("T"), (k % 17).cast("string")).alias("name"), F.col("o_custkey").alias("project"),
        start.alias("start"), F.date_add(start, length).alias("finish"), (1 + k % 60).alias("duration"), planned.alias("planned_start"), F.date_add(planned, length).alias("planned_finish"),
        (k % 101).cast("double").alias("percent"), F.col("o_orderpriority").alias("resource"), F.round("o_totalprice", 2).alias("units"),
    )


def links(spark, sf_dir):
    """Each order is followed by its customer's next one, with a lag now and then."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pred"), after.alias("succ"), (F.col("o_orderkey") % 5 - 1).alias("lag")).filter("succ is not null")


_T = """tasks AS (SELECT o_orderkey % 3 AS revision, o_orderkey AS task, 'T' || CAST(o_orderkey % 17 AS VARCHAR) AS name, o_custkey AS project,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 AS INTEGER) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 + 1 + o_orderkey % 60 AS INTEGER) AS finish, 1 + o_orderkey % 60 AS duration,
    CAST(o_orderdate AS DATE) AS planned_start, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 60 AS INTEGER) AS planned_finish, o_orderpriority AS resource, round(o_totalprice, 2) AS units FROM orders),
    links AS (SELECT * FROM (SELECT o_orderkey AS pred, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS succ, o_orderkey % 5 - 1 AS lag FROM orders) WHERE succ IS NOT NULL)"""


@query("programme_quality", f"""WITH {_T} SELECT 'missing_logic' AS check_name, round(avg(CASE WHEN task IN (SELECT succ FROM links) AND task IN (SELECT pred FROM links) THEN 0.0 ELSE 1.0 END), 6) AS ratio FROM tasks
    UNION ALL SELECT 'high_duration', round(avg(CASE WHEN duration > 44 THEN 1.0 ELSE 0.0 END), 6) FROM tasks UNION ALL SELECT 'late_finish', round(avg(CASE WHEN finish > planned_finish THEN 1.0 ELSE 0.0 END), 6) FROM tasks
    UNION ALL SELECT 'leads', round(avg(CASE WHEN lag < 0 THEN 1.0 ELSE 0.0 END), 6) FROM links UNION ALL SELECT 'lags', round(avg(CASE WHEN lag > 0 THEN 1.0 ELSE 0.0 END), 6) FROM links""")
def programme_quality(spark, sf_dir):
    return p.quality_checks(tasks(spark, sf_dir), links(spark, sf_dir))


_WHOLE = f"WITH RECURSIVE {_T}, t AS (SELECT * FROM tasks), l AS (SELECT * FROM links)"


@query("critical_path", _WHOLE + """, f(task, pos) AS (SELECT task, CAST(0 AS BIGINT) FROM t UNION SELECT l.succ, f.pos + d.duration + l.lag FROM f JOIN l ON l.pred = f.task JOIN t d ON d.task = f.task),
    b(task, pos) AS (SELECT task, CAST(0 AS BIGINT) FROM t UNION SELECT l.pred, b.pos + d.duration + l.lag FROM b JOIN l ON l.succ = b.task JOIN t d ON d.task = b.task),
    e AS (SELECT task, greatest(max(pos), 0) AS es FROM f GROUP BY 1), g AS (SELECT task, greatest(max(pos), 0) AS tail FROM b GROUP BY 1)
    SELECT task, es, es + duration AS ef, (SELECT max(es + duration) FROM e JOIN t USING (task)) - (es + tail + duration) AS total_float FROM e JOIN g USING (task) JOIN t USING (task)""")
def critical_path(spark, sf_dir):
    return p.critical(tasks(spark, sf_dir), links(spark, sf_dir))


@query("revision_comparison", f"""WITH {_T}, a AS (SELECT task // 3 AS task, name, duration FROM tasks WHERE revision = 0), b AS (SELECT task // 3 AS task, name, duration FROM tasks WHERE revision = 1)
    SELECT * FROM (SELECT coalesce(a.task, b.task) AS task, CASE WHEN a.task IS NULL THEN 'added' WHEN b.task IS NULL THEN 'deleted' WHEN a.name <> b.name THEN 'renamed' WHEN a.duration <> b.duration THEN 'duration' END AS change, a.duration AS old_duration, b.duration AS duration FROM a FULL JOIN b ON a.task = b.task) WHERE change IS NOT NULL""")
def revision_comparison(spark, sf_dir):
    t = tasks(spark, sf_dir).withColumn("task", F.expr("task div 3"))
    return p.compared(t.filter("revision = 0"), t.filter("revision = 1"))


@query("milestone_shift", f"WITH {_T}, s AS (SELECT task // 3 AS task, revision, finish, lag(finish) OVER (PARTITION BY task // 3 ORDER BY revision) AS before FROM tasks) SELECT task, revision, CAST(finish - before AS BIGINT) AS moved FROM s WHERE before IS NOT NULL")
def milestone_shift(spark, sf_dir):
    return p.milestone_shift(tasks(spark, sf_dir).withColumn("task", F.expr("task div 3")))


def _forward(name: str, t: str, lk: str) -> str:
    return f"{name}(task, pos) AS (SELECT task, CAST(0 AS BIGINT) FROM {t} UNION SELECT {lk}.succ, {name}.pos + d.duration + {lk}.lag FROM {name} JOIN {lk} ON {lk}.pred = {name}.task JOIN {t} d ON d.task = {name}.task)"


@query("float_erosion", _WHOLE + f""", {_forward('f', 't', 'l')},
    b(task, pos) AS (SELECT task, CAST(0 AS BIGINT) FROM t UNION SELECT l.pred, b.pos + d.duration + l.lag FROM b JOIN l ON l.succ = b.task JOIN t d ON d.task = b.task),
    e AS (SELECT task, greatest(max(pos), 0) AS es FROM f GROUP BY 1), g AS (SELECT task, greatest(max(pos), 0) AS tail FROM b GROUP BY 1),
    m AS (SELECT revision, median(CAST((SELECT max(es + duration) FROM e JOIN t USING (task)) - (es + tail + duration) AS DOUBLE)) AS median_float FROM e JOIN g USING (task) JOIN t USING (task) GROUP BY 1)
    SELECT revision, median_float, median_float - lag(median_float) OVER (ORDER BY revision) AS change FROM m""")
def float_erosion(spark, sf_dir):
    """The total float of the whole network's tasks, by the revision they came with."""
    t = tasks(spark, sf_dir)
    return p.float_erosion(p.critical(t, links(spark, sf_dir)).join(t.select("task", "revision"), "task"))


_EVENT_T, _EVENT_L = "SELECT 1000000000 + task AS task, CAST(20 AS BIGINT) AS duration FROM tasks WHERE task % 50 = 0", "SELECT task AS pred, 1000000000 + task AS succ, CAST(3 AS BIGINT) AS lag FROM tasks WHERE task % 50 = 0 UNION ALL SELECT 1000000000 + pred, succ, 0 FROM links WHERE pred % 50 = 0"


@query("time_impact", f"""WITH RECURSIVE {_T}, ti AS (SELECT task, duration FROM tasks UNION ALL {_EVENT_T}), li AS (SELECT * FROM links UNION ALL {_EVENT_L}),
    tr AS (SELECT task, CASE WHEN task % 7 = 0 THEN 0 ELSE duration END AS duration FROM tasks), lr AS (SELECT pred, succ, CASE WHEN pred % 7 = 0 OR succ % 7 = 0 THEN 0 ELSE lag END AS lag FROM links),
    {_forward('f0', 'tasks', 'links')}, {_forward('f1', 'ti', 'li')}, {_forward('f2', 'tr', 'lr')}
    SELECT 'planned' AS network, CAST((SELECT max(greatest(pos, 0) + duration) FROM f0 JOIN tasks USING (task)) AS BIGINT) AS days UNION ALL SELECT 'impacted', CAST((SELECT max(greatest(pos, 0) + duration) FROM f1 JOIN ti USING (task)) AS BIGINT)
    UNION ALL SELECT 'collapsed', CAST((SELECT max(greatest(pos, 0) + duration) FROM f2 JOIN tr USING (task)) AS BIGINT)""")
def time_impact(spark, sf_dir):
    """Length as it is, with an event put behind every fiftieth task, and with every seventh task taken out."""
    t, k = stash(tasks(spark, sf_dir).select("task", "duration"), "impact-tasks"), stash(links(spark, sf_dir), "impact-links")
    hit = t.filter("task % 50 = 0")
    events = hit.select((1_000_000_000 + F.col("task")).alias("task"), F.lit(20).cast("long").alias("duration"))
    tied = hit.select(F.col("task").alias("pred"), (1_000_000_000 + F.col("task")).alias("succ"), F.lit(3).cast("long").alias("lag")).unionByName(k.filter("pred % 50 = 0").select((1_000_000_000 + F.col("pred")).alias("pred"), "succ", F.lit(0).cast("long").alias("lag")))
    days = {"planned": (t, k), "impacted": p.with_fragnet(t, k, events, tied), "collapsed": p.without_tasks(t, k, t.filter("task % 7 = 0"))}
    return spark.createDataFrame([(name, int(p.length_of(*network))) for name, network in days.items()], "network string, days long")


@query("as_built_path", f"""WITH RECURSIVE {_T}, d AS (SELECT succ, arg_max(pred, epoch(CAST(finish AS TIMESTAMP)) * 1000000 - pred) AS pred FROM links JOIN tasks ON task = pred GROUP BY 1),
    w(task) AS (SELECT task FROM (SELECT task FROM tasks ORDER BY finish DESC, task LIMIT 1) UNION SELECT d.pred FROM w JOIN d ON d.succ = w.task) SELECT task, finish FROM w JOIN tasks USING (task)""")
def as_built_path(spark, sf_dir):
    return p.as_built_path(tasks(spark, sf_dir), links(spark, sf_dir))


@query("progress_s_curve", f"""WITH {_T}, m AS (SELECT coalesce(a.month, b.month) AS month, coalesce(planned, 0) AS planned, coalesce(recorded, 0) AS recorded FROM (SELECT CAST(date_trunc('month', planned_finish) AS DATE) AS month, sum(units) AS planned FROM tasks GROUP BY 1) a FULL JOIN (SELECT CAST(date_trunc('month', finish) AS DATE) AS month, sum(units) AS recorded FROM tasks GROUP BY 1) b ON a.month = b.month)
    SELECT month, round(100 * sum(planned) OVER (ORDER BY month) / sum(planned) OVER (), 4) AS planned_pct, round(100 * sum(recorded) OVER (ORDER BY month) / sum(recorded) OVER (), 4) AS recorded_pct FROM m""")
def progress_s_curve(spark, sf_dir):
    return p.s_curve(tasks(spark, sf_dir))


@query("resource_loading", f"WITH {_T}, d AS (SELECT resource, unnest(generate_series(CAST(start AS TIMESTAMP), CAST(finish AS TIMESTAMP), INTERVAL 1 DAY)) AS day, units / (finish - start + 1) AS u FROM tasks) SELECT resource, CAST(day AS DATE) AS day, round(sum(u) + 1e-7, 4) AS units FROM d GROUP BY 1, 2")
def resource_loading(spark, sf_dir):
    return p.resource_histogram(tasks(spark, sf_dir))


@query("out_of_sequence", f"WITH {_T} SELECT pred, succ, CAST(a.finish - b.start AS BIGINT) AS days FROM links JOIN tasks a ON a.task = pred JOIN tasks b ON b.task = succ WHERE b.start < a.finish")
def out_of_sequence(spark, sf_dir):
    return p.out_of_sequence(tasks(spark, sf_dir), links(spark, sf_dir))


@query("planned_vs_built", f"WITH {_T} SELECT task, CAST(start - planned_start AS BIGINT) AS start_delay, CAST(finish - planned_finish AS BIGINT) AS finish_delay, CAST((finish - start) - (planned_finish - planned_start) AS BIGINT) AS growth FROM tasks")
def planned_vs_built(spark, sf_dir):
    return p.planned_vs_built(tasks(spark, sf_dir))


@query("windows_analysis", f"""WITH {_T}, e AS (SELECT revision, max(finish) AS completion FROM tasks GROUP BY 1), d AS (SELECT e.revision, completion, min(task) AS driver FROM e JOIN tasks t ON t.revision = e.revision AND finish = completion GROUP BY 1, 2)
    SELECT revision, completion, driver, CAST(completion - lag(completion) OVER (ORDER BY revision) AS BIGINT) AS moved, coalesce(driver <> lag(driver) OVER (ORDER BY revision), false) AS driver_switched FROM d""")
def windows_analysis(spark, sf_dir):
    return p.windows_analysis(tasks(spark, sf_dir))


@query("programme_hierarchy", f"WITH {_T} SELECT resource, name, count(*) AS tasks, round(sum(units), 2) AS units FROM tasks GROUP BY ROLLUP (resource, name)")
def programme_hierarchy(spark, sf_dir):
    return p.hierarchy(tasks(spark, sf_dir), ["resource", "name"])


@query("sequence_fronts", f"WITH {_T} SELECT name, count(*) AS fronts FROM (SELECT DISTINCT name, project FROM tasks) GROUP BY name HAVING count(*) >= 3")
def sequence_fronts(spark, sf_dir):
    return tasks(spark, sf_dir).select("name", "project").distinct().groupBy("name").agg(F.count("*").alias("fronts")).filter("fronts >= 3")


@query("progress_transfer", f"WITH {_T} SELECT a.task, coalesce(b.start, a.start) AS start, coalesce(b.finish, a.finish) AS finish FROM (SELECT * FROM tasks WHERE revision = 0) a LEFT JOIN (SELECT task - 1 AS task, start, finish FROM tasks WHERE revision = 1) b USING (task)")
def progress_transfer(spark, sf_dir):
    t = tasks(spark, sf_dir)
    return p.transferred(t.filter("revision = 0"), t.filter("revision = 1").withColumn("task", F.col("task") - 1)).select("task", "start", "finish")
