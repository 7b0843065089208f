"""Programme analysis over tasks and their links, from the public literature of the critical-path method.

Tasks: ``revision, task, name, start, finish, duration, planned_start,
planned_finish, percent, resource, units``; links: ``revision, pred, succ, lag``.
Dates are dates, durations whole days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.storage import discard, stash


def quality_checks(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Ratios of the usual schedule-quality checks, one row a check: missing logic, leads, lags, long durations, late tasks."""
    joined = tasks.join(links.groupBy(F.col("succ").alias("task")).agg(F.count("*").alias("preds")), "task", "left").join(links.groupBy(F.col("pred").alias("task")).agg(F.count("*").alias("succs")), "task", "left")
    a = joined.agg(
        F.round(F.avg((F.col("preds").isNull() | F.col("succs").isNull()).cast("double")), 6).alias("missing_logic"),
        F.round(F.avg((F.col("duration") > 44).cast("double")), 6).alias("high_duration"),
        F.round(F.avg((F.col("finish") > F.col("planned_finish")).cast("double")), 6).alias("late_finish"),
    ).unpivot([], ["missing_logic", "high_duration", "late_finish"], "check_name", "ratio")
    b = links.agg(F.round(F.avg((F.col("lag") < 0).cast("double")), 6).alias("leads"), F.round(F.avg((F.col("lag") > 0).cast("double")), 6).alias("lags")).unpivot([], ["leads", "lags"], "check_name", "ratio")
    return a.unionByName(b)


def early_dates(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Early start and finish of each task as days from the start: the longest path to it.

    Relaxation in rounds of one join and one aggregate; only tasks that moved
    are joined again. A network with a cycle never settles and raises once there
    have been more rounds than tasks.
    """
    n = tasks.count()
    durations = stash(tasks.select("task", "duration"), "cpm-durations")
    links = stash(links.select("pred", "succ", "lag"), "cpm-links")
    known = stash(durations.select("task", F.lit(0).cast("long").alias("es")), "cpm-early")
    moved = known
    for _ in range(n + 1):
        pushed = moved.join(durations, "task").join(links, F.col("task") == F.col("pred")).groupBy(F.col("succ").alias("task")).agg(F.max(F.col("es") + F.col("duration") + F.col("lag")).alias("at"))
        new = stash(known.join(pushed, "task", "left").select("task", F.greatest("es", "at").alias("es"), (F.coalesce("at", F.lit(-1)) > F.col("es")).alias("moved")), "cpm-early")
        discard(known)
        known, moved = new.select("task", "es"), new.filter("moved").select("task", "es")
        known._stash_path = new._stash_path
        if moved.isEmpty():
            return known.join(durations, "task").select("task", "es", (F.col("es") + F.col("duration")).alias("ef"))
    raise ValueError("the links have a cycle")


def critical(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Early dates with total float: the length less the longest path through a task; zero is critical."""
    forward = early_dates(tasks, links)
    back = early_dates(tasks, links.select(F.col("succ").alias("pred"), F.col("pred").alias("succ"), "lag")).select("task", F.col("ef").alias("tail"))
    length = forward.agg(F.max("ef").alias("length"))
    return forward.join(back, "task").crossJoin(F.broadcast(length)).select("task", "es", "ef", (F.col("length") - (F.col("es") + F.col("tail"))).alias("total_float"))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tasks added, deleted, renamed or with another duration between two revisions."""
    a = old.select("task", F.col("name").alias("old_name"), F.col("duration").alias("old_duration"), F.lit(True).alias("in_old"))
    b = new.select("task", "name", "duration", F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(~F.col("old_name").eqNullSafe(F.col("name")), "renamed").when(F.col("old_duration") != F.col("duration"), "duration")
    return a.join(b, "task", "full_outer").select("task", kind.alias("change"), "old_duration", "duration").filter("change is not null")


def milestone_shift(tasks: DataFrame) -> DataFrame:
    """Days by which each task's finish moved from one revision to the next."""
    before = F.lag("finish").over(Window.partitionBy("task").orderBy("revision"))
    return tasks.withColumn("before", before).filter("before is not null").select("task", "revision", F.datediff("finish", "before").cast("long").alias("moved"))


def float_erosion(floats: DataFrame) -> DataFrame:
    """Median float of each revision and its change: ``floats(revision, task, total_float)``."""
    medians = floats.groupBy("revision").agg(F.median("total_float").alias("median_float"))
    return medians.withColumn("change", F.col("median_float") - F.lag("median_float").over(Window.partitionBy(F.lit(0)).orderBy("revision")))


def s_curve(tasks: DataFrame) -> DataFrame:
    """Planned and recorded share of all units by month, cumulative: planned by planned finish, recorded by finish."""
    part = lambda c, k: tasks.groupBy(F.trunc(c, "month").alias("month")).agg(F.sum("units").alias(k))
    both = part("planned_finish", "planned").join(part("finish", "recorded"), "month", "full_outer").na.fill(0)
    upto, all_ = Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0))
    share = lambda c: F.round(100 * F.sum(c).over(upto) / F.sum(c).over(all_), 4)
    return both.select("month", share("planned").alias("planned_pct"), share("recorded").alias("recorded_pct"))


def resource_histogram(tasks: DataFrame) -> DataFrame:
    """Units a day of each resource, spread evenly over a task's days."""
    days = tasks.withColumn("day", F.explode(F.sequence("start", "finish", F.expr("interval 1 day"))))
    return days.groupBy("resource", "day").agg(F.round(F.sum(F.col("units") / (F.datediff("finish", "start") + 1)) + 1e-7, 4).alias("units"))


def out_of_sequence(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose successor started before its predecessor had finished."""
    p = tasks.select(F.col("task").alias("pred"), F.col("finish").alias("pred_finish"))
    s = tasks.select(F.col("task").alias("succ"), F.col("start").alias("succ_start"))
    return links.join(p, "pred").join(s, "succ").filter("succ_start < pred_finish").select("pred", "succ", F.datediff("pred_finish", "succ_start").cast("long").alias("days"))


def planned_vs_built(tasks: DataFrame) -> DataFrame:
    """Delays of start and finish and growth of the duration, task by task."""
    d = lambda a, b: F.datediff(a, b).cast("long")
    return tasks.select("task", d("start", "planned_start").alias("start_delay"), d("finish", "planned_finish").alias("finish_delay"), (d("finish", "start") - d("planned_finish", "planned_start")).alias("growth"))


def windows_analysis(tasks: DataFrame) -> DataFrame:
    """Completion of each revision, its movement, and the task that drives it."""
    ends = tasks.groupBy("revision").agg(F.max(F.struct("finish", (-F.col("task")).alias("neg"))).alias("e")).select("revision", F.col("e.finish").alias("completion"), (-F.col("e.neg")).alias("driver"))
    w = Window.partitionBy(F.lit(0)).orderBy("revision")
    return ends.withColumns({"moved": F.datediff("completion", F.lag("completion").over(w)).cast("long"), "driver_switched": F.coalesce(F.col("driver") != F.lag("driver").over(w), F.lit(False))})


def with_impact(links: DataFrame, tasks: DataFrame, inserted: DataFrame) -> tuple[int, int]:
    """Length of the programme without and with inserted delays: ``inserted(task, days)`` lengthens those tasks."""
    longer = tasks.join(inserted, "task", "left").withColumn("duration", F.col("duration") + F.coalesce("days", F.lit(0)))
    return length_of(tasks, links), length_of(longer, links)


def with_fragnet(tasks: DataFrame, links: DataFrame, new_tasks: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A network with the tasks and links of an event put in; a link that is there already gets the event's lag."""
    known = new_tasks.select("task", "duration")
    rest = tasks.select("task", "duration").join(known.select("task"), "task", "left_anti")
    old = links.select("pred", "succ", "lag").join(new_links.select("pred", "succ"), ["pred", "succ"], "left_anti")
    return rest.unionByName(known), old.unionByName(new_links.select("pred", "succ", "lag"))


def without_tasks(tasks: DataFrame, links: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A network with tasks taken out and their logic kept: they last no time, and no lag leads to or from them."""
    gone = removed.select("task").distinct().withColumn("gone", F.lit(True))
    left = tasks.join(gone, "task", "left").select("task", F.when(F.col("gone"), F.lit(0)).otherwise(F.col("duration")).cast("long").alias("duration"))
    ends = lambda c: gone.select(F.col("task").alias(c), F.col("gone").alias(f"gone_{c}"))
    lag = F.when(F.col("gone_pred") | F.col("gone_succ"), F.lit(0)).otherwise(F.col("lag")).cast("long")
    return left, links.join(ends("pred"), "pred", "left").join(ends("succ"), "succ", "left").select("pred", "succ", lag.alias("lag"))


def length_of(tasks: DataFrame, links: DataFrame) -> int:
    """Days of the longest path."""
    return early_dates(tasks, links).agg(F.max("ef")).first()[0] or 0


def as_built_path(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """The tasks that drove the recorded completion: from the last to finish back over each one's driving predecessor.

    A task is driven by its predecessor that finished last, of equals the one
    with the smallest number. Ancestors are found by doubling the steps, so the
    rounds are the logarithm of the path's length; a cycle ends it.

    Returns ``task, finish``.
    """
    done = stash(tasks.select("task", "finish"), "built-tasks")
    by = links.join(done.select(F.col("task").alias("pred"), F.col("finish").alias("at")), "pred").groupBy("succ").agg(F.max(F.struct("at", (-F.col("pred")).alias("neg"))).alias("d"))
    jump = stash(by.select("succ", (-F.col("d.neg")).alias("pred")), "built-drivers")
    found = stash(done.orderBy(F.desc("finish"), "task").limit(1).select("task"), "built-path")
    while True:
        back = found.join(jump, F.col("task") == F.col("succ")).select(F.col("pred").alias("task"))
        more = stash(found.unionByName(back).distinct(), "built-path")
        if more.count() == found.count():
            return more.join(done, "task")
        found = more
        over = jump.select(F.col("succ").alias("pred"), F.col("pred").alias("further"))
        jump = stash(jump.join(over, "pred").select("succ", F.col("further").alias("pred")), "built-drivers")


def hierarchy(tasks: DataFrame, levels: list[str]) -> DataFrame:
    """Counts and units along chosen dimensions, with subtotals."""
    return tasks.rollup(*levels).agg(F.count("*").alias("tasks"), F.round(F.sum("units"), 2).alias("units"))


def transferred(tasks: DataFrame, actuals: DataFrame) -> DataFrame:
    """A network's tasks with another's actual dates and percentages where it has them."""
    a = actuals.select("task", *(F.col(c).alias(f"_{c}") for c in ("start", "finish", "percent")))
    return tasks.join(a, "task", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("start", "finish", "percent")}).drop("_start", "_finish", "_percent")
