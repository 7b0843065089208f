"""A durable work queue as a stateful stream: jobs with claims, leases, retries and a gate on each project's first jobs."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# States of a job that it never leaves, and the jobs of a project that must be there before others start.
TERMINAL = ("ready", "failed")
FIRST = 20
#: Seconds that a claim holds a job, and claims after which a job that nobody ended is failed.
LEASE, ATTEMPTS = 3600, 3
#: Events of one time: ends first, so that what they free can be claimed.
ORDER = {"complete": 0, "fail": 1, "enqueue": 2, "claim": 3}

OUT = T.StructType([T.StructField("project", T.LongType()), T.StructField("job", T.LongType()), T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("changed", T.LongType())])
#: States by the numbers that they are stored under.
STATES = ("queued", "processing", *TERMINAL)
#: Jobs of a bucket, as a project's jobs are read and written by buckets, not one by one.
BUCKET = 256
_PROJECT = "jobs int, done int, buckets int, timer long, leases binary"


def _packed(numbers: Iterable[int]) -> bytes:
    return array("q", numbers).tobytes()


def _numbers(packed: bytes | None) -> array:
    out = array("q")
    out.frombytes(bytes(packed or b""))
    return out


class WorkQueue(StatefulProcessor):
    """The state of one project: its jobs, the leases that run, how many jobs it has and how many of its first ones are done.

    Times are milliseconds. A timer for the lease that runs out next frees jobs
    of projects of which nothing more is heard; what has run out by an event's
    time is freed before that event. Jobs lie in buckets, one more for each
    BUCKET of them, and a new one takes its part of one other only.
    """

    def __init__(self, first: int, lease: int, attempts: int) -> None:
        self.first, self.lease, self.attempts = first, 1000 * lease, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "bucket int", "rows binary")
        self.project = handle.getValueState("project", _PROJECT)

    def _load(self) -> None:
        self.count, self.done, self.buckets, self.timer, leases = self.project.get() or (0, 0, 1, None, None)
        held = _numbers(leases)
        self.running = dict(zip(held[::2], held[1::2], strict=True))
        self.soonest = min(self.running.values(), default=None)
        self.read: dict[int, dict[int, tuple]] = {}
        self.touched: set[int] = set()
        self.written: set[int] = set()

    def _bucket(self, job: int) -> int:
        mixed, top = (job * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32, 1 << (self.buckets - 1).bit_length()
        at = mixed & (top - 1)
        return at if at < self.buckets else at - top // 2

    def _rows(self, bucket: int) -> dict[int, tuple]:
        """The jobs of a bucket: number of the state, place, attempts, time of the last change."""
        if bucket not in self.read:
            found = self.jobs.getValue((bucket,))
            held = _numbers(found[0] if found is not None else None)
            self.read[bucket] = {held[i]: tuple(held[i + 1 : i + 5]) for i in range(0, len(held), 5)}
        return self.read[bucket]

    def _job(self, job: int) -> tuple | None:
        found = self._rows(self._bucket(job)).get(job)
        return (STATES[found[0]], *found[1:]) if found else None

    def _put(self, job: int, status: str, place: int, attempts: int, changed: int) -> None:
        bucket = self._bucket(job)
        self._rows(bucket)[job] = STATES.index(status), place, attempts, changed
        self.touched.add(job)
        self.written.add(bucket)

    def _grow(self) -> None:
        """A bucket more, with those of another bucket's jobs that are its own now."""
        new = self.buckets
        old = new - (1 << new.bit_length() - 1)
        rows = self._rows(old)
        self.buckets += 1
        self.read[new] = {j: r for j, r in rows.items() if self._bucket(j) == new}
        self.read[old] = {j: r for j, r in rows.items() if j not in self.read[new]}
        self.written |= {old, new}

    def _end(self, job: int, was: tuple, status: str, at: int) -> None:
        self._put(job, status, was[1], was[2], at)
        self.running.pop(job, None)
        self.done += status in TERMINAL and was[1] < self.first

    def _free(self, now: int) -> None:
        """Leases that have run out by ``now``, in order of time: their jobs are queued again or, after the last claim, failed."""
        if self.soonest is None or self.soonest > now:
            return
        for until, job in sorted((u, j) for j, u in self.running.items() if u <= now):
            was = self._job(job)
            self._end(job, was, "failed" if was[2] >= self.attempts else "queued", until)
        self.soonest = min(self.running.values(), default=None)

    def _take(self, kind: int, job: int, now: int) -> None:
        was = self._job(job)
        if kind == ORDER["enqueue"]:
            if was is None:
                self._put(job, "queued", self.count, 0, now)
                self.count += 1
                if self.count > BUCKET * self.buckets:
                    self._grow()
        elif was is None:
            return
        elif kind == ORDER["claim"]:
            if was[0] == "queued" and (was[1] < self.first or self.done >= self.first):
                self._put(job, "processing", was[1], was[2] + 1, now)
                self.running[job] = until = now + self.lease
                self.soonest = until if self.soonest is None else min(self.soonest, until)
        elif was[0] == "processing":
            self._end(job, was, "ready" if kind == ORDER["complete"] else "failed", now)

    def _save(self, key: int) -> Iterator[pd.DataFrame]:
        for bucket in self.written:
            self.jobs.updateValue((bucket,), (_packed(x for j, r in self.read[bucket].items() for x in (j, *r)),))
        # a timer that comes too early asks for the next one, so only an earlier lease needs another
        soonest = min(self.running.values(), default=None)
        if soonest is not None and (self.timer is None or soonest < self.timer):
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(soonest)
            self.timer = soonest
        self.project.update((self.count, self.done, self.buckets, self.timer, _packed(x for pair in self.running.items() for x in pair)))
        rows = [(key, job, was[0], was[2], was[3]) for job in self.touched if (was := self._job(job))]
        yield pd.DataFrame(rows, columns=OUT.names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self._load()
        events = [e for frame in rows for e in zip(frame["at"].tolist(), frame["kind"].tolist(), frame["job"].tolist(), strict=True)]
        for at, kind, job in sorted(e for e in events if e[1] >= 0):
            self._free(at)
            self._take(kind, job, at)
        yield from self._save(int(key[0]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._load()
        expired = int(expiredTimerInfo.getExpiryTimeInMs())
        self.timer = self.timer if self.timer != expired else None
        self._free(max(expired, int(timerValues.getCurrentWatermarkInMs())))
        yield from self._save(int(key[0]))

    def close(self) -> None:
        return


def job_states(events: DataFrame, first: int = FIRST, lease: int = LEASE, attempts: int = ATTEMPTS) -> DataFrame:
    """``project, job, status, attempts, changed``: the jobs that a batch of a stream of ``project, job, kind, at, ts`` has changed.

    ``kind`` is enqueue, claim, complete or fail; ``at`` the event's time in
    milliseconds, ``ts`` the same as a timestamp with a watermark. A job may be
    claimed while it is queued, and beyond the first ``first`` jobs of its
    project only when all of those have ended. A claim holds for ``lease``
    seconds; then the job is queued again, or failed after ``attempts`` claims.
    A job that is enqueued twice stays as it is; events of jobs that are not
    there, ends of jobs that nobody holds, other kinds and nulls change nothing.

    State is kept in the checkpoint, so a query that is started again goes on
    where it was. A project's events are taken in order by one task, as each
    claim depends on all before; its jobs are in the state store, and only the
    buckets that a batch needs are in memory. Needs the RocksDB state store.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own worker does not see files that were sent along
    kind = reduce(lambda c, name: c.when(F.col("kind") == name, ORDER[name]), ORDER, F.when(F.col("job").isNull() | F.col("at").isNull(), -1)).otherwise(-1)
    # rows of no use stay, as their times move the watermark
    coded = events.filter("project is not null").select("project", F.coalesce("job", F.lit(0)).cast("long").alias("job"), kind.alias("kind"), F.coalesce("at", F.lit(0)).cast("long").alias("at"), "ts")
    return coded.groupBy("project").transformWithStateInPandas(WorkQueue(first, lease, attempts), OUT, "update", "eventTime")
