"""Automation jobs as a keyed state machine with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of events. kind: start (with the number of steps), done, failed (both with a step) or confirm.
EVENT = "event_id string, job string, kind string, step string, steps int, notices int, error string, at timestamp"
#: Columns of what jobs become.
CHANGE = "job string, status string, attempts int, completed int, notices int, error string, at timestamp"
#: States of a job; the first two are over, and nothing but a confirmation changes them.
SUCCEEDED, NEEDS_CONFIRMATION, RUNNING, FAILED = "succeeded", "needs_confirmation", "running", "failed"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


class Jobs(StatefulProcessor):
    """One job's state: its status, attempts, planned steps, notices and deadline, the steps done, and the events seen.

    An event that was seen changes nothing, nor does a start of a job that is over; a failed job
    may be started again and then does all its steps anew. All steps done, a job has succeeded,
    or needs confirmation if any step left a notice. A job that runs past its deadline has failed.
    """

    def __init__(self, timeout_s: int):
        self.timeout = timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, steps int, notices int, deadline long")
        self.done = handle.getMapState("done", "step string", "at long")
        self.seen = handle.getMapState("seen", "event_id string", "at long")

    def _forget_deadline(self, deadline: int) -> None:
        if deadline >= 0:
            self.handle.deleteTimer(deadline)

    def _completed(self) -> int:
        return sum(1 for _ in self.done.keys())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changes = []
        for part in rows:
            for e in part.sort_values(["at", "event_id"], kind="stable").itertuples():
                if self.seen.containsKey((e.event_id,)):
                    continue
                self.seen.updateValue((e.event_id,), (_ms(e.at),))
                if (change := self._step(e)) is not None:
                    changes.append((key[0], *change, e.at))
        if changes:
            yield pd.DataFrame(changes, columns=[c.split(" ")[0] for c in CHANGE.split(", ")])

    def _step(self, e) -> tuple | None:
        status, attempts, steps, notices, deadline = self.job.get() if self.job.exists() else (None, 0, 0, 0, -1)
        if e.kind == "start" and status in (None, FAILED):
            self.done.clear()
            due = _ms(e.at) + self.timeout
            self.handle.registerTimer(due)
            self.job.update((RUNNING, attempts + 1, int(e.steps), 0, due))
            return (RUNNING, attempts + 1, 0, 0, None) if e.steps else self._end(attempts + 1, 0, due)
        if e.kind == "done" and status == RUNNING and not self.done.containsKey((e.step,)):
            self.done.updateValue((e.step,), (_ms(e.at),))
            notices += 0 if pd.isna(e.notices) else int(e.notices)
            self.job.update((status, attempts, steps, notices, deadline))
            if self._completed() >= steps:
                return self._end(attempts, notices, deadline)
        elif e.kind == "failed" and status == RUNNING:
            self._forget_deadline(deadline)
            self.job.update((FAILED, attempts, steps, notices, -1))
            return FAILED, attempts, self._completed(), notices, f"{e.step}: {e.error}"
        elif e.kind == "confirm" and status == NEEDS_CONFIRMATION:
            self.job.update((SUCCEEDED, attempts, steps, notices, -1))
            return SUCCEEDED, attempts, self._completed(), notices, None
        return None

    def _end(self, attempts: int, notices: int, deadline: int) -> tuple:
        self._forget_deadline(deadline)
        status = NEEDS_CONFIRMATION if notices else SUCCEEDED
        self.job.update((status, attempts, self._completed(), notices, -1))
        return status, attempts, self._completed(), notices, None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts, steps, notices, deadline = self.job.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if status == RUNNING and deadline == due:
            self.job.update((FAILED, attempts, steps, notices, -1))
            yield pd.DataFrame([(key[0], FAILED, attempts, self._completed(), notices, "timed out", pd.Timestamp(due, unit="ms"))], columns=[c.split(" ")[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """Jobs keep their state in RocksDB, which a session must be told before their query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def changes(events: DataFrame, timeout_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """What becomes of jobs, as rows of CHANGE, from a stream of EVENT. Deadlines go by the events' own time, `late` behind the newest."""
    timed = events.withWatermark("at", late)
    kind = ", ".join(f"{c.split(' ')[0]} {c.split(' ')[1]}" for c in CHANGE.split(", "))
    return timed.groupBy("job").transformWithStateInPandas(statefulProcessor=Jobs(timeout_s), outputStructType=kind, outputMode="Append", timeMode="EventTime")


def current(history: DataFrame) -> DataFrame:
    """The newest state of each job from its changes; the later attempt counts, then the state that is farther on."""
    place = F.when(F.col("status") == RUNNING, 0).when(F.col("status") == FAILED, 1).when(F.col("status") == NEEDS_CONFIRMATION, 2).otherwise(3)
    order = F.struct("attempts", place.alias("place"), "at")
    return history.groupBy("job").agg(F.max_by(F.struct(*[c for c in history.columns if c != "job"]), order).alias("s")).select("job", "s.*")
