"""Work that is done again at fixed times, by Structured Streaming's own trigger."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillmere.operators import sync_run
from quillmere.sources import store


@dataclass
class Scheduled:
    """A running schedule: its query, and an entry (batch, error or None) for each run of this process."""

    query: StreamingQuery
    runs: list[tuple[int, str | None]] = field(default_factory=list)

    def stop(self) -> None:
        self.query.stop()

    def wait(self, runs: int, seconds: float) -> bool:
        """Whether so many runs ended in time."""
        until = time.monotonic() + seconds
        while len(self.runs) < runs and time.monotonic() < until and self.query.isActive:
            time.sleep(0.1)
        return len(self.runs) >= runs


def every(spark: SparkSession, seconds: float, checkpoint: str, run: Callable[[int], None], on_error: Callable[[int, Exception], None] | None = None, should_stop: Callable[[], bool] | None = None) -> Scheduled:
    """Call run(number) each `seconds` until it is stopped or should_stop() says so.

    The numbers are those of the stream's batches: they are kept in `checkpoint`, go on after a
    restart, and a run that was broken off comes again with its number, so a run that keeps its
    number with what it writes (a store's token) is done once. An error of a run is reported and
    the next run comes at its time.
    """
    if seconds <= 0:
        raise ValueError("the time between runs must be more than 0")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    scheduled: list[Scheduled] = []
    early: list[tuple[int, str | None]] = []

    def batch(_: DataFrame, number: int) -> None:
        if should_stop and should_stop():
            return
        error = None
        try:
            run(number)
        except Exception as e:  # the schedule outlives one run's failure
            error = f"{type(e).__name__}: {e}"
            if on_error:
                on_error(number, e)
        (scheduled[0].runs if scheduled else early).append((number, error))

    query = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
    scheduled.append(Scheduled(query, early))
    return scheduled[0]


def sync_every(spark: SparkSession, seconds: float, checkpoint: str, local_path: str, base_path: str, backend: sync_run.Backend, **more) -> Scheduled:
    """Synchronise the stores of local files and of the base with a backend at fixed times.

    Each run commits with its number as token, remote first and base last. A run that was broken
    off in between comes again: what the remote holds already equals what is there and is
    recorded, so nothing is pushed twice.
    """
    policy = {k: more.pop(k) for k in ("scopes", "clearance") if k in more}

    def run(number: int) -> None:
        local = store.read(spark, local_path)
        base = store.read(spark, base_path) if store.generations(base_path) else spark.createDataFrame([], "path string, hash string, deleted boolean")
        out = sync_run.run(local, base, backend, token=f"{checkpoint}:{number}", **policy)
        if out.done.where("action in ('pull', 'delete_local')").limit(1).count():
            store.write(out.local, local_path, f"{checkpoint}:{number}")
        store.write(out.base, base_path, f"{checkpoint}:{number}")

    return every(spark, seconds, checkpoint, run, **more)
