"""Automation jobs through real streams: transitions, replays, restarts and deadlines."""

import datetime as dt

import pytest

from quillmere.streaming import jobs

T0 = dt.datetime(2026, 1, 1, 8)


def events(*rows):
    """(job, kind, minute, step, notices)"""
    return [(f"{job}-{kind}-{step or ''}-{minute}", job, kind, step, 2 if kind == "start" else None, notices, "broke" if kind == "failed" else None, T0 + dt.timedelta(minutes=minute)) for job, kind, minute, step, notices in rows]


FIRST = events(
    ("good", "start", 0, None, None), ("good", "done", 1, "a", 0), ("good", "done", 2, "a", 5), ("good", "done", 3, "b", 0), ("good", "start", 4, None, None),
    ("asks", "start", 0, None, None), ("asks", "done", 1, "a", 2), ("asks", "done", 2, "b", None),
    ("bad", "start", 0, None, None), ("bad", "done", 1, "a", 1), ("bad", "failed", 2, "b", None), ("bad", "done", 3, "b", 0),
    ("slow", "start", 0, None, None), ("none", "done", 1, "a", 0),
)
SECOND = events(("asks", "confirm", 5, None, None), ("bad", "start", 6, None, None), ("bad", "done", 7, "a", 0), ("bad", "done", 8, "b", 0), ("slow", "done", 9, "a", 0))
THIRD = events(("late", "start", 600, None, None))
FOURTH = events(("late", "done", 601, "a", 0))


@pytest.fixture
def run(spark, tmp_path):
    jobs.prepare(spark)
    turn = iter(range(100))

    def go(*batches):
        for rows in batches:
            spark.createDataFrame(rows, jobs.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"b{next(turn):02d}"))
            stream = spark.readStream.schema(jobs.EVENT).json(str(tmp_path / "in" / "*"))
            query = jobs.changes(stream, timeout_s=1800).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        return spark.read.schema(jobs.CHANGE).json(str(tmp_path / "out"))

    yield go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_jobs_go_on_over_restarts_and_replays_change_nothing(run):
    seen = lambda df: sorted((r.job, r.attempts, r.status, r.completed, r.notices, r.error) for r in df.collect())
    first = [("asks", 1, "needs_confirmation", 2, 2, None), ("asks", 1, "running", 0, 0, None), ("bad", 1, "failed", 1, 1, "b: broke"), ("bad", 1, "running", 0, 0, None), ("good", 1, "running", 0, 0, None), ("good", 1, "succeeded", 2, 0, None), ("slow", 1, "running", 0, 0, None)]
    assert seen(run(FIRST, FIRST)) == first
    second = sorted(first + [("asks", 1, "succeeded", 2, 2, None), ("bad", 2, "running", 0, 0, None), ("bad", 2, "succeeded", 2, 0, None)], key=str)
    out = run(SECOND, SECOND, FIRST)
    assert sorted(seen(out), key=str) == second
    out = run(THIRD, FOURTH)
    assert [x for x in seen(out) if x not in second] == [("late", 1, "running", 0, 0, None), ("slow", 1, "failed", 1, 0, "timed out")]
    assert {r.job: r.status for r in jobs.current(out).collect()} == {"asks": "succeeded", "bad": "succeeded", "good": "succeeded", "slow": "failed", "late": "running"}
