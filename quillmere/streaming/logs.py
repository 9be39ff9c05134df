"""Streams of logs: draining, pairing, hash chains, latest rows, windowed counts.

Positions are those of Spark's checkpoints (files and offsets), never counts of sorted rows, so
a record that comes late is still read, and only once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quillmere.operators.ledger import EVENT_INPUT, RECORD, Chain, input_hash


def read_log(spark: SparkSession, folder: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder, at most `max_files` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def drain(stream: DataFrame, out: str, checkpoint: str, day_of: str | None = None):
    """Append all that is there now to Parquet, then stop; each record is written once."""
    if day_of:
        stream = stream.withColumn("date", F.to_date(day_of))
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append")
    return (writer.partitionBy("date") if day_of else writer).start()


def pairs(events: DataFrame, timeout: str = "1 day") -> DataFrame:
    """(key, stop_id, start_ts, stop_ts, duration_ms) of stops that follow a start; events: key, id, ts, event.

    State is the open start of a key: one row. A start that nothing stops is dropped by the
    event-time watermark, after `timeout`.
    """

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        rows = rows.assign(_o=(rows["event"] != "start").astype(int)).sort_values(["ts", "_o"])
        open_ = state.get[0] if state.exists else None
        out = []
        for r in rows.itertuples():
            if r.event == "start":
                open_ = int(r.ts.value // 1000)
            elif open_ is not None:
                stop = int(r.ts.value // 1000)
                out.append((key[0], r.id, pd.Timestamp(open_, unit="us"), r.ts, max(0, (stop - open_) // 1000)))
                open_ = None
        if open_ is None:
            if state.exists:
                state.remove()
        else:
            state.update((open_,))
            mark = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(open_ // 1000, mark) + int(pd.Timedelta(timeout).total_seconds() * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "stop_id", "start_ts", "stop_ts", "duration_ms"])

    watermarked = events.withWatermark("ts", timeout)
    return watermarked.groupBy("key").applyInPandasWithState(work, "key string, stop_id long, start_ts timestamp, stop_ts timestamp, duration_ms long", "start long", "append", GroupStateTimeout.EventTimeTimeout)


def chained(events: DataFrame) -> DataFrame:
    """Ledger records of streamed events: per stream a chain of hashes, with duplicates and conflicts told apart."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = Chain(json.loads(state.get[0])) if state.exists else Chain()
        names = [c.split()[0] for c in EVENT_INPUT.split(", ")]
        out = []
        for r in pd.concat(list(parts)).sort_values(["timestamp", "event_id"]).to_dict("records"):
            event = {k: (list(r[k]) if k == "project_keys" and r[k] is not None else r[k]) for k in [*names, "input_hash"]}
            out.append(chain.add(event))
        state.update((json.dumps(chain.dump()),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    return events.withColumn("input_hash", input_hash()).groupBy("stream_type", "stream_id").applyInPandasWithState(work, RECORD, "chain string", "append", GroupStateTimeout.NoTimeout)


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, for update or complete mode: an aggregation whose state is one row a key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert_batches(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], order: list[str]):
    """Keep the newest row of each key in `folder`: every batch writes the next version, named by its number.

    A batch that runs again writes the same version from the same one before, so a restart does
    no harm. Readers take the version with the largest number.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number:
            new = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/version={number - 1}"))
        latest(new, keys, order).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by window and kind; windows close when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
