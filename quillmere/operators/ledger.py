"""Append-only event ledgers: chains of hashes, timelines, pairings, staged events."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages of the two kinds of streams.
STAGES = {
    "support": ("intake", "triage", "query", "hypothesis", "root_cause", "action", "verification", "escalation", "closure", "recurrence"),
    "initiative": ("discovery", "review", "design", "development", "testing", "release", "operations", "incident", "retrospective", "cancelled"),
}
#: What an event says, in the order in which it is hashed.
_INPUT = ("stream_type", "stream_id", "stage", "event_type", "summary", "project_keys", "actor_type", "capture_mode", "parent_event_id", "payload_object")
EVENT_INPUT = "stream_type string, stream_id string, stage string, event_type string, summary string, project_keys array<string>, actor_type string, capture_mode string, parent_event_id string, payload_object string, idempotency_key string, event_id string, timestamp string"
RECORD = EVENT_INPUT + ", sequence long, input_hash string, previous_hash string, record_hash string, outcome string"


def stage_valid(stream_type: Column, stage: Column) -> Column:
    out = F.lit(False)
    for kind, stages in STAGES.items():
        out = F.when(stream_type == kind, stage.isin(*stages)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def input_hash() -> Column:
    """Hash of what an event says: canonical JSON with a fixed key order, sorted project keys, absent values as null."""
    value = lambda c: F.array_sort(F.coalesce(c, F.array().cast("array<string>"))).alias(c) if c == "project_keys" else F.col(c)
    return F.sha2(F.to_json(F.struct(*[value(c) for c in _INPUT]), {"ignoreNullFields": "false"}).cast("binary"), 256)


#: What stands for a null in a record's hash; no other part begins with a zero character.
_ABSENT = "\0"


def record_hash(previous: str | None, sequence: int, event_id: str | None, timestamp: str | None, own: str) -> str:
    """Hash of a record: the hash before it, its number, id, time and what it says, one a line."""
    parts = (previous, str(sequence), event_id, timestamp, own)
    return hashlib.sha256("\n".join(_ABSENT if p is None else p for p in parts).encode()).hexdigest()


def record_hash_of(previous: Column, sequence: Column, event_id: Column, timestamp: Column, own: Column) -> Column:
    """record_hash() as an expression."""
    parts = [F.coalesce(c, F.lit(_ABSENT)) for c in (previous, sequence.cast("string"), event_id, timestamp, own)]
    return F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)


class Chain:
    """State of one stream: last hash, number of events, what each idempotency key said, known event ids."""

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.last, self.count = state.get("last"), state.get("count", 0)
        self.keys, self.ids = dict(state.get("keys", {})), set(state.get("ids", ()))

    def dump(self) -> dict:
        return {"last": self.last, "count": self.count, "keys": self.keys, "ids": sorted(self.ids)}

    def add(self, event: dict) -> dict:
        """The record of an event (with its input_hash): appended, duplicate (same key, same input), conflict, unknown_parent, repeated_id or invalid_stage."""
        outcome, sequence, previous, mark = self.place(event["stream_type"], event["stage"], event.get("idempotency_key"), event.get("parent_event_id"), event["event_id"], event["timestamp"], event["input_hash"])
        return {**event, "sequence": sequence, "previous_hash": previous, "record_hash": mark, "outcome": outcome}

    def place(self, kind: str | None, stage: str | None, key: str | None, parent: str | None, name: str | None, time: str | None, own: str) -> tuple[str, int | None, str | None, str | None]:
        """(outcome, sequence, previous_hash, record_hash) of an event."""
        if stage not in STAGES.get(kind, ()):
            return "invalid_stage", None, None, None
        if key is not None and key in self.keys:
            return "duplicate" if self.keys[key] == own else "conflict", None, None, None
        if parent and parent not in self.ids:
            return "unknown_parent", None, None, None
        if name in self.ids:
            return "repeated_id", None, None, None
        previous, self.count = self.last, self.count + 1
        self.last = record_hash(previous, self.count, name, time, own)
        self.ids.add(name)
        if key is not None:
            self.keys[key] = own
        return "appended", self.count, previous, self.last


def append(ledger: DataFrame | None, events: DataFrame) -> DataFrame:
    """Records of new events (EVENT_INPUT) after those of `ledger`; only outcome 'appended' belongs in it.

    Events are hashed where they stand. A chain is a sequence, so a stream is one group; of its
    known records only keys, ids, numbers and hashes take part.
    """
    names = [c.split()[0] for c in EVENT_INPUT.split(", ")]
    shape = dict(c.split(" ", 1) for c in EVENT_INPUT.split(", "))
    new = events.select(*names, F.lit(None).cast("long").alias("sequence"), input_hash().alias("input_hash"), F.lit(None).cast("string").alias("record_hash"))
    known = ("stream_type", "stream_id", "idempotency_key", "event_id")
    both = new if ledger is None else new.unionByName(ledger.select(*[F.col(c) if c in known else F.lit(None).cast(shape[c]).alias(c) for c in names], "sequence", "input_hash", "record_hash"))

    def work(group: pa.Table) -> pa.Table:
        chain, known = Chain(), pc.is_valid(group["sequence"])
        old, new = group.filter(known).sort_by("sequence"), group.filter(pc.invert(known)).sort_by([("timestamp", "ascending"), ("event_id", "ascending")])
        each = lambda rows, *columns: zip(*[rows[c].to_pylist() for c in columns], strict=True)
        for chain.last, chain.count, name, key, own in each(old, "record_hash", "sequence", "event_id", "idempotency_key", "input_hash"):
            chain.ids.add(name)
            if key is not None:
                chain.keys[key] = own
        placed = [chain.place(*event) for event in each(new, "stream_type", "stage", "idempotency_key", "parent_event_id", "event_id", "timestamp", "input_hash")]
        text = new.schema.field("input_hash").type
        outcome, sequence, previous, mark = (pa.array([p[k] for p in placed], pa.int64() if k == 1 else text) for k in range(4))
        return pa.table([*[new[c] for c in names], sequence, new["input_hash"], previous, mark, outcome], names=[c.split()[0] for c in RECORD.split(", ")])

    return both.groupBy("stream_type", "stream_id").applyInArrow(work, RECORD)


def verify(ledger: DataFrame) -> DataFrame:
    """(stream_type, stream_id, valid, first_bad): every hash computed again from the record, and the chain checked.

    A record is bad if its number leaves a gap, its stage is none of its kind of stream, its
    previous hash is not that of the record before, its input hash or record hash is not what
    its columns give, its event id stands in an earlier record, or its parent does not.
    """
    stream = ("stream_type", "stream_id")
    w = Window.partitionBy(*stream).orderBy("sequence", "event_id")
    first = ledger.groupBy(*stream, "event_id").agg(F.min("sequence").alias("_first"))
    parent = first.select(*stream, F.col("event_id").alias("parent_event_id"), F.col("_first").alias("_parent"))
    rows = ledger.withColumn("_own", input_hash()).join(first, [*stream, "event_id"], "left").join(parent, [*stream, "parent_event_id"], "left")
    rows = rows.withColumn("_at", F.row_number().over(w)).withColumn("_before", F.lag("record_hash").over(w))
    whole = record_hash_of(F.col("previous_hash"), F.col("sequence"), F.col("event_id"), F.col("timestamp"), F.col("_own"))
    tests = (
        F.col("_at") == F.col("sequence"), stage_valid(F.col("stream_type"), F.col("stage")), F.col("_before").eqNullSafe(F.col("previous_hash")), F.col("_own").eqNullSafe(F.col("input_hash")),
        whole.eqNullSafe(F.col("record_hash")), F.col("_first") == F.col("sequence"), F.col("parent_event_id").isNull() | F.coalesce(F.col("_parent") < F.col("sequence"), F.lit(False)),
    )
    bad = ~F.forall(F.array(*[F.coalesce(t, F.lit(False)) for t in tests]), lambda t: t)
    return rows.groupBy(*stream).agg((~F.max(bad)).alias("valid"), F.min(F.when(bad, F.col("_at"))).cast("long").alias("first_bad"))


def stream_summary(ledger: DataFrame) -> DataFrame:
    """One row a stream: events, project keys, last stage and time, status. A later stage never reopens a stream."""
    has = lambda s: F.max(F.col("stage") == s)
    state = F.when(F.first("stream_type") == "support", F.when(has("closure"), "closed").otherwise("active")).otherwise(F.when(has("cancelled"), "cancelled").when(has("retrospective"), "completed").otherwise("active"))
    return ledger.groupBy("stream_type", "stream_id").agg(F.count(F.lit(1)).alias("events"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("project_keys")))).alias("project_keys"), F.max_by("stage", "sequence").alias("last_stage"), F.max("timestamp").alias("last_at"), state.alias("status"))


def list_streams(ledger: DataFrame, kind: str | None = None, status: str | None = None, project: str | None = None) -> DataFrame:
    rows = stream_summary(ledger)
    for value, test in ((kind, F.col("stream_type") == kind), (status, F.col("status") == status), (project, F.array_contains("project_keys", project))):
        if value:
            rows = rows.where(test)
    return rows.orderBy(F.col("last_at").desc(), "stream_type", "stream_id")


def ledger_status(ledger: DataFrame, vault: DataFrame) -> DataFrame:
    """(status, streams, events, payloads, missing payloads) by status of stream."""
    there = vault.select(F.col("vault_id").alias("payload_object"), F.lit(True).alias("_there"))
    per = ledger.join(there, "payload_object", "left").groupBy("stream_type", "stream_id").agg(F.count("payload_object").alias("payloads"), F.count_if(F.col("payload_object").isNotNull() & F.col("_there").isNull()).alias("missing_payloads"))
    return stream_summary(ledger).join(per, ["stream_type", "stream_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("streams"), F.sum("events").alias("events"), F.sum("payloads").alias("payloads"), F.sum("missing_payloads").alias("missing_payloads"))


def event_detail(ledger: DataFrame, vault: DataFrame, event_id: str) -> DataFrame:
    there = vault.select(F.col("vault_id").alias("payload_object"), F.lit(True).alias("payload_available"))
    return ledger.where(F.col("event_id") == event_id).join(there, "payload_object", "left").withColumn("payload_available", F.coalesce("payload_available", F.lit(False)))


def pair_key(agent_id: Column, session_id: Column, agent_type: Column) -> Column:
    """The agent if it is named, else session and type."""
    return F.when(agent_id.isNotNull(), F.concat(F.lit("agent:"), agent_id)).when(session_id.isNotNull() & agent_type.isNotNull(), F.concat_ws(":", F.lit("session"), session_id, agent_type))


def pair_starts(events: DataFrame, key: str, time: str, kind: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Add `paired` and `duration_ms` to stops: a stop takes the start right before it among its key's events.

    A second start replaces the first, and a start is used once, so a stop pairs exactly when
    the event of its key just before it is a start: one window, no state.
    """
    w = Window.partitionBy(key).orderBy(F.col(time), F.when(F.col(kind) == start, 0).otherwise(1))
    rows = events.withColumn("_before", F.lag(kind).over(w)).withColumn("_since", F.lag(time).over(w))
    paired = F.col(key).isNotNull() & (F.col(kind) == stop) & F.coalesce(F.col("_before") == start, F.lit(False))
    took = F.greatest(F.lit(0), F.floor((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_since").cast("timestamp"))) / 1000)).cast("long")
    return rows.withColumn("paired", paired).withColumn("duration_ms", F.when(paired, took)).drop("_before", "_since")


def anonymise(events: DataFrame) -> DataFrame:
    """Staged hook events without what people wrote: hashes of session, turn and prompt, and the prompt's length."""
    h = lambda c: F.when(F.col(c).isNotNull(), F.substring(F.sha2(F.col(c).cast("binary"), 256), 1, 16))
    return events.select("event", "timestamp", h("session_id").alias("session_hash"), h("turn_id").alias("turn_hash"), h("prompt").alias("prompt_hash"), F.length("prompt").alias("prompt_length"))


def log_status(events: DataFrame, kind: str = "event") -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(kind) == "start").alias("starts"), F.count_if(F.col(kind) == "stop").alias("stops"), F.count_if((F.col(kind) == "stop") & ~F.col("paired")).alias("unmatched"))


def cleanup(events: DataFrame, before: str, pending: DataFrame) -> DataFrame:
    """What stays after a cleanup; it refuses while records of the span are pending or unmatched."""
    open_ = pending.where(F.col("timestamp") < before).count() + events.where((F.col("timestamp") < before) & (F.col("event") == "stop") & ~F.col("paired")).count()
    if open_:
        raise ValueError(f"{open_} records are still needed")
    return events.where(F.col("timestamp") >= before)
