"""Synchronisation of a table of files with a store, carried out whole or not at all."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.access import sensitivity_level
from quillmere.operators import sync
from quillmere.sources import store
from quillmere.storage import discard, settle

ENTRY = "path string, hash string, deleted boolean, visibility string, sensitivity string, content string"


class Backend(ABC):
    """A remote side: its entries (ENTRY) at a generation, and the commit of the next one."""

    @abstractmethod
    def generation(self) -> int: ...

    @abstractmethod
    def entries(self, spark: SparkSession) -> DataFrame: ...

    @abstractmethod
    def commit(self, entries: DataFrame, generation: int, token: str | None) -> int:
        """Replace all entries if the remote is still at `generation`, else store.StaleGeneration; a known token changes nothing."""


@dataclass
class StoreBackend(Backend):
    """A store (see quillmere.sources.store) as remote side."""

    path: str

    def generation(self) -> int:
        return (store.generations(self.path) or [0])[-1]

    def entries(self, spark: SparkSession) -> DataFrame:
        return store.read(spark, self.path) if self.generation() else spark.createDataFrame([], ENTRY)

    def commit(self, entries: DataFrame, generation: int, token: str | None) -> int:
        return store.write(entries, self.path, token, generation)


@dataclass
class Outcome:
    """Local files and base after a run, what was done (path, action), the remote's generation, and whether it was written."""

    local: DataFrame
    base: DataFrame
    done: DataFrame
    generation: int
    wrote: bool


def run(local: DataFrame, base: DataFrame, backend: Backend, scopes: tuple[str, ...] = ("team", "public"), clearance: str = "internal", token: str | None = None) -> Outcome:
    """Bring `local` (path, content, visibility, sensitivity) and the backend's entries together.

    base: path, hash, deleted of the last run; empty at first. Only files that are eligible
    leave; a local file that no longer is counts neither as deleted nor as changed. Remote
    entries that the caller may not read are skipped and stay as they are. A conflict is
    reported and both sides keep theirs. The remote is written once, and only if something is
    pushed or deleted there; if another has written it meanwhile, nothing is done at all.
    Paths are one row on either side: of several, the one whose content is largest.
    """
    spark = local.sparkSession
    generation = backend.generation()
    remote = settle(backend.entries(spark), "sync-remote")
    own = local.groupBy("path").agg(F.max_by(F.struct("content", "visibility", "sensitivity"), F.coalesce("content", F.lit(""))).alias("_l")).select("path", "_l.*")
    may = sync.eligible(F.col("path"), F.col("visibility"), F.col("sensitivity"), clearance, scopes)
    own = settle(own.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256)).withColumn("eligible", may), "sync-local")
    held_back = own.where("not eligible").select("path")
    readable = F.col("deleted") | F.coalesce(F.col("visibility").isin(*scopes) & (sensitivity_level(F.col("sensitivity")) <= sensitivity_level(F.lit(clearance))), F.lit(False))
    there = remote.join(held_back, "path", "left_anti").select("path", "hash", "deleted", readable.alias("accessible"))
    known = base.join(held_back, "path", "left_anti")
    planned = settle(sync.plan(own.where("eligible").select("path", "hash"), there, known), "sync-plan")
    acts = {r.action: r["count"] for r in planned.groupBy("action").count().collect()}  # one row for each of ten actions
    wrote = bool(acts.get("push") or acts.get("delete_remote"))
    if wrote:
        pushed = own.join(planned.where("action = 'push'").select("path"), "path").select("path", "hash", F.lit(False).alias("deleted"), "visibility", "sensitivity", "content")
        gone = remote.join(planned.where("action = 'delete_remote'").select("path"), "path").select("path", "hash", F.lit(True).alias("deleted"), "visibility", "sensitivity", F.lit(None).cast("string").alias("content"))
        stay = remote.join(planned.where("action in ('push', 'delete_remote')").select("path"), "path", "left_anti")
        generation = backend.commit(stay.unionByName(pushed).unionByName(gone), generation, token)
    pulled = remote.join(planned.where("action = 'pull'").select("path"), "path").select("path", "content", "visibility", "sensitivity")
    keep = own.join(planned.where("action in ('pull', 'delete_local')").select("path"), "path", "left_anti").select("path", "content", "visibility", "sensitivity")
    after = settle(keep.unionByName(pulled), "sync-files")
    base_after = settle(sync.next_base(planned).unionByName(base.join(held_back, "path", "left_semi").select("path", "hash", "deleted")), "sync-base")
    done = settle(planned.where("action not in ('record', 'record_tombstone')").select("path", "action"), "sync-done")
    for df in (remote, own, planned):
        discard(df)
    return Outcome(after, base_after, done, generation, wrote)
