"""Three-way synchronisation of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.access import sensitivity_level


def eligible(path: Column, visibility: Column, sensitivity: Column, clearance: str, scopes: tuple[str, ...]) -> Column:
    """A knowledge file outside generated and hidden folders whose labels may leave; unknown labels may not."""
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda p: F.startswith(p, F.lit("."))) & ~F.startswith(path, F.lit("/")) & ~F.exists(parts, lambda p: p == "..") & F.coalesce(visibility.isin(*scopes) & (sensitivity_level(sensitivity) <= sensitivity_level(F.lit(clearance))), F.lit(False))


def plan(local: DataFrame, remote: DataFrame, base: DataFrame) -> DataFrame:
    """(path, action, hash, tombstone) for every path of either side.

    local: path, hash. remote and base: path, hash, deleted, and for remote `accessible`. A
    deleted entry counts as absent, but a tombstone is remembered. With no base, a file on one
    side is pushed or pulled, and two different ones are a conflict; with a base, the side that
    changed wins and two different changes are a conflict. An inaccessible remote file is
    skipped and never taken for a deletion. base is rewritten from `record`, pushes and pulls.
    """
    l = local.select("path", F.col("hash").alias("l"))  # noqa: E741
    r = remote.select("path", F.when(~F.col("deleted"), F.col("hash")).alias("r"), F.col("deleted").alias("_tomb"), "accessible")
    b = base.select("path", F.when(~F.col("deleted"), F.col("hash")).alias("b"), F.lit(True).alias("_base"))
    rows = l.join(r, "path", "full").join(b, "path", "full")
    same = F.col("l").eqNullSafe(F.col("r"))
    local_changed, remote_changed = ~F.col("l").eqNullSafe(F.col("b")), ~F.col("r").eqNullSafe(F.col("b"))
    fresh = F.when(same & F.col("l").isNotNull(), "record").when(F.col("l").isNotNull() & F.col("r").isNull(), "push").when(F.col("l").isNull() & F.col("r").isNotNull(), "pull").when(F.col("l").isNotNull(), "conflict").otherwise("record_tombstone")
    known = (
        F.when(same, F.when(F.col("l").isNull(), "record_tombstone").otherwise("record"))
        .when(local_changed & remote_changed, "conflict")
        .when(local_changed, F.when(F.col("l").isNull(), "delete_remote").otherwise("push"))
        .otherwise(F.when(F.col("r").isNull(), "delete_local").otherwise("pull"))
    )
    chosen = F.when(F.col("accessible") == F.lit(False), "skip").when(F.coalesce("_base", F.lit(False)), known).otherwise(fresh)
    kept = F.when(chosen.isin("push", "record"), F.col("l")).when(chosen == "pull", F.col("r")).when(chosen.isin("conflict", "skip"), F.col("b"))
    return rows.select("path", chosen.alias("action"), kept.alias("hash"), chosen.isin("delete_remote", "delete_local", "record_tombstone").alias("tombstone"))


def next_base(planned: DataFrame) -> DataFrame:
    """Base entries after the plan was carried out; unresolved conflicts keep what they had."""
    return planned.where(F.col("hash").isNotNull() | F.col("tombstone")).select("path", "hash", F.col("tombstone").alias("deleted"))
