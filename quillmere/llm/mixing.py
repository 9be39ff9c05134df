"""Mixing sources to target weights as a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """Targets of a table of sources (source, source_size), one row per source.

    Sources in code-point order, null last, take `weights` in turn and split `share` of all
    words by weight. A target stops at `repeats` times its source's size; what that leaves
    over is shared again by weight until no target is above its stop. That fixed point is a
    water level: sources sorted by stop / weight are filled up from the front while the level of
    the rest is above their stop, and the rest take level * weight. Sources without words get 0.

    The window runs over the table of sources only: one row for each source, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filled = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    below, everything = filled.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.select("source", "source_size", pick.alias("weight"))
        .withColumn("_stop", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_stop") / F.col("weight"))
        .withColumn("_left", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_stop").over(below), F.lit(0.0)))
        .withColumn("_over", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_over"))
        .withColumn("_open", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.row_number().over(filled).alias("at"), "_level"))).over(everything)["_level"])
        .select("source", "source_size", "weight", F.least("_stop", F.coalesce(F.col("_open") * F.col("weight"), F.col("_stop"))).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, schedule: tuple[float, ...] = (2.0, 1.0, 0.5), buckets: int = 3, whole: bool = False) -> DataFrame:
    """Assign training positions in [0, 1) so that each source meets its target.

    Within a source, documents stand in the order of md5 of doc_id and text, read up to `repeats` times.
    Document d of size s, whose first word is number c of its source, is taken in pass p
    while its middle word p * source_size + c + s / 2 lies below the target: the words taken
    differ from the target by half a document at most. Where one pass splits at a target, the
    rest of the source is left out, so no document exceeds repeats * size.

    `schedule` gives the weight of each source relative to a flat one, as a piecewise linear
    density over training time, in turn for the sources (a value v starts at v and ends at
    2 - v). Its integral is the cumulative demand D(t) = v t + (1 - v) t^2; the position of a
    document is the inverse of D at its share of the source's target.

    A prefix sum over a source never meets in one task: words are summed for each (source,
    leading hex digits of md5), those few sums are accumulated, and only documents of one
    bucket are ordered together. `buckets` is the number of hex digits: 16^buckets parts per
    source, so a source of 10^12 documents has 10^12 / 16^buckets in a part.

    Returns doc_id, source, size, source_size, target, taken, positions (one per time the
    document is read) and, if `whole`, `row` (a struct of all columns of `docs`). Nulls: a null
    source is one more source, ordered last; a null doc_id is an empty text in the digest; a
    null text has size 0 and is never taken. Repeated rows are documents of their own: each
    has its own place, and rows alike in doc_id and text are told apart by nothing. An empty
    table gives no rows. Other columns are not read unless `whole`.
    """
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    carried = [F.struct(*docs.columns).alias("row")] if whole else []
    rows = docs.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), text_size(F.col("text")).alias("size"), digest.alias("_key"), *carried).withColumn("_bucket", F.substring("_key", 1, buckets))
    part = ["_source", "_none", "_bucket"]  # no nulls, so that rows dealt for the window stay where they are in the join
    sums = rows.groupBy(*part).agg(F.sum("size").alias("_words"), F.first("source").alias("source"))
    goal = targets(sums.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, repeats)
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedule) + 1
    goal = goal.withColumn("_tilt", F.element_at(F.array(*[F.lit(float(v)) for v in schedule]), turn.cast("int")))
    goal = goal.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), "source_size", "target", "_tilt")
    by_source = Window.partitionBy("_source", "_none").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_words").over(by_source), F.lit(0))).drop("source").join(goal, ["_source", "_none"]).select(*part, "_start", "source_size", "target", "_tilt")
    own = Window.partitionBy(*part).orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(own), F.lit(0))).join(starts, part).withColumn("_first", F.col("_start") + F.col("_before"))
    middle = lambda p: p.cast("long") * F.col("source_size") + F.col("_first") + F.col("size") / 2
    passes = F.when(F.col("size") == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda p: middle(p) < F.col("target")))
    return (
        placed.withColumn("_passes", passes)
        .withColumn("positions", F.transform("_passes", lambda p: _inverse_demand((p.cast("long") * F.col("source_size") + F.col("_first")) / F.col("target"), F.col("_tilt"))))
        .select("doc_id", "source", "size", "source_size", "target", (F.size("positions") * F.col("size")).cast("long").alias("taken"), "positions", *(["row"] if whole else []))
    )


def _inverse_demand(share: Column, tilt: Column) -> Column:
    """t with tilt * t + (1 - tilt) * t^2 = share; both in [0, 1] and 0 <= tilt <= 2."""
    bend = F.lit(1.0) - tilt
    root = (F.sqrt(F.greatest(tilt * tilt + F.lit(4.0) * bend * share, F.lit(0.0))) - tilt) / (F.lit(2.0) * bend)
    return F.when(F.abs(bend) < 1e-12, share).otherwise(root)


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows of mix(), one for each document, sorted by range of the position at which they are first read.

    Documents that are never read come last. Ties are in order of doc_id, which also keeps those
    last ones from being one range. training_stream() has every read as a row of its own.
    """
    order = F.get("positions", F.lit(0)).asc_nulls_last(), F.col("doc_id").asc_nulls_last()
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def training_stream(docs: DataFrame, **options) -> DataFrame:
    """Columns of `docs`, each row as often as the mix reads it, sorted by range of position.

    Rows are carried through the mix, not matched again, so null and repeated doc_ids are rows
    like any others, and names of columns do not matter. A null or empty text is never read. An
    empty table gives no rows.
    """
    read = mix(docs, whole=True, **options).where(F.size("positions") > 0).select("doc_id", "row", F.explode("positions").alias("position"))
    return read.repartitionByRange("position").sortWithinPartitions("position", "doc_id").select("row.*")
