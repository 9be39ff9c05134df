"""Sessions of agents, rebuilt from interleaved JSON records with parent links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.storage import discard, settle

#: Where records carry their fields; the first that is there counts.
FIELDS = {
    "session": ("session_id", "sessionId", "session"),
    "id": ("id", "uuid", "event_id"),
    "parent": ("parent_id", "parentUuid", "parent"),
    "role": ("role", "type"),
    "time": ("timestamp", "time", "ts"),
    "text": ("text", "content", "message"),
}


def _field(record: Column, names: tuple[str, ...]) -> Column:
    """Text of the first named field that is there: a string as it is, anything else as JSON."""
    one = lambda n: F.coalesce(F.try_variant_get(record, f"$.{n}", "string"), F.to_json(F.try_variant_get(record, f"$.{n}", "variant")))
    return F.coalesce(*[one(n) for n in names])


def records(texts: DataFrame) -> DataFrame:
    """(source_id, line, session, id, parent, role, time, text) of each JSON object of JSON-lines texts; other lines are left out.

    A record without an id is named by its line; one without a session belongs to the session ''.
    """
    lines = texts.select("source_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "_l")).withColumn("_v", F.try_parse_json("_l"))
    rows = lines.where(F.schema_of_variant("_v").startswith("OBJECT"))
    cols = {k: _field(F.col("_v"), v) for k, v in FIELDS.items()}
    none = F.lit("")
    return rows.select("source_id", "line", F.coalesce(cols["session"], none).alias("session"), F.coalesce(cols["id"], F.concat(F.lit("line-"), F.col("line"))).alias("id"), cols["parent"].alias("parent"), F.coalesce(cols["role"], none).alias("role"), cols["time"].alias("time"), F.coalesce(cols["text"], none).alias("text"))


def depths(rows: DataFrame) -> DataFrame:
    """records() with `depth`, how many parents stand above each, and `root`, the topmost; by pointer doubling.

    A round doubles how far each record sees, so a thread of n records takes log2(n) rounds, each
    one join of ids. A parent that is not there, or a record that is its own ancestor, ends the
    climb: of records in a circle the one whose line comes first is the root. Of several records of
    one id the first line is what their children hang on.
    """
    keys = ["source_id", "session"]
    rows = settle(rows, "records")
    first = rows.groupBy(*keys, "id").agg(F.min("line").alias("line"), F.min_by("parent", "line").alias("parent"))
    there = first.select(*keys, F.col("id").alias("parent"))
    linked = first.join(there.withColumn("_there", F.lit(True)), [*keys, "parent"], "left")
    up = settle(linked.select(*keys, "id", "line", F.when(F.col("_there") & (F.col("parent") != F.col("id")), F.col("parent")).alias("up"), F.lit(0).cast("long").alias("depth"), F.col("id").alias("root"), F.col("line").alias("low")), "threads")
    up = up.withColumn("depth", F.when(F.col("up").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")).withColumn("root", F.coalesce("up", "id"))
    most = max(1, (up.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1)).bit_length() + 1
    for _ in range(most):
        above = up.select(*keys, F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root").alias("_root"), F.col("low").alias("_low"))
        grown = up.join(above, [*keys, "up"], "left")
        grown = grown.select(*keys, "id", "line", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_root", "root").alias("root"), F.least("low", F.coalesce("_low", "low")).alias("low"))
        before, up = up, settle(grown, "threads")
        discard(before)
        if not up.where("up is not null").limit(1).count():
            break
    # what still has a pointer after so many rounds goes round in a circle: it hangs on the circle's first line
    circle = F.col("up").isNotNull()
    done = up.select(*keys, F.col("id"), F.when(circle, 0).otherwise(F.col("depth")).cast("long").alias("depth"), F.when(circle, F.col("low")).alias("_circle"), "root")
    return rows.join(done, [*keys, "id"]).withColumn("_first", F.coalesce("_circle", "line"))


def sessions(texts: DataFrame) -> DataFrame:
    """records() of (source_id, text) in the order in which they are read: `place` within (source_id, session).

    Threads follow each other by their root's first line; within a thread, by depth, then time,
    then line. Records that other threads' records stand between are so put together again.
    """
    rows = depths(records(texts))
    roots = rows.where("depth = 0").groupBy("source_id", "session", F.col("id").alias("root")).agg(F.min("_first").alias("_thread"))
    order = Window.partitionBy("source_id", "session").orderBy(F.coalesce("_thread", "_first"), "depth", F.col("time").asc_nulls_last(), "line")
    placed = rows.join(roots, ["source_id", "session", "root"], "left").withColumn("place", F.row_number().over(order))
    return placed.select("source_id", "session", "place", "line", "id", "parent", "depth", "role", "time", "text")


def sessions_text(texts: DataFrame) -> DataFrame:
    """(source_id, text): each file's sessions by name, a heading for each and a paragraph for each record."""
    rows = sessions(texts)
    said = F.struct("session", "place", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("said"))
    own = rows.groupBy("source_id", "session").agg(F.array_sort(F.collect_list(said)).alias("_s"))  # a session is a document: its text is one row
    body = F.concat(F.lit("## Session "), F.col("session"), F.lit("\n\n"), F.array_join(F.transform("_s", lambda x: x["said"]), "\n\n"))
    return own.select("source_id", F.struct("session", body.alias("body")).alias("_b")).groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda x: x["body"]), "\n\n").alias("text"))
