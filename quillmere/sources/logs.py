"""Append-only JSON-lines logs and folders of JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object a line; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their text)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    fine = F.try_parse_json("value").isNotNull()
    return lines.where(fine).select(F.from_json("value", schema).alias("_r")).select("_r.*"), lines.where(~fine).select(F.col("value").alias("line"), "file")


def read_numbered(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Good rows with file name and line number (from 1); bad lines are left out."""
    files = spark.read.format("text").option("wholetext", True).load(path).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("_at", "_line")).where(F.trim("_line") != "")
    parsed = lines.withColumn("_r", F.from_json("_line", schema, {"mode": "PERMISSIVE"}))
    return parsed.where(F.col("_r").isNotNull() & F.try_parse_json("_line").isNotNull()).select("_r.*", "file", (F.col("_at") + 1).alias("line"))


def latest(rows: DataFrame, time: str, n: int, *ties: str, **equal: str) -> DataFrame:
    """The newest n rows that have the given values, oldest first."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.col(time).desc(), *[F.col(t).desc() for t in ties]).limit(n).orderBy(time, *ties)


def append(df: DataFrame, path: str, day_of: str | None = None) -> None:
    """Append rows as JSON lines, in a folder for each day if `day_of` names a timestamp column."""
    if day_of:
        df = df.withColumn("date", F.substring(F.col(day_of).cast("string"), 1, 10))
    writer = df.write.mode("append")
    (writer.partitionBy("date") if day_of else writer).json(path)


def read_records(spark: SparkSession, folder: str, schema: StructType, *order: str) -> DataFrame:
    """A folder of JSON records (one a file, of several lines) as sorted rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(folder).orderBy(*order)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key is not among them."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
