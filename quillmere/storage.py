"""Tables in the folder that driver and executors share: intermediate ones and kept ones."""

from __future__ import annotations

import gc
import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used on one machine only, where the session names no spark.checkpoint.dir, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/quillmere"
_leaving: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder if it is unset and the master is local, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return LOCAL_SHARED_DIR
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def _on_disk(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    All tables of an application are in one folder, which goes when the application ends;
    discard() deletes one as soon as nothing reads it any more.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/quillmere/{spark.sparkContext.applicationId}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in _leaving:
        files, target = _on_disk(spark, folder)
        files.deleteOnExit(target)
        _leaving.add(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what settle() wrote, once nothing reads it any more."""
    path = getattr(df, "_settled_path", None)
    if path:
        files, target = _on_disk(df.sparkSession, path)
        files.delete(target, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that nothing reads any more, and the shuffle files of queries that are done.

    Spark deletes those files once the driver has collected the plans that name them, which can be
    long after: a job of many steps would hold the files of all of them.
    """
    for df in tables:
        discard(df)
    gc.collect()
    spark._jvm.System.gc()


def kept(spark: SparkSession, name: str, version: str, write: Callable[[str], None]) -> str:
    """Path of a kept table; `write` makes it unless this version of it is there.

    It is written beside its place and then renamed, so readers see all of it or nothing. Of two
    writers the first wins. The place does not change between applications.
    """
    place = f"{shared_dir(spark)}/quillmere/kept/{name}-{version}"
    files, target = _on_disk(spark, place)
    if not files.exists(target):
        draft = f"{place}.{uuid.uuid4().hex}"
        write(draft)
        _, made = _on_disk(spark, draft)
        if files.exists(target) or not files.rename(made, target):
            files.delete(made, True)
    return place


def fingerprint(df: DataFrame) -> str:
    """A name for what a table read from files holds now: its files' paths, sizes and times, and its columns."""
    files = df.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string")).alias("h")).distinct()
    n, mixed = files.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0))).first()
    columns = df.sparkSession.range(1).select(F.xxhash64(F.lit(df.schema.json()))).first()[0]
    return f"{n:x}-{mixed & (1 << 64) - 1:016x}-{columns & (1 << 64) - 1:016x}"


def plan_digest(df: DataFrame) -> str:
    """A name for what a table's plan computes, whatever session writes it: numbers that a session gives to columns are left out."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return hashlib.sha256(re.sub(r"#\d+L?|(?<=[xyz])_\d+|@[0-9a-f]+", "", plan).encode()).hexdigest()[:16]
