"""Files as sources: probes, contents, exports with a manifest, links of pages."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.text import short_hash, strip_markup

_PROBE = "source_id string, external_key string, path_hash string, commit_sha string, revision string, etag string, opaque_version string, updated_at string, bytes long"


def probe_files(spark: SparkSession, folder: str, connector: str, pattern: str = "*") -> DataFrame:
    """One row for each file: id, key (path below the folder), size and time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    key = F.regexp_replace(F.replace(F.col("path"), F.lit(folder.rstrip("/") + "/"), F.lit("\0")), "^.*\0", "")
    rows = files.select(key.alias("external_key"), F.col("length").alias("bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"))
    opaque = F.concat_ws(":", F.col("bytes").cast("string"), "updated_at")
    none = F.lit(None).cast("string")
    return rows.select(short_hash("src_", 24, F.lit(connector), F.col("external_key")).alias("source_id"), "external_key", none.alias("path_hash"), none.alias("commit_sha"), none.alias("revision"), none.alias("etag"), opaque.alias("opaque_version"), "updated_at", "bytes")


def fetch_files(spark: SparkSession, folder: str, probes: DataFrame) -> DataFrame:
    """Contents of the probed files; `text` is null and `error` set where bytes are no UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    key = F.regexp_replace(F.replace(F.col("path"), F.lit(folder.rstrip("/") + "/"), F.lit("\0")), "^.*\0", "")
    rows = files.select(key.alias("external_key"), "content").join(probes.select("source_id", "external_key"), "external_key")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return rows.select("source_id", "external_key", F.when(valid, F.col("content").cast("string")).alias("text"), F.when(~valid, "not valid UTF-8").alias("error"), F.sha2("content", 256).alias("sha256"))


def probe_git(spark: SparkSession, repository: str, ref: str, connector: str, project: str = "") -> DataFrame:
    """One row for each file of a tree at a ref, its version the blob's hash; only the tree is listed, on the driver."""
    if ref.startswith("-"):
        raise ValueError(f"no ref: {ref}")
    listed = subprocess.run(["git", "-C", repository, "ls-tree", "-r", "-l", "-z", ref], capture_output=True, check=True).stdout.decode()
    rows = []
    for entry in filter(None, listed.split("\0")):
        head, _, path = entry.partition("\t")
        mode, kind, sha, size = head.split()
        if kind == "blob" and mode != "120000":
            rows.append((path, sha, int(size)))
    tree = spark.createDataFrame(rows, "external_key string, path_hash string, bytes long")
    none = F.lit(None).cast("string")
    return tree.select(short_hash("src_", 24, F.lit(connector), F.lit(project), F.col("external_key")).alias("source_id"), "external_key", "path_hash", none.alias("commit_sha"), none.alias("revision"), none.alias("etag"), none.alias("opaque_version"), none.alias("updated_at"), "bytes")


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of an export: manifest.json (version 2) lists path and sha256; paths that leave the folder are refused."""
    schema = "version int, documents array<struct<id: string, path: string, title: string, sha256: string>>"
    listed = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/manifest.json").select("version", F.inline("documents"))
    inside = ~F.startswith("path", F.lit("/")) & ~F.exists(F.split("path", "/"), lambda p: p == "..")
    listed = listed.where(F.when(F.col("version") != 2, F.raise_error(F.lit("export version must be 2")).cast("boolean")).when(~inside, F.raise_error(F.concat(F.lit("path leaves the export: "), F.col("path"))).cast("boolean")).otherwise(True))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    key = F.regexp_replace(F.replace(F.col("path"), F.lit(folder.rstrip("/") + "/"), F.lit("\0")), "^.*\0", "")
    found = files.select(key.alias("path"), "content")
    status = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("sha256"), "hash differs").otherwise("ok")
    return listed.join(found, "path", "left").select("id", "path", "title", status.alias("status"), F.when(status == "ok", F.col("content").cast("string")).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links of pages (page_id, html): href and text, in order."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(?:.*?)</a>"""), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("position", "_a"))
    return rows.select("page_id", "position", F.regexp_extract("_a", r"""(?is)href\s*=\s*["']([^"']*)["']""", 1).alias("href"), strip_markup(F.col("_a")).alias("text"))
