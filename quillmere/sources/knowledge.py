"""Knowledge documents as Markdown with a YAML head: paths, reading, writing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmere.schemas import schema

#: Folders and files below `knowledge` that hold no documents.
EXCLUDED_FOLDERS = ("_inbox", "_archive", "_inbox-skills", "assets", "_generated")
GENERATED_FILES = ("catalog.md", "index.md")


def relative_path(path: Column) -> Column:
    """The part of a path from the last folder `knowledge` on, with forward slashes."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"(knowledge/(?!.*/knowledge/).*)$", 1)


def is_discoverable(path: Column) -> Column:
    """A Markdown file below `knowledge`, in no excluded folder and not generated."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return F.startswith(path, F.lit("knowledge/")) & F.endswith(path, F.lit(".md")) & ~F.exists(parts, lambda p: p.isin(*EXCLUDED_FOLDERS)) & ~name.isin(*GENERATED_FILES)


def is_asset(path: Column) -> Column:
    return F.contains(path, F.lit("/assets/"))


def is_skill_draft(path: Column) -> Column:
    return F.contains(path, F.lit("/_inbox-skills/"))


def parse_document(text: str) -> dict:
    """Head and body of a document; dates become YYYY-MM-DD texts, the body loses blanks in front."""
    import datetime

    import yaml

    def plain(value):
        if isinstance(value, datetime.datetime):
            return value.isoformat()
        if isinstance(value, datetime.date):
            return value.isoformat()
        if isinstance(value, dict):
            return {str(k): plain(v) for k, v in value.items()}
        return [plain(v) for v in value] if isinstance(value, list) else value

    if not text.startswith("---"):
        raise ValueError("a document starts with a YAML head")
    head, _, body = text[3:].partition("\n---")
    out = plain(yaml.safe_load(head) or {})
    if out.get("schema_version", 2) != 2:
        raise ValueError("schema_version must be 2")
    return {**out, "body": body.partition("\n")[2].lstrip()}


def serialise_document(row: dict, names: list[str]) -> str:
    """The inverse of parse_document, keys in schema order."""
    import yaml

    head = {"schema_version": 2, **{k: row[k] for k in names if k not in ("body", "file_path") and row.get(k) is not None}}
    return f"---\n{yaml.safe_dump(head, allow_unicode=True, sort_keys=False)}---\n\n{row.get('body') or ''}"


def read_knowledge(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """All discoverable documents below `root`/knowledge as KNOWLEDGE rows.

    strict: a file that can't be parsed fails the read; else it comes with `parse_error` set.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(f"{root}/knowledge")
    files = files.select(F.col("value").alias("text"), relative_path(F.col("_metadata.file_path")).alias("file_path")).where(is_discoverable(F.col("file_path")))

    @F.pandas_udf("struct<json: string, error: string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((json.dumps(parse_document(t), ensure_ascii=False), None))
            except Exception as e:  # any malformed head is a parse error of its file
                out.append((None, str(e)[:500]))
        return pd.DataFrame(out, columns=["json", "error"])

    parsed = files.withColumn("_p", parse("text"))
    if strict:
        failed = F.when(F.col("_p.error").isNull(), True).otherwise(F.raise_error(F.concat(F.col("file_path"), F.lit(": "), F.col("_p.error"))).cast("boolean"))
        parsed = parsed.where(failed)
    shape = StructType([f for f in schema("knowledge").fields if f.name != "file_path"])
    rows = parsed.withColumn("_r", F.from_json("_p.json", shape))
    out = rows.select(*[F.col(f"_r.{f.name}") if f.name != "file_path" else F.col("file_path") for f in schema("knowledge").fields], F.col("_p.error").alias("parse_error"))
    return out.drop("parse_error") if strict else out


def to_markdown(df: DataFrame) -> DataFrame:
    """(file_path, text) of KNOWLEDGE rows."""

    names = schema("knowledge").fieldNames()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_path": b["file_path"], "text": [serialise_document(json.loads(j), names) for j in b["json"]]})

    return df.select("file_path", F.to_json(F.struct(*names)).alias("json")).mapInPandas(work, "file_path string, text string")
