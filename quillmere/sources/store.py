"""A store of rows whose commits are whole: a Spark data source with a two-phase writer.

    store.register(spark)
    df.write.format("quillmere-store").mode("append").option("path", place).save()
    spark.read.format("quillmere-store").option("path", place).load()

A store is a folder: parts/<write>/ with a Parquet file for each task, and manifests/<generation>.json.
A task writes its file and sends its name, rows, bytes and SHA-256; only when all tasks have, the
driver writes the next manifest, by a link that fails if that generation is there already. So a
reader sees all rows of a write or none, of two writers of one generation the second fails whole,
and a task that was killed, or ran twice, leaves a file that no manifest names, which the commit
takes away. `token`: a write of a token that a generation holds already adds nothing, so what is
run again is not written twice. Reading checks every file's SHA-256.

The folder is one that the driver and all executors share, by the path they all know it by.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

VERSION = 1
#: Rows that a reader holds at once, however many its file has; they may hold whole texts.
READ_ROWS = 1024


class StaleGeneration(RuntimeError):
    """Another writer has committed since this write began."""


def local(path: str) -> str:
    if re.match(r"[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        raise ValueError(f"a store lies in a folder that is mounted everywhere, not at {path}")
    return re.sub(r"^file:/+", "/", path).rstrip("/")


def generations(path: str) -> list[int]:
    try:
        return sorted(int(n[:-5]) for n in os.listdir(f"{local(path)}/manifests") if re.fullmatch(r"\d+\.json", n))
    except FileNotFoundError:
        return []


def manifest(path: str, generation: int | None = None) -> dict | None:
    """A generation's manifest, the newest if none is named; null where there is none."""
    every = generations(path)
    if not every or generation is not None and generation not in every:
        return None
    with open(f"{local(path)}/manifests/{generation or every[-1]:010d}.json") as f:
        return json.load(f)


def _put_once(place: str, body: str) -> None:
    """A file that appears whole, and only if it isn't there."""
    os.makedirs(os.path.dirname(place), exist_ok=True)
    draft = f"{place}.{uuid.uuid4().hex}"
    with open(draft, "w") as f:
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(draft, place)
    finally:
        os.unlink(draft)


@dataclass
class Sent(WriterCommitMessage):
    name: str | None
    rows: int
    size: int
    sha256: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.token = local(options["path"]), options.get("token")
        self.schema, self.overwrite = schema.json(), overwrite
        self.before = manifest(self.path)
        self.expected = int(options["generation"]) if "generation" in options else (self.before or {}).get("generation", 0)
        self.write_id = uuid.uuid4().hex
        if self.before and not overwrite and json.loads(self.before["schema"]) != json.loads(self.schema):
            raise ValueError("rows have other columns than the store")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Sent:
        """In a task: a file of its own, named by chance, so that a task run twice never meets itself."""
        folder, name = f"{self.path}/parts/{self.write_id}", f"{uuid.uuid4().hex}.parquet"
        out, rows = None, 0
        try:
            for batch in batches:
                if out is None:
                    os.makedirs(folder, exist_ok=True)
                    out = pq.ParquetWriter(f"{folder}/{name}", batch.schema, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        if out is None:
            return Sent(None, 0, 0, "")
        return Sent(f"{self.write_id}/{name}", rows, os.path.getsize(f"{folder}/{name}"), _sha256(f"{folder}/{name}"))

    def commit(self, messages: list[Sent | None]) -> None:
        if self.token and any(self.token in (manifest(self.path, g) or {}).get("tokens", []) for g in generations(self.path)[-1:]):
            self.abort(messages)
            return
        if generations(self.path)[-1:] not in ([], [self.expected]) or (self.expected and not generations(self.path)):
            self.abort(messages)
            raise StaleGeneration(f"the store has left generation {self.expected}")
        sent = [m for m in messages if m is not None and m.name]
        files = [{"name": m.name, "rows": m.rows, "bytes": m.size, "sha256": m.sha256} for m in sorted(sent, key=lambda m: m.name)]
        kept = [] if self.overwrite or not self.before else self.before["files"]
        tokens = [*(self.before or {}).get("tokens", []), *([self.token] if self.token else [])][-1000:]
        body = {"version": VERSION, "generation": self.expected + 1, "schema": self.schema, "rows": sum(f["rows"] for f in [*kept, *files]), "files": [*kept, *files], "tokens": tokens}
        named = {m.name.split("/")[1] for m in sent}
        for name in os.listdir(f"{self.path}/parts/{self.write_id}") if sent else ():
            if name not in named:  # of a task that was killed or lost a race
                os.unlink(f"{self.path}/parts/{self.write_id}/{name}")
        try:
            _put_once(f"{self.path}/manifests/{self.expected + 1:010d}.json", json.dumps(body, indent=1))
        except FileExistsError:
            self.abort(messages)
            raise StaleGeneration(f"generation {self.expected + 1} was written by another") from None

    def abort(self, messages: list[Sent | None]) -> None:
        shutil.rmtree(f"{self.path}/parts/{self.write_id}", ignore_errors=True)


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@dataclass
class File(InputPartition):
    name: str
    rows: int
    sha256: str


class Reader(DataSourceReader):
    """One task for each file of the generation that was newest when the read was planned."""

    def __init__(self, path: str, found: dict):
        self.path, self.files = path, [File(f["name"], f["rows"], f["sha256"]) for f in found["files"]]

    def partitions(self) -> list[InputPartition]:
        return self.files or [File("", 0, "")]

    def read(self, file: File) -> Iterator[pa.RecordBatch]:
        if not file.name:
            return
        place = f"{self.path}/parts/{file.name}"
        if not os.path.exists(place) or _sha256(place) != file.sha256:
            raise ValueError(f"{file.name} is missing or is not what was written")
        rows = 0
        for batch in pq.ParquetFile(place).iter_batches(READ_ROWS):
            rows += batch.num_rows
            yield batch
        if rows != file.rows:
            raise ValueError(f"{file.name} has {rows} rows, its manifest says {file.rows}")


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmere-store"

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def _found(self) -> dict:
        options = self._options()
        found = manifest(options["path"], int(options["generation"]) if "generation" in options else None)
        if not found:
            raise ValueError(f"no store, or not that generation, at {options['path']}")
        return found

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._found()["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(local(self._options()["path"]), self._found())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self._options(), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoreSource)


def write(df: DataFrame, path: str, token: str | None = None, generation: int | None = None, overwrite: bool = True) -> int:
    """Commit all rows of `df`; returns the generation that the store has then.

    generation: the one that the rows were made from (0: none); another writer's commit since
    then is an error and nothing is written.
    """
    register(df.sparkSession)
    options = {"path": path} | ({"token": token} if token else {}) | ({"generation": str(generation)} if generation is not None else {})
    df.write.format("quillmere-store").mode("overwrite" if overwrite else "append").options(**options).save()
    return generations(path)[-1]


def read(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    register(spark)
    options = {"path": path} | ({"generation": str(generation)} if generation is not None else {})
    return spark.read.format("quillmere-store").options(**options).load()


def sweep(path: str, keep: int = 2) -> list[str]:
    """Forget all but the newest `keep` generations, and take away files that none of those names: what killed drivers left.

    Not to be run beside a writer, whose files no manifest names yet.
    """
    place, every = local(path), generations(path)
    for g in every[:-keep]:
        os.unlink(f"{place}/manifests/{g:010d}.json")
    named = {f["name"] for g in every[-keep:] for f in manifest(path, g)["files"]}
    gone = []
    for folder, _, names in os.walk(f"{place}/parts", topdown=False):
        for name in names:
            key = os.path.relpath(f"{folder}/{name}", f"{place}/parts")
            if key not in named:
                os.unlink(f"{folder}/{name}")
                gone.append(key)
        if not os.listdir(folder) and folder != f"{place}/parts":
            os.rmdir(folder)
    return sorted(gone)
