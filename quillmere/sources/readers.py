"""Spark data sources for folders and git trees: listing and reading are dealt over tasks.

    readers.register(spark)
    spark.read.format("quillmere-files").option("path", folder).load()
    spark.read.format("quillmere-git").option("path", repository).option("ref", "main").load()

A row is a file: external_key, path_hash, updated_at, bytes, content, error. Options: `content`
(true to read contents), `include` (globs, one a line, matched against the key), `prefix` (keys
below it only), `tasks` (how many parts to plan at least, if there are so many folders).
The driver lists folders only until there are enough of them; a task lists what lies below its
own and reads it file by file.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "external_key string, path_hash string, updated_at string, bytes long, content binary, error string"
_ARROW = pa.schema([("external_key", pa.string()), ("path_hash", pa.string()), ("updated_at", pa.string()), ("bytes", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Bytes of contents and rows that a batch may hold.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


@dataclass
class Part(InputPartition):
    """Folders to be listed whole, and single files: (key, what they are found by)."""

    folders: tuple[tuple[str, str], ...]
    files: tuple[tuple[str, str], ...]


def _matcher(globs: str | None, prefix: str):
    """Whether a key is wanted: `**/` is any number of folders, `*` stays in one."""
    tests = [re.compile("".join("(?:.*/)?" if p == "**/" else ".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.split(r"(\*\*/|\*\*|\*|\?)", g.strip()))) for g in (globs or "").split("\n") if g.strip()]
    return lambda key: key.startswith(prefix) and (not tests or any(t.fullmatch(key) for t in tests))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Reader(DataSourceReader):
    """What both sources share: planning folders and files in parts. A folder below `prefix` or above it is opened, no other."""

    def __init__(self, options: dict[str, str]):
        self.path = re.sub(r"^file:/+", "/", options["path"])
        self.prefix, self.with_content = options.get("prefix", ""), options.get("content", "false").lower() == "true"
        self.wanted = _matcher(options.get("include"), self.prefix)
        self.tasks = int(options.get("tasks", "64"))

    def children(self, key: str, found_by: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
        """Folders and files right below a folder."""
        raise NotImplementedError

    def root(self) -> tuple[str, str]:
        raise NotImplementedError

    def leads_on(self, key: str) -> bool:
        return key.startswith(self.prefix) or self.prefix.startswith(key)

    def partitions(self) -> list[InputPartition]:
        folders, files = [self.root()], []
        while folders and len(folders) < self.tasks:  # widen level by level until there are enough
            deeper: list[tuple[str, str]] = []
            for key, found_by in folders:
                more, own = self.children(key, found_by)
                deeper += [f for f in more if self.leads_on(f[0])]
                files += [f for f in own if self.wanted(f[0])]
            folders = deeper
        count = max(1, min(self.tasks, len(folders) + -(-len(files) // 100)))
        return [Part(tuple(folders[k::count]), tuple(files[k::count])) for k in range(count)]

    def walk(self, part: Part) -> Iterator[tuple[str, str]]:
        yield from part.files
        left = list(part.folders)
        while left:
            more, own = self.children(*left.pop())
            left += [f for f in more if self.leads_on(f[0])]
            yield from (f for f in own if self.wanted(f[0]))


class FilesReader(_Reader):
    def root(self) -> tuple[str, str]:
        return "", self.path

    def children(self, key: str, found_by: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
        with os.scandir(found_by) as entries:
            own = sorted((e.name, e.path, e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)) for e in entries)
        return [(f"{key}{n}/", p) for n, p, folder, _ in own if folder], [(key + n, p) for n, p, _, file in own if file]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, path in self.walk(part):
                try:
                    stat, content = os.stat(path), None
                    if self.with_content:
                        with open(path, "rb") as f:
                            content = f.read()
                    time = datetime.fromtimestamp(stat.st_mtime_ns // 1_000_000 / 1000, UTC)
                    yield key, None, time.strftime("%Y-%m-%dT%H:%M:%S.") + f"{time.microsecond // 1000:03d}Z", stat.st_size, content, None
                except OSError as e:  # one file that can't be read doesn't end the rest
                    yield key, None, None, None, None, f"{type(e).__name__}: {os.strerror(e.errno) if e.errno else e}"

        yield from _batches(rows())


class GitReader(_Reader):
    """A tree at a ref: the commit is settled when parts are planned, so all tasks read one snapshot. Links and submodules are no files."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        ref = options.get("ref", "HEAD")
        if ref.startswith("-"):
            raise ValueError(f"no ref: {ref}")
        self.tree = self.git("rev-parse", "--verify", "--quiet", f"{ref}^{{tree}}").decode().strip()

    def git(self, *args: str) -> bytes:
        done = subprocess.run(["git", "-C", self.path, *args], capture_output=True)
        if done.returncode:
            raise ValueError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip() or args[-1]}")
        return done.stdout

    def root(self) -> tuple[str, str]:
        return "", self.tree

    def children(self, key: str, found_by: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
        folders, files = [], []
        for entry in filter(None, self.git("ls-tree", "-z", found_by).decode(errors="replace").split("\0")):
            head, _, name = entry.partition("\t")
            mode, kind, sha = head.split()
            if kind == "tree":
                folders.append((f"{key}{name}/", sha))
            elif kind == "blob" and mode != "120000":
                files.append((key + name, sha))
        return folders, files

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """One `cat-file` process a task answers blob by blob."""
        ask = subprocess.Popen(["git", "-C", self.path, "cat-file", "--batch" if self.with_content else "--batch-check"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

        def rows() -> Iterator[tuple]:
            for key, sha in self.walk(part):
                ask.stdin.write(f"{sha}\n".encode())
                ask.stdin.flush()
                answer = ask.stdout.readline().split()
                if answer[-1:] == [b"missing"] or len(answer) < 3:
                    yield key, sha, None, None, None, "blob is missing"
                    continue
                size = int(answer[2])
                content = ask.stdout.read(size + 1)[:size] if self.with_content else None
                yield key, sha, None, size, content, None

        try:
            yield from _batches(rows())
        finally:
            ask.stdin.close()
            ask.stdout.close()
            ask.wait()


class _Source(DataSource):
    reader_of: type[_Reader]

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return self.reader_of({k.lower(): v for k, v in self.options.items()})


class FilesSource(_Source):
    reader_of = FilesReader

    @classmethod
    def name(cls) -> str:
        return "quillmere-files"


class GitSource(_Source):
    reader_of = GitReader

    @classmethod
    def name(cls) -> str:
        return "quillmere-git"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session; doing so again changes nothing."""
    for source in (FilesSource, GitSource):
        spark.dataSource.register(source)
