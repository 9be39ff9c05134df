"""Shared plumbing of the training-data operators: shared storage, table reading, word hashing."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillmere import storage
from quillmere.storage import discard, shared_dir

__all__ = ["discard", "shared_dir"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name) if hasattr(public_tokenizers, "path") else os.path.join("/opt/tokenizers", name)


# --------------------------------------------------------------------------- memory of executors

#: Rows that a task and its worker process hand each other at once, at most, while settle() writes.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What tasks of this worker process have left for later ones of their kind, by whose it is.
kept_by_worker: dict[str, dict] = {}


def settle(df: DataFrame, label: str) -> DataFrame:
    """storage.settle(), with whole texts in small batches: executors hold each batch in both processes."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        conf.set(_BATCH, BATCH_ROWS)
    try:
        return storage.settle(df, label)
    finally:
        conf.set(_BATCH, before)


def give_back() -> None:
    """Return what this process no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _begin(keeps: str | None) -> None:
    for kind in kept_by_worker.keys() - {keeps}:
        kept_by_worker[kind].clear()
    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; else it rises with the largest array
        libc.mallopt(-1, 1 << 24)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` for a worker process that serves many operators in turn and lives as long as its executor.

    What tasks of other kinds than `keeps` left in the process goes before, and unused memory
    goes back after; large arrays go back as soon as they are freed.
    """

    @wraps(work)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keeps)
        try:
            yield from work(batches)
        finally:
            give_back()

    return task


# --------------------------------------------------------------------------- UTF-8 buffers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# --------------------------------------------------------------------------- hashing, wrap-around 64 bit

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("pow", _BASE), ("inv", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[key] = np.multiply.accumulate(steps)
    return _tables["pow"][:n], _tables["inv"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit values (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(fold_case: bool) -> np.ndarray:
    key = f"values{fold_case}"
    if key not in _tables:
        codes = np.arange(256, dtype=np.uint64)
        if fold_case:
            codes[65:91] += np.uint64(32)
        _tables[key] = mix64(codes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))
    return _tables[key]


def prefix_sums(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """P[i] = sum of value(byte j) * base^j for j < i, modulo 2^64; length n + 1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(fold_case)[data] * _powers(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal spans have equal hashes wherever they stand."""
    inverse = _powers(len(sums))[1]
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and each row's first word (n + 1)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return span_hashes(prefix_sums(data, fold_case=True), starts, ends), np.searchsorted(starts, offsets)


#: Odd multipliers, one for each place in a shingle.
_PLACES = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its `size`-word shingles.

    A row with fewer words has one: its whole sequence; a row without words has none.
    """
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * _PLACES[k]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = (words[a:b] * _PLACES[32 : 32 + b - a]).sum(dtype=np.uint64)
            out.append(mix64(np.array([short + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
