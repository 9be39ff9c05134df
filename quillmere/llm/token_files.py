"""Token ids of documents in files of coded blocks, written in order of doc_id and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.llm import range_coder
from quillmere.llm.common import settle
from quillmere.llm.tokens import words_of

#: A row is a block: ids of whole documents, coded by range_coder.encode(). `before`: ids of the same file's blocks before it.
BLOCKS = "file long, block long, before long, n_ids long, doc_ids array<long>, n_tokens array<long>, body binary"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, block_ids: int = 1 << 20) -> DataFrame:
    """Blocks of the ids of `docs` (doc_id, text), each document's ended by `end_id`, in ascending doc_id order.

    Documents are dealt by ranges of doc_id, a range to a file; rows of one doc_id are in order
    of their text's hash and, if they are equal, as they come, and may be dealt over files, so no
    doc_id is too large for a task. The last block of a file aside, a block has `block_ids` ids
    or more: the documents that reach that number. A task holds one block at a time. A null
    doc_id comes first; a null or empty text is `end_id` alone. An empty table gives no rows.
    Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Four times the words of the default: fewer are met anew. An executor of two workers had 2,290 MB with them, 1,923 MB with the default.
        words, file = words_of(tokenizer_path, end_id, keep=1_600_000, keep_bytes=1 << 24), TaskContext.get().partitionId()
        vocabulary = max(words.tokenizer.get_vocab_size(), end_id + 1)
        keys: list = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        held = block = before = 0

        def emit() -> pa.RecordBatch:
            nonlocal keys, sizes, parts, held, block, before
            body = range_coder.encode(np.concatenate(parts), vocabulary)
            row = {"file": file, "block": block, "before": before, "n_ids": held, "doc_ids": keys, "n_tokens": sizes, "body": body}
            kinds = {"doc_ids": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()), "body": pa.binary()}
            out = pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})
            keys, sizes, parts, held, block, before = [], [], [], 0, block + 1, before + held
            return out

        for batch in batches:
            for at, ids, offsets in words.encode(batch.column(1)):
                own, done = batch.column(0).slice(at, len(offsets) - 1).to_pylist(), 0
                while done < len(own):  # up to the document with which the block is full
                    stop = min(int(np.searchsorted(offsets, offsets[done] + block_ids - held)), len(own))
                    keys += own[done:stop]
                    sizes += np.diff(offsets[done : stop + 1]).tolist()
                    parts.append(ids[offsets[done] : offsets[stop]])
                    held += int(offsets[stop] - offsets[done])
                    done = stop
                    if held >= block_ids:
                        yield emit()
        if keys:
            yield emit()

    order = (F.col("doc_id").asc(), F.xxhash64("text"), F.monotonically_increasing_id())
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(work, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_ids: int = 1 << 20) -> None:
    """encode_documents() as files under `path`."""
    encode_documents(docs, tokenizer_path, end_id, block_ids).write.parquet(path)


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with `first`: the ids of all blocks before them. Only sums of files, of which there are as many as partitions were written, are put in one order."""
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(files), "file").withColumn("first", F.col("base") + F.col("before"))


def documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of blocks as they were written: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    Every block is decoded and held against its checksums; a damaged one is an error.
    """
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first, doc_ids, n_tokens, body = (batch.column(k)[row] for k in range(4))
                ids = range_coder.decode(body.as_buffer().to_pybytes())
                sizes = np.asarray(n_tokens.values, np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("block is damaged: its documents' sizes differ from its ids")
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                out = [doc_ids.values, pa.array(first.as_py() + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return _placed(blocks).select("first", "doc_ids", "n_tokens", "body").mapInArrow(work, kind)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """documents() of the files under `path`."""
    return documents(spark.read.schema(BLOCKS).parquet(path), with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents to the shared folder, read the files back and tell where each document stands and what its ids are.

    The files stay until the application ends, as the result is read from them.
    """
    return documents(settle(encode_documents(docs, tokenizer_path, end_id), "tokens"))
