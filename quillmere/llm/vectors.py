"""Nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import settle


@dataclass
class Codes:
    """One-bit codes of a block of vectors.

    bits: signs of the rotated unit residuals, packed. length: norms of the residuals. fit:
    inner products of unit residuals and their codes. offset: not kept, since the centre's
    inner product with a query is the query's own.
    """

    bits: np.ndarray
    length: np.ndarray
    fit: np.ndarray


@dataclass
class Rotation:
    """A random rotation and the centre that vectors are coded against."""

    matrix: np.ndarray
    centre: np.ndarray

    @staticmethod
    def make(dim: int, centre: np.ndarray, seed: int = 11) -> Rotation:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        return Rotation(q * np.sign(np.diag(r)), centre)

    def encode(self, vectors: np.ndarray) -> Codes:
        rest = vectors - self.centre
        length = np.linalg.norm(rest, axis=1)
        turned = rest @ self.matrix / np.where(length > 0, length, 1)[:, None]
        fit = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
        return Codes(np.packbits(turned > 0, axis=1), length, np.where(length > 0, fit, 1.0))

    def estimate(self, queries: np.ndarray, codes: Codes, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x vectors) and what they may be off by.

        A unit residual o with code x has <q, o> close to <q, x> / <o, x>; the error is at most
        width * |q| * sqrt((1 - <o, x>^2) / (<o, x>^2 (dim - 1))) with a chance that grows fast with width.
        """
        dim = len(self.centre)
        signs = np.unpackbits(codes.bits, axis=1, count=dim).astype(np.float32)
        turned = (queries @ self.matrix).astype(np.float32)
        product = (2 * (turned @ signs.T) - turned.sum(axis=1, keepdims=True)) / np.float32(np.sqrt(dim))
        scale = (codes.length / codes.fit).astype(np.float32)
        off = (width * codes.length * np.sqrt(np.maximum(1 - codes.fit**2, 0) / (codes.fit**2 * max(dim - 1, 1))) + 1e-5).astype(np.float32)
        return product * scale + (queries @ self.centre).astype(np.float32)[:, None], np.linalg.norm(queries, axis=1).astype(np.float32)[:, None] * off


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.add.accumulate(vectors * query, axis=1)[:, -1]


class TopK:
    """The best k so far of each query of a block: score descending, then smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, rotation: Rotation, width: float):
        self.ids, self.queries, self.k, self.rotation, self.width = ids, queries, k, rotation, width
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes) -> None:
        for at in range(0, len(self.ids), 128):
            part = slice(at, min(at + 128, len(self.ids)))
            guess, off = self.rotation.estimate(self.queries[part], codes, self.width)
            upper = guess + off
            for r, q in enumerate(range(part.start, part.stop)):
                self._merge(q, ids, vectors, guess[r], upper[r])

    def _merge(self, q: int, ids: np.ndarray, vectors: np.ndarray, guess: np.ndarray, upper: np.ndarray) -> None:
        query, (scores, found) = self.queries[q], self.best[q]
        floor = scores[-1] if len(scores) == self.k else -np.inf
        first = np.argpartition(-guess, 2 * self.k)[: 2 * self.k] if len(guess) > 2 * self.k else np.arange(len(guess))
        first = first[ids[first] != self.ids[q]]
        near = vectors[first] @ query
        if len(near) >= self.k:  # what k vectors reach for sure
            floor = max(floor, np.partition(near, -self.k)[-self.k])
        chosen = np.flatnonzero(upper >= floor - 1e-6)
        chosen = chosen[ids[chosen] != self.ids[q]]
        if not len(chosen):
            return
        near = vectors[chosen] @ query
        if len(chosen) > self.k:
            close = near >= max(floor, np.partition(near, -self.k)[-self.k]) - 1e-9 * (1 + abs(floor if np.isfinite(floor) else 0))
            chosen = chosen[close]
        scores, found = np.concatenate([scores, exact(vectors[chosen], query)]), np.concatenate([found, ids[chosen]])
        order = np.lexsort((found, -scores))[: self.k]
        self.best[q] = scores[order], found[order]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids, sizes), pa.int64()),
                pa.array(np.concatenate([f for _, f in self.best]) if sizes else np.zeros(0, np.int64), pa.int64()),
                pa.array(np.concatenate([s for s, _ in self.best]) if sizes else np.zeros(0), pa.float64()),
            ],
            ["query_id", "vec_id", "score"],
        )


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(table: DataFrame, is_query: Column, k: int = 20, width: float = 3.0, sample_rows: int = 10_000, shard_rows: int = 8192, block_queries: int = 8192, groups: int = 24) -> DataFrame:
    """The k nearest rows of each query row by inner product, as query_id, rank, vec_id, score.

    The rotation is fixed by a seed; the centre is the mean of at most `sample_rows` usable
    vectors (the first by xxhash64(vec_id)). Every usable vector is coded, in shards of
    `shard_rows`. Queries are dealt in blocks of about `block_queries`. Each task meets one
    block of queries and one of `groups` groups of shards, one shard at a time: it estimates all
    inner products from the codes, reranks on the original vectors each row whose upper bound
    reaches what k rows are known to reach, and keeps k for each query. No pair of rows is ever
    a row of a table: a task gives k rows for each query.

    Rows with a null vec_id, and vectors null, zero, holding null or non-finite components or
    of another length than most, take no part. vec_id names a row: rows that share one count as
    one row with the smallest vector (first component first), a query if one of them is; they
    are put together before vectors are dealt out. Fewer candidates than k give fewer rows. An empty table gives no rows. Other columns are
    not read.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    stats = {r[0]: (r[1], r[2]) for r in rows.groupBy(F.size("v")).agg(F.count(F.lit(1)), F.count_if("q")).collect()}  # one row for each length
    dim = max(stats, key=lambda d: (stats[d][0], d), default=1)
    n, n_queries = stats.get(dim, (0, 0))
    rows = rows.where(F.size("v") == dim)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow().column(0).combine_chunks()
    centre = np.asarray(drawn.flatten(), np.float64).reshape(-1, dim).mean(axis=0) if len(drawn) else np.zeros(dim)
    rotation = Rotation.make(dim, centre)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_queries))
    groups = min(groups, shards)

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), np.float64).reshape(-1, dim)

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, vec_id, v) sorted by shard to one row per shard; a shard is held at a time."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shard = None

        def blob() -> pa.RecordBatch:
            ids, vectors = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            codes = rotation.encode(vectors)
            columns = [shard, ids, vectors, codes.bits, codes.length, codes.fit]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns[1:]]], ["shard", "ids", "vectors", "bits", "length", "fit"])

        for rb in batches:
            own, ids, vectors = np.asarray(rb.column(0)), np.asarray(rb.column(1), np.int64), matrix(rb.column(2))
            for a in np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else []:
                b = a + np.searchsorted(own[a:], own[a], "right")
                if own[a] != shard:
                    if held:
                        yield blob()
                    shard, held = own[a], []
                held.append((ids[a:b], vectors[a:b]))
        if held:
            yield blob()

    kind = "shard int, ids binary, vectors binary, bits binary, length binary, fit binary"

    def packed(part: DataFrame, count: int) -> DataFrame:
        dealt = part.select(F.expr(f"cast(pmod(xxhash64(vec_id), {count}) as int)").alias("shard"), "vec_id", "v")
        return dealt.repartition(count, "shard").sortWithinPartitions("shard", "vec_id").mapInArrow(blobs, kind)

    index = settle(packed(rows, shards), "vectors")
    queries = settle(packed(rows.where("q"), blocks), "queries")
    left = queries.select(F.col("shard").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("kind"), "ids", "vectors", "bits", "length", "fit")
    right = index.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), (F.col("shard") % groups).alias("part"), F.lit(1).alias("kind"), "ids", "vectors", "bits", "length", "fit")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = key = None
        for rb in batches:
            for block, part, is_shard, ids, vectors, bits, length, fit in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
                if (block, part) != key:
                    if top:
                        yield top.rows()
                    key, top = (block, part), None
                if not is_shard:
                    top = TopK(ids, vectors, k, rotation, width)
                elif top:
                    top.add(ids, vectors, Codes(np.frombuffer(bits, np.uint8).reshape(len(ids), -1), np.frombuffer(length, np.float64), np.frombuffer(fit, np.float64)))
        if top:
            yield top.rows()

    found = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
