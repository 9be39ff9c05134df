"""Hard negatives by a Voronoi-partitioned exact nearest-neighbour join on inner products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import settle

_LOWEST = np.iinfo(np.int64).min


@dataclass
class Space:
    """Pivots and a sample of rows, and what turns inner products into distances.

    A row x becomes (x, sqrt(most - |x|^2)) and an anchor a becomes (a, 0), so that their squared
    distance is |a|^2 + most - 2<a, x>: the largest inner product is the least distance.
    """

    pivots: np.ndarray
    sample: np.ndarray
    sample_labels: np.ndarray
    most: int  # largest squared norm
    exact: bool  # inner products are exact in double precision

    def raised(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        return np.column_stack([rows, np.sqrt(np.maximum(self.most - (rows * rows).sum(axis=1), 0))])

    def distances(self, raised: np.ndarray) -> np.ndarray:
        """To every pivot."""
        square = (raised**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * raised @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def products(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.rint(anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        return anchors.astype(np.int64) @ rows.astype(np.int64).T

    def reach(self, anchors: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Anchors x cells: what the inner product with a row of the cell is at most."""
        far = self.distances(np.column_stack([anchors.astype(np.float64), np.zeros(len(anchors))]))
        scale = (anchors.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.most
        return (scale - np.maximum(far - radius[None] - 1e-6 * (1 + far), 0) ** 2) / 2 + 1e-9 * scale + 1


@dataclass
class Anchors:
    """A block of anchors. floor and ceiling (one column for each search): inclusive bounds of a score."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    same: bool
    keep: int
    floor: np.ndarray
    ceiling: np.ndarray

    def __post_init__(self) -> None:
        self.best: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 for _ in range(self.floor.shape[1])]  # anchor, score, id

    def add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, space: Space) -> None:
        """Meet a chunk of rows; keep the best of each anchor and search."""
        order = np.argsort(ids, kind="stable")
        ids, labels, scores = ids[order], labels[order], space.products(self.rows, rows[order])
        fits = (self.labels[:, None] == labels[None]) == self.same
        for k, held in enumerate(self.best):
            own = fits & (scores >= self.floor[:, k, None]) & (scores <= self.ceiling[:, k, None])
            at, column = self._first(own, scores)
            merged = tuple(np.concatenate(x) for x in zip(held, (at, scores[at, column], ids[column]), strict=True))
            order = np.lexsort((merged[2], -merged[1], merged[0]))
            anchor = merged[0][order]
            begins = np.searchsorted(anchor, anchor, "left")
            order = order[np.arange(len(order)) - begins < self.keep]
            self.best[k] = tuple(x[order] for x in merged)

    def _first(self, own: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors and columns of each anchor's best `keep` of a chunk whose columns are in order of id."""
        many = np.flatnonzero(own.sum(axis=1) > self.keep)
        own = own.copy()
        for a in many:
            columns = np.flatnonzero(own[a])
            own[a, columns[np.argsort(-scores[a, columns], kind="stable")[self.keep :]]] = False
        return np.nonzero(own)


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


_INDEX = "cell int, radius double, ids binary, labels binary, rows binary"
_BLOCK = "block long, ids binary, labels binary, rows binary"


def hard_negatives(table: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (4, 5), pivots: int = 256, sample_rows: int = 10_000, chunk_rows: int = 4096, block_anchors: int = 1024, parts: int = 24) -> DataFrame:
    """Hard negatives of `table` (vec_id, embedding, label): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x) and a score is the inner product with the anchor. An anchor's
    positives are its `positives` best other rows of its label; a positive's negatives are the
    `negatives` best rows of other labels that score at most what the positive does and at least
    the fraction `least` of that. Ties go to the smaller vec_id.

    Both joins are exact and run alike. Every row lies in the Voronoi cell of its nearest pivot
    (rows of a sample of at most `sample_rows`, the first by hash); a cell is cut into chunks of at
    most `chunk_rows`, so a full cell is many chunks. Anchors are dealt in blocks of at most
    `block_anchors` that lie near each other. An anchor's best rows of the sample tell what its
    last neighbour scores at least; a cell goes to a block only if, by the triangle inequality,
    a row in it could score that much with an anchor of the block. A task meets one block with the
    chunks of one of `parts` parts, one chunk at a time, and gives no more rows than are kept.

    Rows with a null vec_id or label, with a vector that is null, holds null or non-finite
    components or has another length than most, take no part. Rows that share a vec_id are rows
    of their own, and as anchors have answers of their own. So that scores fit into 64 bits, larger
    components count as the largest that make them fit. An empty table or one without anchors
    gives no rows. Other columns are not read.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.when(x == F.lit(_LOWEST), F.lit(-(_LOWEST + 1))).otherwise(F.abs(x))))).alias("most")).collect()  # one row for each length
    dim, _, largest = max(lengths, key=lambda r: (r[1], r[0]), default=(0, 0, 0))
    clamp = isqrt(((1 << 63) - 1) // max(dim, 1))
    largest = min(largest or 0, clamp)
    rows = rows.where(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: F.least(F.greatest(x, F.lit(-clamp)), F.lit(clamp))))
    kind = np.dtype("<i4") if largest < 1 << 31 else np.dtype("<i8")

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)

    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0] or 0.0
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(sample_rows).select("v", "label").toArrow()
    sample = matrix(drawn.column(0).combine_chunks()) if len(drawn) else np.zeros((0, dim), np.int64)
    space = Space(np.zeros((0, dim + 1)), sample.astype(kind), np.asarray(drawn.column(1), np.int64), float(most) * (1 + 1e-12), dim * largest**2 < 1 << 53)
    space.pivots = space.raised(np.unique(sample[:pivots], axis=0))

    # --- rows in cells, cells in chunks

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                far = space.distances(space.raised(matrix(rb.column(2))))
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell]), *rb.columns], ["cell", "far", "vec_id", "label", "v"])

    def runs(keys: np.ndarray, most_rows: int) -> Iterator[slice]:
        ends = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip(np.append(0, ends), np.append(ends, len(keys)), strict=True):
            yield from (slice(at, min(at + most_rows, b)) for at in range(a, b, most_rows))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                cell, far, ids, labels, v = np.asarray(rb.column(0)), np.asarray(rb.column(1)), np.asarray(rb.column(2), np.int64), np.asarray(rb.column(3), np.int64), matrix(rb.column(4)).astype(kind)
                cut = list(runs(cell, chunk_rows))
                blobs = ([x[s].tobytes() for s in cut] for x in (ids, labels, v))
                yield pa.RecordBatch.from_arrays([pa.array([cell[s.start] for s in cut], pa.int32()), pa.array([far[s].max() for s in cut]), *(pa.array(b, pa.binary()) for b in blobs)], ["cell", "radius", "ids", "labels", "rows"])

    dealt = rows.select("vec_id", "label", "v").mapInArrow(cells, "cell int, far double, vec_id long, label long, v array<long>").repartitionByRange("cell", F.xxhash64("vec_id", "label", "v")).sortWithinPartitions("cell")
    index = settle(dealt.mapInArrow(chunks, _INDEX), "cells")
    radius = np.full(len(space.pivots), -1.0)
    for cell, far in index.groupBy("cell").agg(F.max("radius")).collect():  # one row for each pivot at most
        radius[cell] = far

    # --- anchors in blocks

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                v = matrix(rb.column(2)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(space.distances(np.column_stack([v, np.zeros(len(v))])).argmin(axis=1), pa.int32()), *rb.columns], ["cell", "vec_id", "label", "v"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for rb in batches:
            for at in range(0, rb.num_rows, block_anchors):
                part = rb.slice(at, block_anchors)
                blobs = (np.asarray(part.column(1), np.int64), np.asarray(part.column(2), np.int64), matrix(part.column(3)).astype(kind))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["block", "ids", "labels", "rows"])
                number += 1

    own = rows.where("anchor").select("vec_id", "label", "v").mapInArrow(near, "cell int, vec_id long, label long, v array<long>")
    few = max(1, min(-(-own.count() // block_anchors), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    anchors = settle(own.repartitionByRange(few, "cell", F.xxhash64("vec_id", "label", "v")).sortWithinPartitions("cell").mapInArrow(blocks, _BLOCK), "anchors")

    def block_of(ids: bytes, labels: bytes, body: bytes, bounds: list | None) -> Anchors:
        """bounds: (anchor, search, score) of its positives; none while they are looked for."""
        ids, labels, body = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(body, kind).reshape(-1, dim)
        if bounds is None:
            shape = (len(ids), 1)
            return Anchors(ids, labels, body, True, positives + 1, np.full(shape, _LOWEST), np.full(shape, np.iinfo(np.int64).max))
        floor, ceiling = np.full((len(ids), positives), 1), np.full((len(ids), positives), 0)  # nothing lies between
        for b in bounds:
            if b["score"] >= 0:
                floor[b["anchor"], b["search"]], ceiling[b["anchor"], b["search"]] = -(-b["score"] * least[0] // least[1]), b["score"]
        return Anchors(ids, labels, body, False, negatives, floor, ceiling)

    def join(blocks: DataFrame) -> DataFrame:
        """The best rows of each anchor and search: block, anchor (its place there), anchor_id, own (its score with itself), search, score, vec_id."""

        def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                for block, *rest in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                    part = block_of(*rest)
                    part.add(np.zeros(len(space.sample), np.int64), space.sample_labels, space.sample, space)
                    floor = part.floor.astype(np.float64)
                    for k, (at, score, _) in enumerate(part.best):
                        for a in np.flatnonzero(np.bincount(at, minlength=len(part.ids)) == part.keep):
                            floor[a, k] = max(floor[a, k], score[at == a].min())
                    floor[part.floor > part.ceiling] = np.inf
                    cells = np.flatnonzero((space.reach(part.rows, radius) >= floor.min(axis=1)[:, None]).any(axis=0) & (radius >= 0))
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(cells), pa.int64()), pa.array(cells, pa.int32())], ["block", "cell"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = key = None

            def found() -> pa.RecordBatch:
                n = [len(b[0]) for b in part.best]
                at, score, ids = (np.concatenate([b[k] for b in part.best]) for k in range(3))
                own = np.array([space.products(x[None], x[None])[0, 0] for x in part.rows], np.int64)
                columns = [np.full(len(at), key[0]), at, part.ids[at], own[at], np.repeat(np.arange(len(n)), n), score, ids]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "anchor", "anchor_id", "own", "search", "score", "vec_id"])

            for rb in batches:
                for block, place, is_chunk, ids, labels, body, bounds in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                    if (block, place) != key:
                        if part:
                            yield found()
                        key, part = (block, place), None
                    if not is_chunk:
                        part = block_of(ids, labels, body, bounds)
                    else:
                        part.add(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(body, kind).reshape(-1, dim), space)
            if part:
                yield found()

        pairs = blocks.select("block", "ids", "labels", "rows", "bounds").mapInArrow(need, "block long, cell int")
        place = F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")
        right = pairs.join(index, "cell").select("block", place.alias("place"), F.lit(1).alias("is_chunk"), "ids", "labels", "rows", F.lit(None).cast(bounds_type).alias("bounds"))
        left = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("place"), F.lit(0).alias("is_chunk"), "ids", "labels", "rows", "bounds")
        met = left.unionByName(right).repartition("block", "place").sortWithinPartitions("block", "place", "is_chunk")
        return met.mapInArrow(search, "block long, anchor long, anchor_id long, own long, search long, score long, vec_id long")

    bounds_type = "array<struct<anchor: bigint, search: bigint, score: bigint>>"
    best = Window.partitionBy("block", "anchor").orderBy(F.col("score").desc(), "vec_id")
    itself = (F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    met = join(anchors.withColumn("bounds", F.lit(None).cast(bounds_type)))
    met = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives + 1)
    met = met.withColumn("self", F.min(F.when(itself, F.col("place"))).over(Window.partitionBy("block", "anchor"))).where("self is null or place <> self")
    found = met.withColumn("search", (F.row_number().over(best) - 1).cast("long")).where(F.col("search") < positives)
    found = settle(found.select("block", "anchor", "anchor_id", "search", "score", "vec_id"), "positives")
    bounds = found.groupBy("block").agg(F.collect_list(F.struct("anchor", "search", "score")).alias("bounds"))  # as many as a block has anchors, times positives
    closest = Window.partitionBy("block", "anchor", "search").orderBy(F.col("score").desc(), "vec_id")
    hard = join(anchors.join(bounds, "block")).withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= negatives)
    named = found.select("block", "anchor", "search", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, ["block", "anchor", "search"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted(table: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """`table` with the label of each vec_id that `every` divides moved on by one."""
    moved = (F.col("label").cast("long") + 1) % labels
    return table.select("vec_id", "embedding", F.when(F.col("vec_id") % every == 0, moved).otherwise(F.col("label").cast("long")).alias("label"))
