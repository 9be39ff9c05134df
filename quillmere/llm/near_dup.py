"""MinHash near-duplicate detection with sequential Bayesian verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import discard, lean, mix64, settle, shingle_sets, slices, utf8, word_hashes
from quillmere.llm.components import components

_FOLD = mix64(np.arange(1, 1025, dtype=np.uint64))
#: Shingles that a set counts for besides its own.
SET_COST = 256
_XOR, _MUL = (_FOLD >> np.uint64(32)).astype(np.uint32), _FOLD.astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values of a set of 64-bit shingles."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        part = low[None, k : k + 2048] ^ _XOR[:hashes, None]
        part *= _MUL[:hashes, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` values; the band's number is part of it."""
    values = signatures.reshape(*signatures.shape[:-1], -1, rows).astype(np.uint64)
    keys = np.zeros(values.shape[:-1], np.uint64)
    for k in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + values[..., k])
    return mix64(keys + np.arange(1, keys.shape[-1] + 1, dtype=np.uint64) * _FOLD[512])


def least_matches(seen: int, threshold: float, miss: float) -> int:
    """Fewest equal values among `seen` with which a pair's similarity may still be high enough.

    Under a uniform prior the similarity after m of n equal values is Beta(m + 1, n - m + 1),
    so its chance to be at least t is that of at most m successes in n + 1 trials of chance t.
    A pair is dropped when that chance is below `miss`.
    """
    chance = 0.0
    for m in range(seen + 1):
        chance += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if chance >= miss:
            return m
    return seen


class Verifier:
    """Links within a group of sets: banded candidates, Bayesian pruning, exact check."""

    def __init__(self, numerator: int, denominator: int, bands: int, rows: int, miss: float, batch: int):
        self.numerator, self.denominator, self.rows, self.hashes, self.batch = numerator, denominator, rows, bands * rows, batch
        self.least = {n: least_matches(n, numerator / denominator, miss) for n in [*range(batch, self.hashes, batch), self.hashes]}

    def likely(self, size: np.ndarray, values: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i, j) that may still reach the threshold, and how many of their MinHash values are equal.

        values: MinHash values, or a byte of each: unequal values whose bytes agree only raise a
        pair's count, so no pair is lost by them.
        """
        short, long = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        keep = self.denominator * short >= self.numerator * long
        i, j = i[keep], j[keep]
        equal, done = np.zeros(len(i), np.int64), 0
        for seen, least in self.least.items():
            equal += (values[i, done:seen] == values[j, done:seen]).sum(axis=1)
            keep = equal >= least
            i, j, equal, done = i[keep], j[keep], equal[keep], seen
        return i, j, equal

    def forest(self, size: np.ndarray, values: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
        """A spanning forest of the likely pairs of a bucket; with `side`, of those between sides 0 and 1."""
        n = len(size)
        root, out = np.arange(n), []
        for at in range(0, n, 64):
            rows = np.arange(at, min(at + 64, n))
            open_ = (np.arange(n)[None, :] > rows[:, None]) & (root[rows][:, None] != root[None, :])
            if side is not None:
                open_ &= side[rows][:, None] != side[None, :]
            i, j = np.nonzero(open_)
            i, j, _ = self.likely(size, values, rows[i], j)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if root[x] != root[y]:
                    low, high = min(root[x], root[y]), max(root[x], root[y])
                    root[root == high] = low
                    out.append((x, y))
        return out

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.denominator * both >= self.numerator * (len(a) + len(b) - both)

    def links(self, sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A spanning forest of the links between `sets`; with `side`, of those between sides 0 and 1.

        A pair whose two ends are joined by earlier links is not checked again: it can change
        no component.
        """
        n = len(sets)
        size = np.array([len(s) for s in sets], np.int64)
        sigs = np.stack([signature(s, self.hashes) for s in sets])
        keys = band_keys(sigs, self.rows)
        root, out = np.arange(n), []
        for at in range(0, n, 64):
            rows = np.arange(at, min(at + 64, n))
            near = np.zeros((len(rows), n), bool)
            for k in range(keys.shape[1]):
                near |= keys[rows, k][:, None] == keys[None, :, k]
            near &= np.arange(n)[None, :] > rows[:, None]
            if side is not None:
                near &= side[rows][:, None] != side[None, :]
            i, j = np.nonzero(near)
            i = rows[i]
            keep = root[i] != root[j]
            i, j, equal = self.likely(size, sigs, i[keep], j[keep])
            order = np.argsort(-equal, kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                if root[x] != root[y] and self.linked(sets[x], sets[y]):
                    low, high = min(root[x], root[y]), max(root[x], root[y])
                    root[root == high] = low
                    out.append((x, y))
        return out


def near_duplicates(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100, bands: int = 35, rows: int = 5, miss: float = 1e-6, batch: int = 25, block_shingles: int = 100_000, bucket_rows: int = 512) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity >= numerator / denominator.

    1. One pass makes each document's set of `words`-word shingles, a digest of the set, a key
       for each of `bands` bands of `rows` MinHash values (the defaults miss a pair at the
       threshold with a chance of about 1e-6), and a byte of each MinHash value.
    2. Documents with equal sets are one class, stood for by its smallest doc_id; copies never
       go further.
    3. Classes that share a band key are candidates. Within each such bucket, pairs are compared
       `batch` bytes at a time and dropped once the chance that they reach the threshold is
       below `miss`; a forest over the pairs that are left is given on (no pairs are listed). A
       large bucket is dealt over blocks of `bucket_rows`, and each pair of blocks is a group.
       Clusters are the components of these forests, so chance collisions of unlike sets join
       nothing, however many rows there are.
    4. Only clustered documents' sets are made again and brought together, in blocks of about
       `block_shingles` shingles (a set counts as SET_COST more, so many short sets are several
       blocks too). A cluster of one block is one group. A larger one is dealt over blocks, and
       each pair of blocks is a group, so no group grows with a cluster and no pair is left out.
    5. Within a group, pairs that share a band are pruned in the same way on whole MinHash
       values; what is left is checked on the full sets unless it is joined already.
    6. The links (a spanning forest) make the components.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is
    component_id). A text without words, empty or null, has no shingles and is linked with
    nothing. A null doc_id has a null component and is kept. Rows with one doc_id count as one
    node. An empty table gives no rows. Other columns are not read.
    """
    verifier = Verifier(numerator, denominator, bands, rows, miss, batch)
    hashes = bands * rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, offsets = utf8(rb.column(1))
            for i, j in slices(offsets, 1 << 19):
                sets = shingle_sets(*word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), words)
                full = [s for s in sets if len(s)]
                values = np.stack([signature(s, hashes) for s in full]) if full else np.zeros((0, hashes), np.uint32)
                keys, bytes_of = band_keys(values, rows) if full else np.zeros((0, bands), np.uint64), iter(values.astype(np.uint8))
                ends = np.cumsum([bands if len(s) else 0 for s in sets])
                digest = [(s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s + np.uint64(0x632BE59BD9B4E019)))) if len(s) else (np.uint64(0), np.uint64(0)) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rb.column(0).slice(i, j - i),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_a": pa.array(np.array([x for x, _ in digest], np.uint64).view(np.int64)),
                        "set_b": pa.array(np.array([x for _, x in digest], np.uint64).view(np.int64)),
                        "bands": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(keys.ravel().view(np.int64))),
                        "values": pa.array([next(bytes_of).tobytes() if len(s) else None for s in sets], pa.binary()),
                    }
                )

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    sketched = settle(texts.mapInArrow(lean(sketch), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, values binary"), "sketch")
    classes = sketched.where("doc_id is not null and n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n"), F.first("bands").alias("bands"), F.first("values").alias("values"))
    classes = settle(classes, "classes")
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("bucket", F.ceil(F.col("_m") / bucket_rows).cast("int").alias("_blocks"))
    members = buckets.join(shared, "bucket").join(classes.select("rep", "n_shingles", "values"), "rep").withColumn("_own", F.expr("cast(pmod(xxhash64(rep), _blocks) as int)"))
    met = members.select("bucket", "rep", "n_shingles", "values", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    met = met.select("bucket", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), (F.col("_own") > F.col("_other")).alias("side"), "rep", "n_shingles", "values")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a batch waits for the next batch."""
        kept: list[np.ndarray] | None = None

        def likely(columns: list[np.ndarray]) -> pa.RecordBatch:
            *key, side, rep, size, values = columns
            new = np.ones(len(rep), bool)
            new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(rep))
            two = starts[(ends - starts == 2)]
            if len(two):
                two = two[(key[1][two] == key[2][two]) | (side[two] != side[two + 1])]
            i, j, _ = verifier.likely(size, values, two, two + 1)
            a, b = [rep[i]], [rep[j]]
            for x, y in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                pairs = np.array(verifier.forest(size[x:y], values[x:y], None if key[1][x] == key[2][x] else side[x:y]), np.int64).reshape(-1, 2) + x
                a.append(rep[pairs[:, 0]])
                b.append(rep[pairs[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

        for rb in batches:
            if not len(rb):
                continue
            own = [np.asarray(rb.column(k).cast(pa.int64())) for k in range(6)] + [np.frombuffer(b"".join(rb.column(6).to_pylist()), np.uint8).reshape(-1, hashes)]
            whole = own if kept is None else [np.concatenate([x, y]) for x, y in zip(kept, own, strict=True)]
            same = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1]) & (whole[2] == whole[2][-1])
            last = int(np.argmax(same))
            kept = [x[last:] for x in whole]
            if last:
                yield likely([x[:last] for x in whole])
        if kept is not None:
            yield likely(kept)

    likely_links = met.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "rep").mapInArrow(lean(prune), "a long, b long").distinct()
    clusters = components(likely_links, "clusters")
    member = clusters.join(classes.groupBy("rep").agg((F.sum("n_shingles") + SET_COST).alias("_size")), F.col("node") == F.col("rep")).select("node", "component", "_size")
    sizes = member.groupBy("component").agg(F.ceil(F.sum("_size") / block_shingles).cast("int").alias("_blocks"))
    member = settle(member.join(sizes, "component").select("node", F.col("component").alias("cluster"), "_blocks", F.expr("cast(pmod(xxhash64(node), _blocks) as int)").alias("_block")), "members")
    discard(clusters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's set, once for each group that it belongs to."""
        for rb in batches:
            data, offsets = utf8(rb.column(4))
            node, cluster, blocks, block = (rb.column(k).to_pylist() for k in range(4))
            for i, j in slices(offsets, 1 << 19):
                sets = shingle_sets(*word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), words)
                out: dict[str, list] = {k: [] for k in ("cluster", "lo", "hi", "side", "node", "shingles")}
                for r in range(i, j):
                    for other in range(blocks[r]):
                        lo, hi = min(block[r], other), max(block[r], other)
                        for k, v in zip(out, (cluster[r], lo, hi, int(block[r] == hi != lo), node[r], sets[r - i].tobytes()), strict=True):
                            out[k].append(v)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; one group is held at a time."""
        key, held = None, []

        def links() -> pa.RecordBatch:
            sets = [np.frombuffer(x[2], np.uint64) for x in held]
            side = None if key[1] == key[2] else np.array([x[0] for x in held])
            found = verifier.links(sets, side) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[x[k]][1] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for rb in batches:
            for row in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if row[:3] != key:
                    if held:
                        yield links()
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            yield links()

    groups = member.join(texts, F.col("node") == F.col("doc_id")).select("node", "cluster", "_blocks", "_block", "text").mapInArrow(lean(deal), "cluster long, lo int, hi int, side int, node long, shingles binary")
    links = groups.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node").mapInArrow(lean(verify), "a long, b long")
    links = settle(links, "links")
    joined = components(links, "components")
    copies = classes.where("_n > 1").select("n_shingles", "set_a", "set_b", "rep")
    own = sketched.drop("bands", "values").join(copies, ["n_shingles", "set_a", "set_b"], "left").withColumn("_rep", F.coalesce("rep", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "_rep"))
    found = own.join(joined, F.col("_rep") == F.col("node"), "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
    found = settle(found, "near")
    for table in (member, links, joined, classes, sketched):
        discard(table)
    return found
