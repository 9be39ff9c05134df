"""Removal of long repeats: sparse suffix arrays kept as a logarithmic index family."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import discard, lean, mix64, prefix_sums, settle, slices, span_hashes, utf8

#: Bytes of the seed at a block's anchor.
SEED = 20
_POSITION = np.uint64((1 << 24) - 1)
_LAST = (1 << 63) - 1


@dataclass
class Blocks:
    """Blocks of consecutive windows with one anchor, of one text or several laid end to end.

    A window is `span` bytes; its anchor is the leftmost of its seeds with the smallest hash, so
    equal windows have equal anchors. first, last: first window of a block and the one after its
    last. seed: 40 bits of the hash of the anchor's seed. deal: further bits of it. body: hash of
    all bytes that the block's windows cover and of where the anchor stands in them.
    """

    first: np.ndarray
    last: np.ndarray
    seed: np.ndarray
    deal: np.ndarray
    body: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray, span: int) -> Blocks:
        parts = [Blocks._piece(data, offsets, a, b, span) for a, b in _pieces(offsets, span)]
        return Blocks(*(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64 if k < 2 else np.uint64) for k in range(5)))

    @staticmethod
    def _piece(data: np.ndarray, offsets: np.ndarray, low: int, high: int, span: int) -> tuple[np.ndarray, ...]:
        """Blocks of the windows that lie in [low, high), fewer than 2^24 bytes."""
        part = np.ascontiguousarray(data[low:high])
        n = len(part)
        seeds = span - SEED + 1
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        word = np.ndarray((n,), "<u8", padded, strides=(1,))
        seed = mix64(word[: n - SEED + 1] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(word[8 : n - SEED + 9] + (word[SEED - 8 : n - 7] << np.uint64(17))))
        least = (seed & ~_POSITION) | np.arange(len(seed), dtype=np.uint64)
        size = 1
        while 2 * size <= seeds:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < seeds:
            least = np.minimum(least[: len(least) - (seeds - size)], least[seeds - size :])
        whole = np.zeros(n + 1, np.int32)  # windows that cross no end of a text
        starts, ends = np.clip(offsets[:-1], low, high) - low, np.clip(offsets[1:], low, high) - low
        fits = ends - starts >= span
        np.add.at(whole, starts[fits], 1)
        np.add.at(whole, ends[fits] - span + 1, -1)
        at = np.flatnonzero(np.cumsum(whole[: len(least)]))
        anchor = (least[at] & _POSITION).astype(np.int64)
        change = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1)) + 1
        first = at[np.concatenate([[0], change])] if len(at) else at
        last = at[np.concatenate([change - 1, [len(at) - 1]])] + 1 if len(at) else at
        anchor = anchor[np.concatenate([[0], change])] if len(at) else anchor
        body = mix64(span_hashes(prefix_sums(part), first, last + span - 1) + (anchor - first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        own = mix64(seed[anchor])
        return first + low, last + low, own >> np.uint64(24), own & _POSITION, body


def _pieces(offsets: np.ndarray, span: int, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Byte ranges of whole texts, of at most `limit` bytes; a longer text in pieces that share span - 1 bytes."""
    for i, j in slices(offsets, limit):
        low, high = int(offsets[i]), int(offsets[j])
        while high - low > limit + span:
            yield low, low + limit + span - 1
            low += limit
        if high - low >= span:
            yield low, high


# --------------------------------------------------------------------------- the index family


@dataclass
class Level:
    """Sorted distinct keys; for each the smallest document that any batch met so far has it in, and
    whether its first key stands with another second key somewhere. place: entry of each row it was made of."""

    keys: tuple[np.ndarray, ...]
    doc: np.ndarray
    mixed: np.ndarray
    place: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def find(self, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key and whether it is there, by binary search on the first and then the second key."""
        if not len(self):
            return np.zeros(len(keys[0]), np.int64), np.zeros(len(keys[0]), bool)
        low = np.searchsorted(self.keys[0], keys[0], "left")
        if len(self.keys) > 1:
            high = end = np.searchsorted(self.keys[0], keys[0], "right")
            own = self.keys[1]
            while (open_ := low < high).any():
                middle = np.minimum((low + high) // 2, len(own) - 1)
                below = open_ & (own[middle] < keys[1])
                low = np.where(below, middle + 1, low)
                high = np.where(open_ & ~below, middle, high)
            at = np.minimum(low, len(own) - 1)
            return at, (low < end) & (own[at] == keys[1])
        at = np.minimum(low, len(self) - 1)
        return at, self.keys[0][at] == keys[0]

    def meet(self, batch: Level) -> None:
        """Merge-scan a new batch against this level: keys of both get the smaller document on both sides,
        and first keys that now have several second ones are marked on both sides."""
        at, hit = self.find(batch.keys)
        least = np.minimum(batch.doc[hit], self.doc[at[hit]])
        batch.doc[hit] = self.doc[at[hit]] = least
        if len(self.keys) < 2 or not len(batch) or not len(self):
            return
        first = batch.keys[0]
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        own = np.diff(np.append(starts, len(first)))
        low, high = np.searchsorted(self.keys[0], first[starts], "left"), np.searchsorted(self.keys[0], first[starts], "right")
        several = (high > low) & (own + high - low - np.add.reduceat(hit.astype(np.int64), starts) > 1)
        batch.mixed |= np.repeat(several, own)
        low, size = low[several], (high - low)[several]
        self.mixed[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())] = True


def _runs(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by `keys` (first key first) and the places in it where a new key starts."""
    order = np.argsort(keys[0], kind="stable")
    first = keys[0][order]
    if len(keys) > 1:
        tie = first[1:] == first[:-1]
        if tie.any() and (keys[1][order][1:][tie] != keys[1][order][:-1][tie]).any():
            order = np.lexsort(keys[::-1])
            first = keys[0][order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    for k in keys[1:]:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def suffix_array(keys: tuple[np.ndarray, ...], doc: np.ndarray, mixed: np.ndarray | None = None) -> Level:
    """A batch's suffixes in sorted order, equal ones as one entry with the smallest document."""
    order, starts = _runs(keys)
    place = np.empty(len(doc), np.int32)
    place[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(doc))))
    sorted_ = tuple(k[order[starts]] for k in keys)
    flags = np.zeros(len(starts), bool) if mixed is None or not len(doc) else np.maximum.reduceat(mixed[order], starts)
    if len(keys) > 1 and len(starts):
        same = sorted_[0][1:] == sorted_[0][:-1]
        flags[1:] |= same
        flags[:-1] |= same
    return Level(sorted_, np.minimum.reduceat(doc[order], starts) if len(doc) else doc, flags, place)


class Family:
    """Sorted levels of geometric sizes: a new batch is scanned against the levels alive, becomes a
    level, and levels of about the same size merge.

    As every batch meets all that came before it, each entry knows the smallest document of its
    key over all batches once the last one is in; the order in which batches come does not
    matter. Of n batches at most log2(n) + 1 levels are alive, and an entry takes part in at
    most that many merges. Where a batch's entries went is kept through the merges, so nothing is
    searched again at the end.
    """

    def __init__(self):
        self.levels: list[tuple[Level, list[int]]] = []
        self.where: list[tuple[Level, np.ndarray]] = []

    def insert(self, batch: Level) -> int:
        """Take in a batch; its number, for answers()."""
        for level, _ in self.levels:
            level.meet(batch)
        number, members = len(self.where), [len(self.where)]
        self.where.append((batch, batch.place))
        while self.levels and len(self.levels[-1][0]) < 2 * len(batch):
            other, theirs = self.levels.pop()
            merged = suffix_array(tuple(np.concatenate([a, b]) for a, b in zip(other.keys, batch.keys, strict=True)), np.concatenate([other.doc, batch.doc]), np.concatenate([other.mixed, batch.mixed]))
            for k in theirs:
                self.where[k] = merged, merged.place[: len(other)][self.where[k][1]]
            for k in members:
                self.where[k] = merged, merged.place[len(other) :][self.where[k][1]]
            batch, members = merged, theirs + members
        self.levels.append((batch, members))
        return number

    def answers(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(smallest document, whether its first key has other second keys) for the rows of a batch, over all batches."""
        level, at = self.where[number]
        return level.doc[at], level.mixed[at]

    def scan(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """Smallest document of any keys over all levels (the largest possible number if there is none)."""
        out = np.full(len(keys[0]), _LAST, np.int64)
        for level, _ in self.levels:
            at, hit = level.find(keys)
            out[hit] = np.minimum(out[hit], level.doc[at[hit]])
        return out


# --------------------------------------------------------------------------- packing of rows


def _bytes(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: their number of entries first."""
    return b"".join([np.int64(len(arrays[0])).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def _arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _pack_batch(seed: np.ndarray, body: np.ndarray, doc: np.ndarray, many: np.ndarray) -> bytes:
    """Rows sorted by seed: differences of seeds, 48 bits of bodies, documents by number and a flag."""
    names, number = np.unique(doc, return_inverse=True)
    step = np.diff(seed, prepend=np.uint64(0))
    wide = len(step) and int(step.max()) >= 1 << 32
    body = body.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    number = (number << 1 | many).astype("<u2" if len(names) < 1 << 15 else "<u4")
    head = np.array([len(seed), len(names), wide], np.int64).tobytes()
    return b"".join([head, names.astype(np.int64).tobytes(), step.astype("<u8" if wide else "<u4").tobytes(), body.tobytes(), number.tobytes()])


def _unpack_batch(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, k, wide = np.frombuffer(blob, np.int64, 3).tolist()
    names, at = np.frombuffer(blob, np.int64, k, 24), 24 + 8 * k
    seed = np.cumsum(np.frombuffer(blob, "<u8" if wide else "<u4", n, at), dtype=np.uint64)
    at += n * (8 if wide else 4)
    body = np.zeros((n, 8), np.uint8)
    body[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
    number = np.frombuffer(blob, "<u2" if k < 1 << 15 else "<u4", n, at + 6 * n)
    return seed, body.view("<u8").ravel(), names[number >> 1], (number & 1).astype(bool)


def _rows(rb: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch as Python values, a few hundred at a time."""
    for i in range(0, len(rb), 256):
        yield from zip(*(c.to_pylist() for c in rb.slice(i, 256).columns), strict=True)


_BODY = np.uint64((1 << 48) - 1)


def _fact_key(seed: np.ndarray, part: np.ndarray | int, body: np.ndarray) -> np.ndarray:
    return mix64(mix64(seed + (np.asarray(part, np.uint64) << np.uint64(44))) + body)


# --------------------------------------------------------------------------- the operator


def remove_repeats(docs: DataFrame, span: int = 50, batch_bytes: int = 1 << 23, parts_per_partition: int = 4, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Remove every byte that a `span`-byte string covers which also starts in a document with a smaller doc_id.

    A sparse suffix array samples the suffixes that start at anchors (Blocks): equal windows
    have equal anchors, so two texts share a window only where they share an anchor's seed.

    1. Documents are written once, each compressed, with a batch number (about `batch_bytes` each).
    2. Each batch's anchored suffixes are sorted: by seed, then by body (the block's bytes).
       Entries equal within a batch are one, with the smallest document, so a passage however
       common gives a row for each batch at most. They are dealt by seed over parts.
    3. In each part, batches enter a Family one by one: a batch is merge-scanned against every
       level alive, which settles the smaller document on both sides of each match, becomes a
       level, and levels of about the same size merge. This finds blocks that stand whole in a
       smaller document, and seeds that stand in several different bodies (the ends of matches).
    4. Facts go back to their batch. Documents without any are done. For the others, the whole
       blocks are marked, and the different bodies under one seed are cut out as contexts.
    5. Contexts are dealt by seed. All windows in them that occur more than once make suffix
       arrays of full windows, compared byte by byte, in a second family; each window that a
       smaller document has is marked.
    6. Marked bytes are taken out.

    No pairs of occurrences are ever made. Suffixes are in the order of a hash of their first
    bytes, as only equal ones matter. A seed and a body together are told apart by 88 bits of
    hash besides the part's number (10^12 blocks have a chance of about 10^-3 that any two are
    taken for one); windows at the ends of matches are compared byte by byte.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256. With `carry` (names of columns of
    `docs`, none or more) it also returns kept_text (the remaining bytes as text, without
    characters that were cut in part; null for a null text) and those columns.

    A null text is empty; a null doc_id counts as larger than all others.
    Rows with one doc_id remove nothing from each other. Texts shorter than `span` stay whole.
    An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = min(parts_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        row, batch, held = first, first, 0
        for rb in batches:
            data, offsets = utf8(rb.column(1))
            body, pack = memoryview(data), zstandard.ZstdCompressor(level=1).compress
            for i, j in slices(offsets, 1 << 20):
                held += int(offsets[j] - offsets[i])
                packed = pa.array([pack(body[a:b]) for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, batch), pa.int64()), pa.array(np.arange(row, row + j - i), pa.int64()), rb.column(0).slice(i, j - i), packed, rb.column(2).slice(i, j - i)], ["batch", "row", "doc_id", "text", "extra"])
                row += j - i
                if held >= batch_bytes:
                    batch, held = batch + 1, 0

    keep = carry is not None
    extra = F.to_json(F.struct(F.col("text").isNull().alias("was_null"), F.struct(*(carry or ())).alias("carried"))) if carry else F.to_json(F.struct(F.col("text").isNull().alias("was_null")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (extra if keep else F.lit(None).cast("string")).alias("extra"))
    texts = settle(own.mapInArrow(lean(number), "batch long, row long, doc_id long, text binary, extra string"), "texts")
    ranked = texts.select("batch", "row", "doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), "extra")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        loose: list[tuple[bytes, int]] = []
        batch, size = None, 0

        def file_up() -> None:
            nonlocal loose
            offsets = np.cumsum([0, *(len(x[0]) for x in loose)])
            blocks = Blocks.of(np.frombuffer(b"".join([x[0] for x in loose]), np.uint8), offsets, span)
            held.append((blocks.seed, blocks.deal, blocks.body, np.array([x[1] for x in loose], np.int64)[np.searchsorted(offsets, blocks.first, "right") - 1]))
            loose = []

        def rows() -> pa.RecordBatch:
            nonlocal held
            columns, held = list(zip(*held, strict=True)), []
            seed, deal, body, doc = (np.concatenate(columns.pop(0)) for _ in range(4))
            part = (deal % np.uint64(parts)).astype(np.int32)
            del deal
            body &= _BODY
            order = (np.lexsort((doc, body, seed, part)) if len(doc) else np.zeros(0, np.int64)).astype(np.int32)
            part = part[order]
            seed = seed[order]
            body = body[order]
            doc = doc[order]
            del order
            new = np.ones(len(doc), bool)
            new[1:] = (part[1:] != part[:-1]) | (seed[1:] != seed[:-1]) | (body[1:] != body[:-1])
            starts = np.flatnonzero(new)
            many = np.maximum.reduceat(doc, starts) > doc[starts] if len(doc) else new
            part, seed, body, doc = part[starts], seed[starts], body[starts], doc[starts]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            found = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
            blobs = [_pack_batch(*(x[bounds[p] : bounds[p + 1]] for x in (seed, body, doc, many))) for p in found]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([batch] * len(found), pa.int64()), pa.array(blobs, pa.binary())], ["part", "batch", "rows"])

        unpack, waiting = zstandard.ZstdDecompressor().decompress, 0
        for rb in batches:
            for label, packed, rank in _rows(rb):
                if label != batch or size > 2 * batch_bytes:
                    if loose:
                        file_up()
                    if held:
                        yield rows()
                    batch, held, size, waiting = label, [], 0, 0
                text = unpack(packed)
                loose.append((text, rank))
                size += len(text)
                waiting += len(text)
                if waiting >= 1 << 20:
                    file_up()
                    waiting = 0
        if loose:
            file_up()
        if held:
            yield rows()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; one part's suffixes are held at a time."""
        held: list[tuple[int, bytes]] = []
        part = None

        squeeze = zstandard.ZstdCompressor(level=1).compress

        def facts() -> Iterator[pa.RecordBatch]:
            family = Family()
            for _, blob in held:
                seed, body, doc, _ = _unpack_batch(blob)
                family.insert(suffix_array((seed, body), doc))
            labels, blobs = [], []
            for number, (label, blob) in enumerate(held):
                seed, body, doc, many = _unpack_batch(blob)
                least, mixed = family.answers(number)
                ask = mixed & (doc == least)
                keep_it = ask | many | (least < doc)
                if keep_it.any():
                    labels.append(label)
                    blobs.append(squeeze(_bytes(_fact_key(seed[keep_it], part, body[keep_it]), least[keep_it], ask[keep_it].astype(np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(blobs, pa.binary())], ["batch", "facts"])

        for rb in batches:
            for own_part, label, blob in _rows(rb):
                if own_part != part:
                    if held:
                        yield from facts()
                    part, held = own_part, []
                held.append((label, blob))
        if held:
            yield from facts()

    blobs = ranked.select("batch", "text", "rank").mapInArrow(lean(index), "part int, batch long, rows binary")
    facts = settle(blobs.repartition("part").sortWithinPartitions("part", "batch").mapInArrow(lean(match), "batch long, facts binary"), "facts")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by batch, facts first; texts are then worked on in slices."""
        names = ["part", "row", "doc_id", "n_bytes", "sha", "text", "spans", "contexts", "extra"]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string())
        batch, found, table = None, [], None
        squeeze = zstandard.ZstdCompressor(level=1).compress
        unpack = zstandard.ZstdDecompressor().decompress

        def known() -> tuple[np.ndarray, ...]:
            rows = [_arrays(unpack(f), "<u8", "<i8", "u1") for f in found]
            key, least, ask = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, t) for k, t in enumerate(("<u8", "<i8", "u1")))
            order = np.lexsort((1 - ask, key))  # a batch that was read in parts has facts of each; one that asks comes first
            return key[order], least[order], ask[order]

        def texts_of(rows: list[tuple]) -> pa.RecordBatch:
            body_of = [unpack(r[2]) for r in rows]
            offsets = np.cumsum([0, *map(len, body_of)])
            data = np.frombuffer(b"".join(body_of), np.uint8)
            blocks = Blocks.of(data, offsets, span)
            key, least, ask = table
            part = (blocks.deal % np.uint64(parts)).astype(np.int64)
            own_key = _fact_key(blocks.seed, part, blocks.body & _BODY)
            hit = np.zeros(len(own_key), bool)
            at = np.zeros(len(own_key), np.int64)
            if len(key):
                at = np.minimum(np.searchsorted(key, own_key), len(key) - 1)
                hit = key[at] == own_key
            which = np.searchsorted(offsets, blocks.first, "right") - 1
            rank = np.array([r[3] for r in rows], np.int64)[which]
            full = hit & (least[at] < rank) if len(key) else hit
            wanted = hit & (least[at] == rank) & (ask[at] > 0) if len(key) else hit
            touched = np.zeros(len(rows), bool)
            touched[which[full | wanted]] = True
            out: list[tuple] = []
            full_rows, full_first, full_last = which[full], blocks.first[full], blocks.last[full]
            bounds = np.searchsorted(full_rows, np.arange(len(rows) + 1))
            for r, (row, doc_id, _, _, own_extra) in enumerate(rows):
                if not touched[r]:
                    out.append((None, row, doc_id, len(body_of[r]), hashlib.sha256(body_of[r]).hexdigest(), None, rows[r][2] if keep else None, None, own_extra))
                    continue
                own = slice(bounds[r], bounds[r + 1])
                out.append((None, row, doc_id, len(body_of[r]), None, rows[r][2], _bytes(full_first[own] - offsets[r], full_last[own] - offsets[r]), None, own_extra))
            if wanted.any():
                order = np.flatnonzero(wanted)
                order = order[np.argsort(part[order], kind="stable")]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]])
                numbers = np.array([r[0] for r in rows], np.int64)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    o = order[a:b]
                    start, end = blocks.first[o], blocks.last[o] + span - 1
                    pieces = b"".join([data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)])
                    out.append((int(part[o[0]]), None, None, None, None, None, None, squeeze(_bytes(blocks.seed[o], numbers[which[o]], rank[o], start - offsets[which[o]], end - start) + pieces), None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for rb in batches:
            rows: list[tuple] = []
            size = 0
            for label, is_text, fact, *row in _rows(rb):
                if label != batch:
                    if rows:
                        yield texts_of(rows)
                    rows, size = [], 0
                    batch, found, table = label, [], None
                if not is_text:
                    found.append(fact)
                    continue
                if table is None:
                    table, found = known(), []
                rows.append(tuple(row))
                size += len(row[2])
                if size > 1 << 19:
                    yield texts_of(rows)
                    rows, size = [], 0
            if rows:
                yield texts_of(rows)

    none = lambda kind: F.lit(None).cast(kind)
    mixed = facts.select("batch", F.lit(0).alias("is_text"), "facts", none("long").alias("row"), none("long").alias("doc_id"), none("binary").alias("text"), none("long").alias("rank"), none("string").alias("extra"))
    mixed = mixed.unionByName(ranked.select("batch", F.lit(1).alias("is_text"), none("binary").alias("facts"), "row", "doc_id", "text", "rank", "extra"))
    marked = mixed.repartition("batch").sortWithinPartitions("batch", "is_text").mapInArrow(lean(mark), "part int, row long, doc_id long, n_bytes long, sha string, text binary, spans binary, contexts binary, extra string")
    marked = settle(marked, "marked")
    discard(texts)
    discard(facts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; one part's contexts are held at a time."""
        held: list[bytes] = []
        part = None
        unpack = zstandard.ZstdDecompressor().decompress

        def windows(blob: bytes) -> tuple[np.ndarray, ...]:
            seed, row, doc, first, size = _arrays(blob, "<u8", "<i8", "<i8", "<i8", "<i8")
            data = np.frombuffer(blob, np.uint8, int(size.sum()), 8 + 40 * len(seed))
            count = size - span + 1
            context = np.repeat(np.arange(len(seed)), count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(np.cumsum(size) - size, count) + inner
            return data, start, context, inner, row, doc, first, seed

        def found() -> pa.RecordBatch:
            opened = [windows(b) for b in held]
            hashes = [mix64(span_hashes(prefix_sums(o[0]), o[1], o[1] + span) + o[7][o[2]]) for o in opened]
            every, docs_of = np.concatenate(hashes), np.concatenate([o[5][o[2]] for o in opened])
            order = np.argsort(every)
            new = np.ones(len(every), bool)
            new[1:] = every[order][1:] != every[order][:-1]
            starts = np.flatnonzero(new)
            low, high = np.minimum.reduceat(docs_of[order], starts), np.maximum.reduceat(docs_of[order], starts)
            twice = np.empty(len(every), bool)
            twice[order] = np.repeat(low < high, np.diff(np.append(starts, len(every))))
            family, asked, at = Family(), [], 0
            for (data, start, context, inner, row, doc, first, _), own in zip(opened, hashes, strict=True):
                pick = np.flatnonzero(twice[at : at + len(own)])
                at += len(own)
                suffix = np.ones((len(pick), span + 1), np.uint8)  # the last byte keeps trailing zeros apart
                suffix[:, :span] = data[start[pick][:, None] + np.arange(span)]
                suffix = suffix.reshape(-1).view(f"S{span + 1}")
                owner = context[pick]
                asked.append((family.insert(suffix_array((suffix,), doc[owner])) if len(pick) else None, row[owner], first[owner] + inner[pick], doc[owner]))
            rows, starts_at = [], []
            for number, row, first, doc in asked:
                hit = family.answers(number)[0] < doc if number is not None else np.zeros(0, bool)
                rows.append(row[hit])
                starts_at.append(first[hit])
            row, first = np.concatenate(rows), np.concatenate(starts_at)
            order = np.lexsort((first, row))
            row, first = row[order], first[order]
            cut = np.ones(len(row), bool)
            cut[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(row)) - 1 if len(row) else begin
            return pa.RecordBatch.from_arrays([pa.array(row[begin], pa.int64()), pa.array(first[begin], pa.int64()), pa.array(first[end] + 1 if len(row) else begin, pa.int64())], ["row", "first", "last"])

        for rb in batches:
            for own_part, blob in _rows(rb):
                if own_part != part:
                    if held:
                        yield found()
                    part, held = own_part, []
                held.append(unpack(blob))
        if held:
            yield found()

    ends = marked.where("part is not null").select("part", "contexts").repartition("part").sortWithinPartitions("part").mapInArrow(lean(compare), "row long, first long, last long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by row number: marked windows first, then the text."""
        row, found = None, []
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "extra"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for rb in batches:
            out: list[tuple] = []
            size = 0
            for own_row, first, last, doc_id, text, spans, extra in _rows(rb):
                if own_row != row:
                    row, found = own_row, []
                if text is None:
                    found.append((first, last))
                    continue
                text = unpack(text)
                a, b = _arrays(spans, "<i8", "<i8")
                ends_of = np.array(found, np.int64).reshape(-1, 2)
                step = np.zeros(len(text) + 1, np.int32)
                np.add.at(step, np.concatenate([a, ends_of[:, 0]]), 1)
                np.add.at(step, np.concatenate([b, ends_of[:, 1]]) + span - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
                out.append((doc_id, len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep else None, extra))
                size += len(kept)
                if size > 1 << 21:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)

    open_texts = marked.where("text is not null").select("row", none("long").alias("first"), none("long").alias("last"), "doc_id", "text", "spans", "extra")
    both = ends.select("row", "first", "last", none("long").alias("doc_id"), none("binary").alias("text"), none("binary").alias("spans"), none("string").alias("extra")).unionByName(open_texts)
    changed = both.repartition("row").sortWithinPartitions("row", F.col("text").isNotNull()).mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, extra string")
    def open_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for rb in batches:
            for i in range(0, len(rb), 256):
                part = rb.slice(i, 256)
                at = part.schema.get_field_index("kept_text")
                yield part.set_column(at, "kept_text", pa.array([unpack(x).decode("utf-8", "ignore") for x in part.column(at).to_pylist()], pa.string()))

    rest = marked.where("sha is not null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.col("spans").alias("kept_text"), "extra")
    if keep:
        rest = rest.mapInArrow(lean(open_up), ", ".join(f"{c} {t}" if c != "kept_text" else "kept_text string" for c, t in rest.dtypes))
    if not keep:
        return changed.drop("kept_text", "extra").unionByName(rest.drop("kept_text", "extra"))
    out = changed.unionByName(rest)
    shape = f"struct<was_null: boolean{', carried: ' + docs.select(F.struct(*carry)).schema[0].dataType.simpleString() if carry else ''}>"
    out = out.withColumn("extra", F.from_json("extra", shape)).withColumn("kept_text", F.when(~F.col("extra.was_null"), F.col("kept_text")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *[F.col("extra.carried")[c].alias(c) for c in carry])
