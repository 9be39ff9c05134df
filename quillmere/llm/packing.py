"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmere.llm.common import lean
from quillmere.llm.tokens import words_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> list[int]:
    """Window of each item, by multiway differencing.

    Every item starts as a partial partition of `windows` sums of which one is not 0. The two
    partial partitions with the largest spread are merged, the largest sum of one onto the
    smallest of the other, until one is left: its sums are nearly equal. What stands in which
    window is read back from the merges.

    Only sums above 0 are kept, largest first. While those of two partitions fit beside each
    other, merging lays them side by side, and an item that is smaller than all sums is put at
    their end; arrays of all windows are made only where sums are added.
    """
    n = len(sizes)
    if windows == 1 or not n:
        return [0] * n
    sums: dict[int, list[int] | np.ndarray] = {}
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    bits, number = int(windows).bit_length(), np.arange(windows)
    mask = (1 << bits) - 1
    links: list[tuple[int, int, int, int, object]] = []  # (a, b, sums of a, sums of b, how they lie in the merge)

    def dense(x: list[int] | np.ndarray) -> np.ndarray:
        out = np.zeros(windows, np.int64)
        out[: len(x)] = x
        return out

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = (sums.pop(k) if k >= n else [sizes[k]] for k in (a, b))
        node, size_x, size_y, order = n + len(links), len(x), len(y), None
        if size_x + size_y > windows:
            keyed = np.sort(-(dense(x) + dense(y)[::-1]) << bits | number)  # largest first, equal ones by number
            order, total = keyed & mask, -(keyed >> bits)
        elif size_y == 1 and y[0] <= x[-1]:
            x.append(y[0])
            total = x
        else:
            both = [*x, *y]
            order = sorted(range(len(both)), key=lambda k: -both[k])
            total = [both[k] for k in order]
        links.append((a, b, size_x, size_y, order))
        sums[node] = total
        heapq.heappush(heap, (-int(total[0] - (total[-1] if len(total) == windows else 0)), node))
    out = [0] * n
    last = heap[0][1]
    stack: list[tuple[int, list[int] | np.ndarray]] = [(last, list(range(len(sums[last]) if last >= n else 1)))]
    while stack:
        node, where = stack.pop()  # where[w]: final window of the node's sum w
        if node < n:
            out[node] = int(where[0])
            continue
        a, b, size_x, size_y, order = links[node - n]
        if order is None:
            where = where if isinstance(where, list) else where.tolist()
            own, other = where, [where.pop()]
        elif isinstance(order, list):
            before = [0] * len(order)
            for w, k in enumerate(order):
                before[k] = where[w]
            own, other = before[:size_x], before[size_x:]
        else:
            before = np.empty(windows, np.int64)
            before[order] = where  # before the sort
            own, other = before[:size_x], before[::-1][:size_y]
        stack += [(a, own), (b, other)]
    return out


def pack_lengths(lengths: list[int], capacity: int = 2048, fragment: int = 512) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) for items of the given lengths.

    Items are cut into full windows; what is left of each is cut into fragments and spread
    over windows by differencing. The number of windows starts at the least that could hold
    them; whenever windows exceed their capacity it rises by as many as what lies over would fill,
    one at least, for groups of every size.
    """
    pieces, rest, sequence = [], [], 0
    for item, length in enumerate(lengths):
        full = length // capacity
        for k in range(full):
            pieces.append((item, k * capacity, capacity, sequence, 0))
            sequence += 1
        rest += [(item, at, min(fragment, length - at)) for at in range(full * capacity, length, fragment)]
    sizes = [r[2] for r in rest]
    windows = -(-sum(sizes) // capacity)
    while sizes:
        chosen = differencing(sizes, windows)
        over = int(np.maximum(np.bincount(chosen, weights=sizes, minlength=windows) - capacity, 0).sum())
        if not over:
            filled = [0] * windows
            for (item, start, length), w in sorted(zip(rest, chosen, strict=True), key=lambda x: x[1]):
                last = pieces[-1] if pieces else None
                if last and last[0] == item and last[3] == sequence + w and last[1] + last[2] == start:  # neighbours stay one piece
                    pieces[-1] = (item, last[1], last[2] + length, last[3], last[4])
                else:
                    pieces.append((item, start, length, sequence + w, filled[w]))
                filled[w] += length
            break
        windows += -(-over // capacity)
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, group_tokens: int = 1 << 20) -> DataFrame:
    """Pack every document of `docs` (doc_id, text) into sequences of at most `capacity` ids.

    A document is its ids and then `end_id`. Documents are taken in groups of about
    `group_tokens` ids as they stand in a task, so a task holds one group's ids at a time and
    nothing is shuffled; each group is packed by pack_lengths(). Groups hold hundreds of
    windows, so the one or two windows that rounding adds to a group stay well under 1 %.
    sequence_id is (partition << 32) + a count within the partition; a task run again gives
    the same rows.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null or empty text is one id. A null doc_id is kept as null. Repeated rows are
    packed each. An empty table gives no rows. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, sequence = words_of(tokenizer_path, end_id), TaskContext.get().partitionId() << 32
        ids: list[bytes] = []
        keys: list = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal ids, keys, held, sequence
            rows = pack_lengths([len(x) // 4 for x in ids], capacity)
            item = [r[0] for r in rows]
            numbers = {name: pa.array([r[k] for r in rows], pa.int64()) for name, k in (("start", 1), ("length", 2), ("offset", 4))}
            out = pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([keys[i] for i in item], pa.int64()),
                    "start": numbers["start"],
                    "length": numbers["length"],
                    "ids_crc32": pa.array([zlib.crc32(memoryview(ids[r[0]])[4 * r[1] : 4 * (r[1] + r[2])]) for r in rows], pa.int64()),
                    "doc_tokens": pa.array([len(ids[i]) // 4 for i in item], pa.int64()),
                    "sequence_id": pa.array([sequence + r[3] for r in rows], pa.int64()),
                    "offset": numbers["offset"],
                }
            )
            sequence += max(r[3] for r in rows) + 1
            ids, keys, held = [], [], 0
            return out

        for batch in batches:
            for at, found, offsets in words.encode(batch.column(1)):
                body = found.astype("<u4").tobytes()
                for k, key in enumerate(batch.column(0).slice(at, len(offsets) - 1).to_pylist()):
                    ids.append(body[4 * offsets[k] : 4 * offsets[k + 1]])
                    keys.append(key)
                    held += int(offsets[k + 1] - offsets[k])
                    if held >= group_tokens:
                        yield emit()
        if ids:
            yield emit()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(work, keeps="words"), PIECES)
