"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import mix64

_PRIME = (1 << 31) - 1
_BASES = (1_000_003, 1_442_695_041)
_SHIFT, _MASK = np.uint64(31), np.uint64(_PRIME)
#: Code points of a whole window.
WIDTH = 12
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^62."""
    x = (x & _MASK) + (x >> _SHIFT)
    x = (x & _MASK) + (x >> _SHIFT)
    return x - _MASK * (x >= _MASK)


def _power_table(base: int, inverse: bool, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo the prime, or the same of its inverse; grown by doubling."""
    key = (base, inverse)
    if key not in _powers:
        _powers[key] = np.ones(1, np.uint64)
    unit = pow(base, -1, _PRIME) if inverse else base
    while len(_powers[key]) < n:
        have = _powers[key]
        _powers[key] = np.concatenate([have, _fold(have * np.uint64(pow(unit, len(have), _PRIME)))])
    return _powers[key]


class PrefixHashes:
    """Modular prefix arrays of a text: any two spans are compared in constant time.

    prefix[i] is the sum of (code point j + 1) * base^j for j < i; a span's hash is the
    difference of two prefixes times base^-start, for two bases modulo 2^31 - 1. Sums are kept
    unreduced below 2^64 (texts shorter than 2^32 code points).
    """

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.prefix, self.inverse = [], []
        for base in _BASES:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_fold(codes * _power_table(base, False, self.n)[: self.n]), out=sums[1:])
            self.prefix.append(sums)
            self.inverse.append(_power_table(base, True, self.n))

    def spans(self, starts: slice | int, ends: slice | int) -> np.ndarray:
        """62-bit hashes of spans; slices of starts and ends go together."""
        low, high = (_fold(_fold(s[ends] - s[starts]) * t[starts]) for s, t in zip(self.prefix, self.inverse, strict=True))
        return (low << _SHIFT) | high

    def span(self, start: int, end: int) -> int:
        if start == end:
            return 0
        out = 0
        for s, t in zip(self.prefix, self.inverse, strict=True):
            out = out << 31 | (int(s[end]) - int(s[start])) % _PRIME * int(t[start]) % _PRIME
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hashes of the spans that end at each code point and reach back `width` code points, or to the start."""
        head, m = min(width - 1, self.n), max(0, self.n - width + 1)
        parts = []
        for s, t in zip(self.prefix, self.inverse, strict=True):
            parts.append(np.concatenate([_fold(s[1 : head + 1]), _fold(_fold(s[self.n - m + 1 :] - s[:m]) * t[:m])]))
        return (parts[0] << _SHIFT) | parts[1]

    def common_extension(self, other: PrefixHashes, here: int = 0, there: int = 0) -> int:
        """Length of the longest common extension from two places, by binary search over span equality."""
        low, high = 0, min(self.n - here, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(here, here + middle) == other.span(there, there + middle):
                low = middle
            else:
                high = middle - 1
        return low


class Fingerprint:
    """Length, hash of the whole text and the `size` smallest scrambled hashes of its windows.

    A window ends at each code point and reaches back WIDTH code points, or to the start of the
    text where that is nearer. So a text of n code points has n windows, whatever n is, and
    texts of about the same length are compared by the same rule. The text form is n, the whole
    hash and the sketch, in hexadecimal digits.
    """

    def __init__(self, text: str, size: int = 64):
        self.hashes = own = PrefixHashes(text)
        values = mix64(own.windows(WIDTH)) >> np.uint64(16)
        few = np.unique(np.partition(values, 4 * size)[: 4 * size]) if len(values) > 4 * size else np.unique(values)
        if len(few) < size and len(values) > 4 * size:
            few = np.unique(values)
        self.sketch, self.size = few[:size], size
        self.text = f"{own.n:x}.{own.span(0, own.n):016x}." + "".join([f"{v:012x}" for v in self.sketch.tolist()])

    def likeness(self, other: Fingerprint) -> float:
        """Estimated Jaccard similarity of two texts' windows: exact for texts with few windows."""
        if self.text == other.text:
            return 1.0
        both = np.union1d(self.sketch, other.sketch)[: self.size]
        shared = np.intersect1d(np.intersect1d(both, self.sketch, assume_unique=True), other.sketch, assume_unique=True)
        return len(shared) / len(both) if len(both) else 0.0


def edited(text: str, following: str) -> str:
    """`text` with its last quarter replaced by the start of `following`."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_edited long, common_prefix_next long"


def fingerprints(docs: DataFrame, parts_per_partition: int = 4) -> DataFrame:
    """Fingerprint every document and compare it with its edited text and the next document.

    The next document is the one with the next larger doc_id; after the last comes the first.
    Documents are dealt once, by ranges of doc_id whose bounds come from quantiles of doc_id
    alone; the first document of each range goes to the range before as well, so every range is
    worked on alone, in order, with one document held at a time.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and the lengths of the prefixes shared with both. A null text is empty. A null
    doc_id comes first. Rows with one doc_id follow each other in the order of their texts. Two
    empty texts are alike (1); an empty and another text are not (0). An only document is its
    own next. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = parts_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.agg(F.percentile_approx("_k", [k / n for k in range(1, n)], 10_000)).first()[0] or []))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    rows = rows.withColumn("_part", F.size(F.filter(bounds, lambda c: c <= F.col("_k"))))
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("_part").agg(F.min("_k")).collect())  # one row for each range
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    leads = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<int>"))
    main = F.struct(F.col("_part").cast("int").alias("part"), F.lit(0).alias("tail"))
    tail = F.struct(F.element_at(leads, F.col("_k")).cast("int").alias("part"), F.lit(1).alias("tail"))
    dealt = rows.select("doc_id", "_k", "text", F.explode(F.when(F.map_contains_key(leads, F.col("_k")), F.array(main, tail)).otherwise(F.array(main))).alias("_to"))
    ordered = dealt.select("_to.part", "_to.tail", "_k", "doc_id", "text").repartition("part").sortWithinPartitions("part", "tail", "_k", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        part, held = None, None  # held: doc_id, text, fingerprint of the document that waits for its next
        for rb in batches:
            out: list[tuple] = []
            for own_part, is_tail, doc_id, text in zip(*(rb.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if own_part != part:
                    part, held = own_part, None
                elif held is None:  # further rows with the id of the first document of the next range
                    continue
                mark = Fingerprint(text)
                if held:
                    new = edited(held[1], text)
                    changed = Fingerprint(new)
                    out.append(
                        (
                            held[0],
                            held[2].hashes.n,
                            hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                            held[2].text,
                            changed.text,
                            held[2].likeness(changed),
                            held[2].likeness(mark),
                            held[2].hashes.common_extension(changed.hashes),
                            held[2].hashes.common_extension(mark.hashes),
                        )
                    )
                held = None if is_tail else (doc_id, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return ordered.mapInArrow(work, _COLUMNS)
