"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(doc_id: Column) -> Column:
    """crc32 of the doc_id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most_rows: int, most_bytes: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of labelled documents, whole texts, in the order of md5(doc_id).

    The first `most_rows` labelled documents are drawn; of those, each text is learned from with
    which the texts taken so far hold `most_bytes` of UTF-8 at most, which bounds the driver's
    memory; one that is too long is passed over. fold = (m, r):
    documents whose text_key mod m is r are never learned from. Null labels and doc_ids are left
    out, and a doc_id with several labels takes the largest.
    """
    m, r = fold
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(text_key(F.col("doc_id")) % m != r).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(digest, "doc_id").limit(most_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_label")
    found, held = [], 0
    for row in rows.orderBy(digest, "doc_id", "text").toLocalIterator():
        size = len(row.text.encode("utf-8", "surrogatepass"))
        if held + size <= most_bytes:
            held += size
            found.append((row.doc_id, row.text, row._label))
    return sorted(found)
