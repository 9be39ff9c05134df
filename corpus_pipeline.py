"""The corpus pipeline: five stages over `documents`, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import mixing, near_dup, packing, suffix_dedup, toxicity
from quillmere.llm.common import discard, settle, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, with the five columns of documents.

    The score is a column of its own pass over the texts, so the rows are filtered where they
    are scored: nothing is joined back. A null or empty text has no words and stays, rows with a
    null or repeated doc_id are judged each by their own text, other columns are not read, and
    an empty table stays one.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model, threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies: five words, similarity 0.8.

    A doc_id goes or stays with all its rows; rows with a null doc_id and texts without words stay.
    """
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes that a document with a smaller doc_id has as well.

    Bytes of a character that is cut in part go with it. n_chars is counted anew; a text of
    which nothing is left stays as an empty one. A null text stays null. Rows with a null doc_id
    stay as they are, if no smaller one has their passages; an empty table stays one.
    """
    kept = suffix_dedup.remove_repeats(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.coalesce(F.length("kept_text"), F.lit(0)).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order.

    Texts without words are never read. A null source is a source of its own. Repeated rows are
    read each.
    """
    return mixing.training_stream(docs.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids. A null or empty text is one id; a null doc_id stays null."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_copies), ("suffix_dedup", cut_repeats), ("mixing", mix_sources), ("packing", pack_windows)]

#: SQL can express neither a trained model nor a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
