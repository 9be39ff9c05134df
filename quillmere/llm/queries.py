"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import chat, fingerprints, licences, mixing, near_dup, negatives, oracles, packing, quality, repair, suffix_dedup, token_files, toxicity, vectors
from quillmere.llm.common import table, tokenizer_path


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all conversations linked with their results, ordered within their turn, checked and written out; results of no call as `orphan`.

    Calls that messages hold as JSON are read; every other message stands for the calls that
    chat.from_chat() makes of it. Null texts are empty, rows with a null conv_id never link.
    """
    calls, results = chat.all_calls(table(spark, sf_dir, "conversations"))
    linked = chat.link(calls, results, chat.CHAT_TOOLS).unionByName(chat.orphan_rows(calls, results))
    return linked.withColumn("errors", F.array_join("errors", ";"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document, learned from `labels` outside the held-out quarter."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that a smaller doc_id has."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from `labels` outside the held-out third."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the training positions in [0, 1) at which it is read (null: not read), in training order."""
    place = lambda k: F.round(F.get("positions", F.lit(k)), 9).alias(f"position_{k + 1}")
    return mixing.in_order(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", place(0), place(1))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in pieces, packed into sequences of at most 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices found in every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by three-word shingles at a similarity of 0.85."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, numerator=85, denominator=100, bands=24)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every vec_id that 20 divides, over all other vectors."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in files of coded ids, from the files."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair.digests(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vec_id that 100 divides, over all rows."""
    return negatives.hard_negatives(negatives.shifted(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_quality, op3_suffix_array, op4_toxicity, op5_mixing, op6_packing, op7_licences, op8_minhash, op9_fingerprints, op10_vectors, op11_token_files, op12_repair, op13_hard_negatives)}
ORACLE_SQL = oracles.ORACLE_SQL
