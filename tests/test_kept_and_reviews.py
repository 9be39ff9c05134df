"""Kept indexes are named by what is in them; receipts and versions that come more than once."""

import duckdb
from pyspark.sql import functions as F

from quillmere.functions import redaction
from quillmere.operators import ingestion
from quillmere.operators.index import Index
from quillmere.plans.records import CALIBRATION_GRID

SF = "/root/testdata/sf0.001"


def terms(index):
    return {r[0] for r in index.table.where("term is not null").select("term").distinct().collect()}


def test_an_index_of_other_fields_is_another_index(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    body, lang = Index.of_table(docs, "probe", {"body": F.col("text")}, "doc_id"), Index.of_table(docs, "probe", {"body": F.col("lang")}, "doc_id")
    assert len(terms(body)) > 1000 and terms(lang) <= {"en", "fr", "de", "es"}
    more = Index.of_table(docs, "probe", {"body": F.col("lang")}, "doc_id", evidence=F.lower("text"))
    assert more.table.where("exists(evidence, x -> x <> '')").count() > 0
    again = Index.of_table(spark.read.parquet(f"{SF}/documents.parquet"), "probe", {"body": F.col("lang")}, "doc_id")
    assert again.table.inputFiles() == lang.table.inputFiles() != more.table.inputFiles()
    assert Index.of_table(docs, "probe", {"body": F.col("lang")}, "doc_id", buckets=4).buckets == 4


def test_several_receipts_of_a_source_leave_one_manifest(spark):
    kind = "source_id string, content_hash string, processing_status string, processed_content_hash string, duplicate_of string, refined_knowledge_ids array<string>"
    manifests = spark.createDataFrame([("a", "h1", "pending", None, None, []), ("b", "h2", "pending", None, None, []), ("c", "h3", "pending", None, None, [])], kind)
    receipts = spark.createDataFrame([("a", "h1", "refined", None, ["k"]), ("a", "old", "ignored", None, []), ("a", "h1", "ignored", None, []), ("b", "old", "refined", None, []), ("z", "h", "refined", None, [])], "source_id string, expected_hash string, status string, duplicate_of string, refined_knowledge_ids array<string>")
    out, refused = ingestion.mark_reviewed(manifests, receipts)
    assert sorted((r.source_id, r.processing_status, r.processed_content_hash) for r in out.collect()) == [("a", "refined", "h1"), ("b", "pending", None), ("c", "pending", None)]
    assert sorted((r.source_id, r.expected_hash) for r in refused.collect()) == [("a", "old"), ("b", "old"), ("z", "h")]


def test_newest_of_one_time_is_the_same_row_whatever_the_order(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w")]
    for order in (rows, rows[::-1]):
        got = ingestion.newest(spark.createDataFrame(order, "k string, t int, v string").repartition(3), "k", "t").collect()
        assert sorted(map(tuple, got), key=str) == [("a", 2, "z"), ("b", None, "w")]


def test_calibration_sql_has_one_answer():
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert len({str(sorted(con.execute(CALIBRATION_GRID).fetchall())) for _ in range(40)}) == 1


def test_no_pattern_matches_where_it_is_thought_not_to(spark):
    texts = ["1" * 18, "13800138000", "+86 13800138000x", "a@b.co", "EYJ", "eyJabcdef.ghijkl.mnopqr", "AKIA" + "A" * 16, "ghp_" + "a" * 24, "SK-x sk-" + "b" * 24, "Authorization: Basic abcd", "BEARER " + "t" * 20, "Cookie=abcd", "pwd: secretive", "-----BEGIN PRIVATE KEY-----x-----END PRIVATE KEY-----", "", "plain", None, "authorization: token abcdef password=hidden a@b.co"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    full = rows.select("t", *[F.regexp_count("t", F.lit(r.pattern)).alias(r.kind) for r in redaction.RULES], *[r.may_match(F.col("t")).alias(f"may_{r.kind}") for r in redaction.RULES]).collect()
    for row in full:
        for r in redaction.RULES:
            assert row[f"may_{r.kind}"] or not row[r.kind]
    assert all(any(row[r.kind] for row in full) for r in redaction.RULES)
