"""Every stage of the pipeline on nulls, empty and long texts, repeated rows, other columns and empty tables."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
ROWS = [(None, "a b c d e f g", "en", "web"), (None, None, None, None), (1, "", "en", "web"), (2, None, "en", None), (3, LONG, "en", "web"), (4, "one two three four five six seven eight", "de", "wiki"), (4, "one two three four five six seven eight", "de", "wiki"), (5, "one two three four five six seven eight", None, "wiki"), (6, " \n\t ", "fr", "web")]
KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, part int, n_removed string"


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_takes_awkward_rows(spark, name, stage):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), None, None, 7, "clash") for r in ROWS], KIND)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name != "packing":
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
    if name == "toxicity":
        assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, ((r[0], r[1]) for r in ROWS)))
    elif name == "near_dup":
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(["None", "None", "1", "2", "3", "4", "4", "6"])
    elif name == "suffix_dedup":
        assert len(rows) == len(ROWS) and {r.doc_id: r.text for r in rows}[3] == LONG and {r.doc_id: r.text for r in rows}[2] is None
        assert all(r.n_chars == len(r.text or "") for r in rows)
    elif name == "mixing":
        assert {r.doc_id for r in rows} <= {None, 3, 4, 5} and all((r.text or "").strip() for r in rows)
    else:
        ends = {}
        for r in rows:
            ends.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
        assert sum(map(sum, ends.values())) == sum(r.length for r in rows) and {k for k, _ in ends} == {r[0] for r in ROWS}
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_op5_has_its_documents_in_training_order_over_several_ranges(spark):
    from pyspark.sql import functions as F

    from quillmere.llm import mixing, queries
    from tests.conftest import SF

    got = [r.position_1 for r in queries.op5_mixing(spark, SF).collect()]
    assert got == [*sorted(x for x in got if x is not None), *[None] * got.count(None)] and len(got) == 200
    docs = spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 7).cast("int")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = mixing.in_order(mixing.mix(docs)).select("doc_id", F.get("positions", F.lit(0)).alias("at"), F.spark_partition_id().alias("range")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.doc_id for r in rows] == [r.doc_id for r in sorted(rows, key=lambda r: (r.at is None, r.at or 0, r.doc_id))] and len(rows) == 4000
    unread = [r.range for r in rows if r.at is None]
    assert len({r.range for r in rows}) == 4 and len(unread) > 500 and (len(unread) < 1500 or len(set(unread)) > 1)
