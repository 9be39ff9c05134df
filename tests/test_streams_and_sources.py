"""Streams give what the batch operators give; readers keep their promises."""

import json

import pytest
from pyspark.sql import functions as F

from quillmere.operators import ledger
from quillmere.sources import files, knowledge, logs
from quillmere.streaming import logs as streams


def write_lines(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir())):03d}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_drain_reads_late_records_once(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    schema = spark.createDataFrame([], "ts string, n int").schema
    write_lines(source, [{"ts": "2025-01-02", "n": 1}])
    for rows in ([], [{"ts": "2025-01-01", "n": 2}], [{"ts": "2025-01-03", "n": 3}]):
        if rows:
            write_lines(source, rows)
        streams.drain(streams.read_log(spark, str(source), schema), out, mark).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_stream_pairs_equal_batch(spark, tmp_path):
    rows = [("k", n, f"2025-01-01 00:00:{t:02d}", e) for n, (t, e) in enumerate([(1, "start"), (2, "start"), (5, "stop"), (6, "stop"), (8, "start"), (9, "stop")])]
    df = spark.createDataFrame(rows, "key string, id long, ts string, event string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1):
        df.where(F.col("id").between(part * 3, part * 3 + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.pairs(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    got = {(r.stop_id, r.duration_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.id, r.duration_ms) for r in ledger.pair_starts(df, "key", "ts", "event").where("paired").collect()}
    assert got == want == {(2, 3000), (5, 1000)}


def test_stream_chain_equals_batch(spark, tmp_path):
    from tests.test_operators import event

    events = spark.createDataFrame([event(1, "intake", "k1"), event(2, parent_event_id="id1"), event(3, "intake", "k1", summary="e1"), event(4, stream="s2")], ledger.EVENT_INPUT)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    streams.chained(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    key = lambda df: sorted((r.event_id, r.outcome, r.record_hash) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(ledger.append(None, events))


def test_upsert_keeps_the_newest(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = spark.createDataFrame([], "k string, ts string, v int").schema
    write_lines(source, [{"k": "a", "ts": "2", "v": 1}, {"k": "b", "ts": "1", "v": 2}])
    for rows in ([], [{"k": "a", "ts": "1", "v": 3}, {"k": "b", "ts": "2", "v": 4}]):
        if rows:
            write_lines(source, rows)
        streams.upsert_batches(streams.read_log(spark, str(source), schema), out, str(tmp_path / "mark"), ["k"], ["ts", "v"]).awaitTermination()
    assert {r.k: r.v for r in spark.read.parquet(f"{out}/version=1").collect()} == {"a": 1, "b": 4}


def test_log_readers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"n": 1}\nnot json\n\n{"n": 2}\n')
    schema = spark.createDataFrame([], "n int").schema
    good, bad = logs.read_lenient(spark, str(tmp_path / "x.jsonl"), schema)
    assert sorted(r.n for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    assert [(r.n, r.line) for r in logs.read_numbered(spark, str(tmp_path / "x.jsonl"), schema).orderBy("line").collect()] == [(1, 1), (2, 4)]
    with pytest.raises(Exception):
        logs.read_strict(spark, str(tmp_path / "x.jsonl"), schema).collect()


def test_knowledge_files_round_trip(spark, tmp_path):
    from quillmere import schemas
    from tests.test_retrieval import doc

    docs = spark.createDataFrame([{**doc("k_a", "Título", "Body\n\nmore"), "file_path": "knowledge/semantic/a.md"}], schemas.schema("knowledge"))
    for r in knowledge.to_markdown(docs).collect():
        for path in (r.file_path, "knowledge/_inbox/b.md", "knowledge/catalog.md"):
            (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / path).write_text(r.text)
    got = knowledge.read_knowledge(spark, str(tmp_path)).collect()
    assert [(r.id, r.title, r.body, r.file_path) for r in got] == [("k_a", "Título", "Body\n\nmore", "knowledge/semantic/a.md")]
    assert schemas.require_valid(docs).count() == 1
    bad = docs.withColumn("id", F.lit("x y")).withColumn("confidence", F.lit(2.0))
    assert schemas.knowledge_violations(bad).first().violations == ["id", "confidence"]
    with pytest.raises(Exception, match="invalid knowledge"):
        schemas.require_valid(bad).collect()
    (tmp_path / "knowledge/semantic/bad.md").write_text("no head")
    assert [r.parse_error is None for r in knowledge.read_knowledge(spark, str(tmp_path), strict=False).orderBy("file_path").collect()] == [True, False]


def test_file_and_git_probes(spark, tmp_path):
    import subprocess

    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("one")
    (tmp_path / "d/b.bin").write_bytes(b"\xff\xfe\x00")
    probes = files.probe_files(spark, str(tmp_path / "d"), "c")
    assert {r.external_key: r.bytes for r in probes.collect()} == {"a.txt": 3, "b.bin": 3}
    assert {r.external_key: (r.text, r.error is None) for r in files.fetch_files(spark, str(tmp_path / "d"), probes).collect()} == {"a.txt": ("one", True), "b.bin": (None, False)}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "d"), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init")
    run("add", ".")
    run("commit", "-m", "x")
    tree = files.probe_git(spark, str(tmp_path / "d"), "HEAD", "c", "p")
    assert {r.external_key for r in tree.collect()} == {"a.txt", "b.bin"} and tree.where("path_hash is null").count() == 0
