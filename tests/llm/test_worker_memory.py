"""What operators leave in the Python workers, which an executor keeps for all that come after."""

import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])
SCRIPT = """
import corpus_pipeline
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[1]").config(map={"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")


def held() -> int:
    def probe(batches):
        import pyarrow as pa
        from quillmere.llm.tokens import _memory

        for rb in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(_memory)], pa.int64())})

    return max(r.n for r in spark.range(0, 8, 1, 4).mapInArrow(probe, "n long").collect())


assert stages["packing"](spark, docs, None).count() and held() == 1, "packing keeps its words for its next task"
assert stages["near_dup"](spark, docs, None).count() and held() == 0, "near_dup leaves packing's words in the worker"
assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == size
"""


def test_stages_do_not_keep_the_memory_of_others():
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=REPO, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-1500:]


def test_near_duplicates_takes_groups_larger_than_a_batch(spark):
    from quillmere.llm.near_dup import near_duplicates

    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join([*words, f"own{k}"])) for k in range(1, 1301)], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert {r.component_id for r in near_duplicates(docs).collect()} == {1}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
