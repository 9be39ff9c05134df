"""Quality scores against a plain sum of table cells, text by text."""

import math
import zlib

from quillmere.llm import quality
from quillmere.llm.queries import op2_quality

SF = "/root/testdata/sf0.001"


def plainly(model, text):
    """A text's score by loops over cut points and tables."""
    total, bins = model.intercept, []
    for x, cuts, table in zip(quality.features(text), model.cuts, model.single, strict=True):
        k = sum(1 for c in cuts if c <= x)
        bins.append(k)
        total += table[k]
    for a, b, table in model.pairs:
        total += table[model.coarse[a][bins[a]]][model.coarse[b][bins[b]]]
    return 1 / (1 + math.exp(-total))


def test_scores_are_sums_of_table_cells(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert len(model.pairs) == 6 and any(t.any() for t in model.single) and any(t.any() for _, _, t in model.pairs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op2_quality(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r.score, plainly(model, texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-12)
        assert r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_long_texts_are_read_to_their_end(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    head = "word " * 200_000
    rows = spark.createDataFrame([(1, head), (2, head + "! | " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_texts(rows, model).collect()}
    assert math.isclose(got[2], plainly(model, head + "! | " * 100_000), rel_tol=1e-9) and got[1] != got[2]
