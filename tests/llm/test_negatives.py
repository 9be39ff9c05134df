"""Hard negatives against brute force, with small cells and blocks, and rows in every awkward form."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import negatives
from quillmere.llm.oracles import ORACLE_SQL
from quillmere.llm.queries import op13_hard_negatives

SMALL = {"pivots": 6, "sample_rows": 40, "chunk_rows": 7, "block_anchors": 3, "parts": 3}


def brute(rows, is_anchor):
    """Rows (vec_id, vector, label) to sorted result rows."""
    fine = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in fine]
    fine = [r for r in fine if len(r[1]) == max(set(sizes), key=lambda n: (sizes.count(n), n))]
    out = []
    for k, (anchor, v, label) in enumerate(fine):
        if not is_anchor(anchor):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i, own) for j, (i, w, own) in enumerate(fine) if j != k), key=lambda s: s[:2])
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            hard = [s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            out += [(anchor, positive, r, i, -score, -s) for r, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


def made(seed, n, dim=5, labels=3, clusters=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dim))
    return [(int(i), (centre[rng.integers(clusters)] + 0.2 * rng.normal(size=dim)).tolist(), int(rng.integers(labels))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", 1) for r in rows], "vec_id long, embedding array<double>, label int, cell string, rank int")


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_is_its_sql(spark, where):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet'")
    cur = con.execute(ORACLE_SQL["op13_hard_negatives"])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, op13_hard_negatives(spark, where).select(*names).collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_small_cells_and_blocks(spark, seed):
    rows = made(seed, 220)
    rows += [(1000 + k, rows[0][1], k % 3) for k in range(60)]  # many equal vectors
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 9 == 0, **SMALL)
    want = brute(rows, lambda i: i % 9 == 0)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_cells_that_cannot_serve_are_left_out():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(50, 4)) + 40 * np.eye(4)[k] for k in range(4)]).round().astype(np.int64)
    space = negatives.Space(np.zeros((0, 5)), rows, np.zeros(len(rows), np.int64), float((rows**2).sum(axis=1).max()), True)
    space.pivots = space.raised(rows[[0, 50, 100, 150]])
    far = space.distances(space.raised(rows))
    radius = np.array([far[far.argmin(axis=1) == c, c].max() for c in range(4)])
    reach = space.reach(rows, radius)
    assert (reach[:, far.argmin(axis=1)] >= rows @ rows.T).all()  # never too low
    assert (reach[:50, 1:] < (rows[:50] @ rows[:50].T).min()).all()


def test_awkward_rows(spark):
    rows = made(3, 80)
    rows += [(None, rows[0][1], 1), (500, None, 1), (501, [1.0, None, 0.0, 0.0, 0.0], 1), (502, [float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (503, [float("inf"), 0.0, 0.0, 0.0, 0.0], 0), (504, rows[1][1], None), (505, [1.0, 2.0], 1), (506, [], 1), (507, [0.0] * 5, 0)]
    rows += [rows[0], rows[0], (0, rows[5][1], 2), (14, rows[9][1], 1)]  # repeated rows and ids
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 7 == 0, **SMALL)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 7 == 0)
    assert negatives.hard_negatives(frame(spark, rows).limit(0), F.col("vec_id") % 7 == 0).collect() == []
    assert negatives.hard_negatives(frame(spark, rows), F.lit(False)).collect() == []


@pytest.mark.parametrize("size", [2e4, 1.5e6])
def test_large_components_stay_exact(spark, size):
    rows = [(i, [x * size for x in v], label) for i, v, label in made(4, 60)]
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, **SMALL)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 5 == 0)


def test_components_out_of_range_do_not_fail(spark):
    rows = [(i, [x * 1e300 for x in v], label) for i, v, label in made(4, 30)]
    assert negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, **SMALL).count() >= 0
