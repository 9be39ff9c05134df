"""What cuts of candidates, judgements and alphabets would lose, on small tables made for it."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text
from quillmere.plans import search


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables as a directory of inputs."""

    def write(**rows):
        for name, (values, schema) in rows.items():
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


DOCUMENTS, BENCHMARK, EMBEDDINGS = "doc_id long, text string", "item_id long, text string", "vec_id long, embedding array<float>"


def test_hybrid_rrf_ranks_every_lexical_hit(spark, tables):
    docs = [(n, "alpha" + " z" * n) for n in range(1, 41)] + [(n, "other words") for n in range(41, 141)]
    vectors = [(1000, [1.0, 0.0])] + [(n, [1.0, 0.0] if n == 30 else [0.0, 1.0]) for n in range(1, 141)]
    at = tables(documents=(docs, DOCUMENTS), benchmark=([(1000, "alpha")], BENCHMARK), embeddings=(vectors, EMBEDDINGS))
    got = [(r.doc_id, r.rrf) for r in search.hybrid_rrf(spark, at).orderBy("rank").collect()]
    share = lambda *ranks: round(sum(1 / (60 + r) for r in ranks) / (3 / 61), 6)
    assert got == [(30, share(30, 1)), (1, share(1)), (2, share(2)), (3, share(3)), (4, share(4))]


def test_eval_metrics_judges_all_documents(spark, tables):
    docs = [(n, "alpha beta") for n in range(1, 9)] + [(n, "gamma " + "z " * n) for n in range(11, 17)] + [(20, "xdeltax/xomegax"), (21, None)] + [(n, "other words") for n in range(30, 60)]
    at = tables(documents=(docs, DOCUMENTS), benchmark=([(1, "alpha beta"), (2, "gamma delta omega sigma"), (3, "nowhere")], BENCHMARK))
    got = {r.item_id: tuple(r)[1:] for r in search.eval_metrics(spark, at).collect()}
    assert got == {1: (8, 0.125, 0.375, 1.0, 1.0), 2: (1, 0.0, 0.0, 0.0, 0.0), 3: (0, 1.0, 1.0, 1.0, 1.0)}


def test_index_terms_remove_every_accent(spark):
    words = "Čeština Šťastný ŐŰ ąę Ăn Việt Ứng Ğ Åström й 한국".split()
    plain = [unicodedata.normalize("NFD", w) for w in "cestina stastny ou ae an viet ung g astrom и 한국".split()]
    rows = [(unicodedata.normalize(form, " ".join(words)),) for form in ("NFC", "NFD")]
    for r in spark.createDataFrame(rows, "t string").select(text.index_terms(F.col("t")).alias("t")).collect():
        assert r.t == plain


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_normalised", "evidence_gate", "token_stats", "context_budget"])
def test_accents_outside_latin_1_as_in_the_sql(spark, tables, name):
    import duckdb

    said = ["žluťoučký kůň", "zlutoucky kun pěl", "őrült űr", unicodedata.normalize("NFD", "őrült űr crème"), "Việt Nam", "viet nam xa", "ăn cơm", "şarkı ğ", "łódź"]
    docs = [(n, t, "xx") for n, t in enumerate(said + ["nothing here"] * 20)]
    at = tables(documents=(docs, DOCUMENTS + ", lang string"), benchmark=([(1, "žluťoučký kůň"), (2, "őrült űr"), (3, "Việt Nam ăn")], BENCHMARK))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    cur = con.execute(search.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(tuple(r[c] for c in columns) for r in search.QUERIES[name](spark, at).collect()) == sorted(cur.fetchall())
