"""Steps whose work must not grow faster than their input."""

import random

from pyspark.sql import functions as F

from quillmere.operators import graph


def _name(c):
    return F.split(c, ":")[0]


def test_counts_of_reached_nodes_equal_those_of_expand(spark):
    rng = random.Random(3)
    pairs = {(f"{'abc'[i % 3]}:{i}", f"{'abc'[j % 3]}:{j}") for i, j in ((rng.randrange(25), rng.randrange(25)) for _ in range(45))}
    edges = spark.createDataFrame([(f"e{n}", a, b, "supports" if n % 5 else "supersedes") for n, (a, b) in enumerate(sorted(pairs))], "id string, source string, target string, type string")
    start = spark.createDataFrame([(n // 2, f"{'abc'[n % 3]}:{n}") for n in range(30)] + [(1, "a:3"), (None, "a:0")], "query_id int, id string")
    for depth in (1, 2):
        want = graph.expand(start, edges, depth).groupBy("query_id", "depth", _name("id").alias("kind")).agg(F.count("*").alias("n"), F.max("score").alias("score"))
        got = graph.expand_counts(start.where("query_id is not null"), edges, _name, depth)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.where("query_id is not null").collect()))


def test_a_hub_is_counted_once_for_all_who_share_it(spark):
    leaves = spark.range(20_000).select(F.concat(F.lit("leaf:"), "id").alias("source"), F.lit("hub:1").alias("target"), F.lit("supports").alias("type"), F.concat(F.lit("e"), "id").alias("id"))
    start = spark.range(20_000).select(F.col("id").alias("query_id"), F.concat(F.lit("leaf:"), "id").alias("id"))
    rows = graph.expand_counts(start, leaves, _name, 2).groupBy("depth", "kind", "n", "score").count()  # 400 million pairs if each request had its own
    assert sorted(map(tuple, rows.collect())) == [(1, "hub", 1, 0.6, 20_000), (2, "leaf", 19_999, 0.36, 20_000)]


def test_prompts_meet_items_without_a_row_for_each_pair(spark):
    items = spark.createDataFrame([(f"k_{n}", f"alpha w{n % 3}", "", "en" if n % 2 else None, None if n % 50 == 49 else n % 10 / 10) for n in range(400)] + [("k_7", "alpha again", "", "en", 0.7)], "id string, title string, summary string, domain string, confidence double")
    prompts = spark.createDataFrame([(n, ["alpha w1 en", "alpha w2", "show knowledge", "nothing here", "alpha k_7 again"][n % 5]) for n in range(300)] + [(1, "alpha w2"), (8, "en")], "query_id int, task string")
    from quillmere.functions import text
    from quillmere.operators import embeddings

    terms = lambda df, key, *c: df.select(key, F.explode(F.array_distinct(text.terms(F.concat_ws(" ", *c)))).alias("term"))
    pairs = terms(prompts, "query_id", "task").where(~F.col("term").isin(*embeddings.STOP_TERMS)).join(terms(items, "id", "id", "title", "summary", "domain"), "term").groupBy("query_id", "id").count()
    sure = {r.id: r.confidence for r in items.collect()}
    want = {}
    for r in pairs.collect():
        want.setdefault(r.query_id, []).append((-r["count"], sure[r.id] is None, -(sure[r.id] or 0), r.id))
    got = {}
    found = embeddings.filter_catalogue(items, prompts)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.hits, r.id))
    free = [(0, f"k_{n}") for n in sorted((n for n in range(400) if n % 10 == 9 and n % 50 != 49), key=str)[:5]]
    assert got == {**{q: [(r[0], r[3]) for r in sorted(v)[:5]] for q, v in want.items()}, **{n: free for n in range(2, 300, 5)}}
    assert "Join Inner, (term" not in found._jdf.queryExecution().optimizedPlan().toString()  # a row for each prompt, item and term


def test_texts_of_an_index_are_not_one_tasks_to_sort(spark, tmp_path):
    from quillmere.operators.index import Index

    docs = spark.range(0, 400, 1, 4).select("id", F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), "id"), F.repeat(F.lit("filler "), 50)).alias("text"))
    index = Index.build(docs, {"body": F.col("text")}, evidence=F.col("text"), path=f"{tmp_path}/i")
    assert len(list((tmp_path / "i" / "bucket=-1").glob("*.parquet"))) == 4
    assert sorted(i for r in index.table.where("bucket = -1").collect() for i in r.ids) == list(range(400))
    assert index.table.where("term = 'common'").agg(F.sum("df")).first()[0] == 400


def test_lists_of_matching_labels_agree_with_tests_of_every_pair(spark):
    from quillmere.functions import access
    from quillmere.operators import retrieval

    labels = ["", "-", "/", "/foo", "-/foo", "a", "A b", "a-b", "a/b", "a_b/c", "b/a", "Topic 3", "topic_3", "topic-3/x", "3", "--", "//a", None]
    docs = spark.createDataFrame([(f"d{n}", x, [labels[n - 1]], [labels[n - 5]], [labels[n - 7]] if n % 3 else []) for n, x in enumerate(labels)], "id string, domain string, related_domains array<string>, alias_values array<string>, scenario_ids array<string>")
    asked = spark.createDataFrame([(f"q{n}", f"see {x} and topic_3/a", [x] if n % 2 else [], [labels[n - 3], "a"] if n % 3 else []) for n, x in enumerate(labels)], "query_id string, task string, domains array<string>, scenarios array<string>")
    both = retrieval.with_matching(asked, docs).crossJoin(docs)
    own = F.concat(F.array("domain"), "related_domains")
    tests = [(own, "domains", "path_domains", access.domain_matches), (F.col("alias_values"), "domains", "like_domains", access.fuzzy_matches), (F.concat("scenario_ids", "alias_values"), "scenarios", "like_scenarios", access.fuzzy_matches)]
    rows = both.select(*[F.struct(access.any_pair(mine, F.col(theirs), test), retrieval._any_of(mine, F.col(found))).alias(found) for mine, theirs, found, test in tests])
    assert [tuple(x) for r in rows.collect() for x in r if x[0] != x[1]] == []
    shares = {(r.query_id, r.id): r.share for r in retrieval.alias_shares(docs, asked).collect()}
    for r in asked.crossJoin(docs).select("query_id", "id", access.alias_coverage(F.col("alias_values"), F.col("task")).alias("share")).collect():
        assert shares.get((r.query_id, r.id), 0.0) == (r.share or 0.0)


def test_scores_of_labels_without_pairs_are_those_of_all_pairs(spark):
    from quillmere.operators import retrieval

    none = "cast(array() as array<string>)"
    docs = spark.range(30).selectExpr("concat('d', id) as id", "concat('en/s', id % 5) as domain", f"{none} as related_domains", "cast(array() as array<struct<value: string, weight: double>>) as aliases", "array(named_struct('id', concat('t ', id % 3), 'weight', 0.5D)) as scenarios", "cast(null as array<struct<value: string, weight: double, retrieval: boolean>>) as tags")
    asked = spark.createDataFrame([("q1", "about en/s1 and t 2", [], []), ("q2", "nothing", [], ["T_1"]), ("q3", "", [], [])], "query_id string, task string, domains array<string>, scenarios array<string>")
    pairs = docs.select("id").crossJoin(asked.select("query_id"))
    rows = lambda p: sorted((r.query_id, r.id, round(r.metadata, 9)) for r in retrieval.metadata_scores(p, docs, asked).collect())
    assert rows(None) == rows(pairs) != []


def test_a_ledger_is_made_once_to_be_verified(spark, tmp_path, monkeypatch):
    from quillmere.operators import ledger
    from quillmere.plans import governed

    kinds = ["support", "initiative", "other"]
    rows = [(kinds[n % 3], f"s{n % 2}", ["query", "review", "nonsense"][n % 5 % 3], "t", f"x{n % 7}", ["b", "a"] if n % 4 else None, "o", "m", f"e{n - 6}" if n % 6 == 5 else None, None, f"k{n % 9}" if n % 3 else None, f"e{n % 50}", f"{n % 11:03d}" if n % 13 else None) for n in range(60)]
    events = spark.createDataFrame(rows, ledger.EVENT_INPUT)
    first, rest = events.where("event_id < 'e3'"), events.where("event_id >= 'e3'")
    kept = ledger.append(None, first).where("outcome = 'appended'")
    got = [r.asDict() for r in ledger.append(kept, rest).collect()]
    chains = {}
    order = lambda r: (r.timestamp is None, r.timestamp or "", r.event_id)
    want = []
    for part in (first, rest):
        want = []
        for r in sorted(part.withColumn("input_hash", ledger.input_hash()).collect(), key=order):
            want.append(chains.setdefault((r.stream_type, r.stream_id), ledger.Chain()).add(r.asDict()))
    key = lambda r: tuple(map(str, (r["stream_type"], r["stream_id"], r["timestamp"], r["event_id"], r["outcome"], r["sequence"], r["record_hash"], r["previous_hash"], r["input_hash"], r["project_keys"])))
    assert sorted(map(key, got)) == sorted(map(key, want))
    spark.sql("select 1L event_id, 2L user_id, timestamp'2025-01-01' ts, 'view' event_type, 'p' props").write.parquet(f"{tmp_path}/events.parquet")
    assert "FlatMapGroups" not in governed.ledger_verify(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_a_store_is_read_in_small_batches(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quillmere.sources import store

    (tmp_path / "parts" / "w").mkdir(parents=True)
    place = tmp_path / "parts" / "w" / "a.parquet"
    pq.write_table(pa.table({"n": list(range(5000))}), place)
    file = store.File("w/a.parquet", 5000, store._sha256(str(place)))
    batches = list(store.Reader(str(tmp_path), {"files": []}).read(file))
    assert max(b.num_rows for b in batches) <= 1024
    assert [n for b in batches for n in b.column(0).to_pylist()] == list(range(5000))


def test_rankings_leave_one_table_and_no_texts_behind(spark, tmp_path):
    from pathlib import Path

    from quillmere import schemas, storage
    from quillmere.operators import retrieval
    from tests.test_retrieval import doc

    knowledge = spark.createDataFrame([doc(f"k{n}", f"alpha {n}", "alpha beta gamma marker", related_knowledge=[{"id": "k1", "relation": "depends_on", "reason": "r"}] if n == 0 else []) for n in range(40)], schemas.schema("knowledge"))
    asked = schemas.requests(spark.createDataFrame([("q", "alpha beta gamma", "2025-01-01")], "query_id string, task string, now string"))
    folder = Path(f"{storage.shared_dir(spark)}/quillmere/{spark.sparkContext.applicationId}".removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    rows = retrieval.retrieve(asked, knowledge)
    left = {p.name[:-33] for p in folder.iterdir() if p.name not in before}
    assert "ranked" in left and not left & {"documents", "postings", "lexical", "scoped", "candidates", "labels", "direct", "related", "pool", "featured"}
    kept = [p for p in folder.iterdir() if p.name.startswith("ranked-") and p.name not in before]
    assert len(kept) == 1 and not {"q", "d"} & set(spark.read.parquet(str(kept[0])).columns)
    assert rows.where("rank <= 30 and d.body is not null").count() == 30 and rows.count() == 40


def test_rows_that_are_reranked_have_their_texts_even_where_ranks_and_scores_disagree(spark):
    from quillmere.operators import retrieval

    ranked = spark.createDataFrame([("q", f"k{n:02d}", 40 - n, 0.5) for n in range(40)], "query_id string, id string, rank int, final double")
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, task string")
    docs = spark.range(40).select(F.format_string("k%02d", "id").alias("id"), F.lit("alpha").alias("coverage_text"))
    got = retrieval.with_texts(retrieval.first_rows(ranked), asked, docs).collect()
    assert sorted(r.id for r in got) == [f"k{n:02d}" for n in range(30)] and {r.d.coverage_text for r in got} == {"alpha"}


def test_items_of_a_catalogue_are_counted_many_at_once():
    import numpy as np

    from quillmere.operators import embeddings

    rng, most = np.random.default_rng(5), 5
    classes = [sorted({f"w{n}" for n in rng.zipf(1.3, size) if n < 400}) + ["w1"] * (size % 2) for size in rng.integers(1, 50, 300)]
    best, found, want = embeddings._Best(most), {}, {}
    for n, terms in enumerate(classes):
        best.add(str(n), terms)
    for block in range(3):
        held = [[f"w{n}" for n in rng.zipf(1.2, 20) if n < 400] for _ in range(700)]  # a word twice counts twice
        layers = {}
        for item, words in enumerate(held):
            for word in set(words):
                for time in range(words.count(word)):
                    layers.setdefault((word, time), []).append(item)
        words = sorted(layers)
        lists = [layers[w] for w in words]
        for c, item, hits in zip(*(x.tolist() for x in best.block(700, [w for w, _ in words], np.cumsum([0, *map(len, lists)]), np.concatenate(lists).astype(np.int32))), strict=True):
            found.setdefault(c, []).append((-hits, block, item))
        for c, terms in enumerate(classes):
            sums = [(-sum(words.count(t) for t in terms), block, item) for item, words in enumerate(held)]
            want.setdefault(c, []).extend(x for x in sums if x[0])
    assert {c: sorted(v)[:most] for c, v in found.items()} == {c: sorted(v)[:most] for c, v in want.items() if v}
    assert sum(map(len, found.values())) <= 3 * most * len(classes)
