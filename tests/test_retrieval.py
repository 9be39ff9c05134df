"""Ranking, access, packets and graphs on a small corpus."""

import json

import pytest
from pyspark.sql import functions as F

from quillmere import schemas
from quillmere.functions import access, text
from quillmere.operators import graph, packet, retrieval
from quillmere.operators.index import Index


def doc(i, title, body, domain="frontend/lint", kind="semantic", **more):
    base = {
        "id": i, "kind": kind, "layer": "knowledge", "title": title, "synopsis": more.pop("synopsis", title), "aliases": [], "domain": domain, "related_domains": [],
        "scenarios": [{"id": "code-review", "role": "primary", "weight": 1.0}], "tags": [], "status": "active", "confidence": 0.9, "source_authority": "documented", "source": [f"note:{i}"], "claims": [],
        "related_knowledge": [], "supersedes": [], "conflicts_with": [], "visibility": "project", "sensitivity": "internal", "project_keys": [], "episodes": [], "valid_from": "2024-01-01", "valid_until": None, "body": body, "file_path": f"knowledge/{i}.md",
    }
    return {**base, **more}


@pytest.fixture(scope="module")
def corpus(spark):
    alias = [{"value": "sfc fallback", "kind": "term", "weight": 0.9, "source": "x"}]
    rows = [
        doc("k_vue", "Vue SFC ESLint fallback", "Use the vue parser as eslint fallback when a template fails to lint.", aliases=alias, related_knowledge=[{"id": "k_review", "relation": "often_used_with", "reason": "r"}]),
        doc("k_review", "Review checklist", "Check naming and tests before merging.", domain="process/review", kind="procedural"),
        doc("k_mysql", "MySQL DDL online change", "Run mysql_ddl with pt-online-schema-change for large tables.", domain="database/mysql"),
        doc("k_secret", "Secret eslint notes", "Vue parser eslint fallback secret template lint notes.", sensitivity="secret"),
        doc("k_old", "Old eslint fallback", "Vue eslint fallback lint template parser.", valid_until="2024-06-01"),
        doc("k_gone", "Gone", "eslint", status="deprecated"),
        doc("k_source", "Raw source", "eslint fallback", kind="source"),
        doc("k_other", "Other project eslint", "Vue eslint fallback lint parser template.", project_keys=["p9"]),
        doc("k_han", "退款流程", "客户申请退款时先核对订单状态。", domain="support/refund", conflicts_with=["k_x"]),
        *[doc(f"k_fill{n}", f"Filler {n}", f"Words that stand for nothing number {n} in this corpus.", domain="misc/fill") for n in range(12)],
    ]
    return spark.createDataFrame(rows, schemas.schema("knowledge"))


def ask(spark, task, **more):
    row = {"query_id": "q", "task": task, "now": "2025-01-01", **more}
    kinds = {"query_id": "string", "task": "string", "now": "string", "domains": "array<string>", "scenarios": "array<string>", "project_keys": "array<string>", "max_tokens": "int", "clearance": "string"}
    return schemas.requests(spark.createDataFrame([row], ", ".join(f"{k} {kinds[k]}" for k in row)))


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_lexical_order_access_and_relations(spark, corpus):
    got = retrieval.retrieve(ask(spark, "vue eslint fallback for template lint"), corpus)
    found = ids(got)
    assert found[0] == "k_vue" and "k_review" in found
    assert not {"k_secret", "k_old", "k_other", "k_gone", "k_source"} & set(found)
    rows = {r.id: r for r in got.collect()}
    assert rows["k_review"].relation == 1.0 and rows["k_review"].lexical == 0.0 and rows["k_vue"].lexical <= 1.0


def test_secure_ranking_makes_the_best_visible_row_one(spark, corpus):
    asked = ask(spark, "vue eslint fallback for template lint")
    open_ = {r.id: r for r in retrieval.retrieve(asked, corpus).collect()}
    safe = {r.id: r for r in retrieval.retrieve(asked, corpus, secure_ranking=True).collect()}
    assert safe["k_vue"].lexical == 1.0 and open_["k_vue"].lexical <= 1.0 and set(safe) == set(open_)


def test_no_match_abstains_and_scope_falls_back(spark, corpus):
    assert ids(retrieval.retrieve(ask(spark, "zzzz qqqq"), corpus)) == []
    assert "k_mysql" in ids(retrieval.retrieve(ask(spark, "zzzz qqqq", domains=["database"]), corpus))


def test_phrases_need_neighbours(spark, corpus):
    docs = retrieval.prepare(corpus)
    index = Index.of_knowledge(docs)
    phrases = spark.createDataFrame([("q", "mysql_ddl"), ("q", "ddl_mysql"), ("q", "eslint")], "query_id string, phrase string")
    got = {(r.phrase, r.id): r.f for r in index.frequencies(phrases).collect()}
    assert got["mysql_ddl", "k_mysql"] == 3 and not any(p == "ddl_mysql" for p, _ in got)  # title, synopsis, body


def test_han_recall(spark, corpus):
    assert ids(retrieval.retrieve(ask(spark, "退款流程"), corpus))[:1] == ["k_han"]


def test_rerank_sees_a_window_and_sorts_ties_by_id(spark):
    rows = [("q", f"d{n:02d}", 0.9 - n / 100, {"task": "a b"}, {"coverage_text": "a b"}) for n in range(40)]
    ranked = spark.createDataFrame(rows, "query_id string, id string, final double, q struct<task: string>, d struct<coverage_text: string>")
    seen = []

    def model(top):
        seen.append(top.count())
        return top.withColumn("model", F.lit(0.8))

    got = retrieval.rerank(ranked, model, base_weight=0.0)
    assert seen == [30] and ids(got) == [f"d{n:02d}" for n in range(8)]


def test_packet_stays_within_its_budget(spark, corpus):
    ranked = retrieval.retrieve(ask(spark, "vue eslint fallback for template lint", max_tokens=400), corpus)
    got = packet.build(ranked).collect()
    assert len(got) == 1 and got[0].tokens <= 400 and json.loads(got[0].packet)["claims"][0]["id"] == "k_vue"
    tight = packet.fill({"agent_role": "x", "domains": [], "scenarios": [], "project_keys": [], "max_tokens": 200}, [{"kind": "semantic", "content": {"id": str(k), "title": "t" * n, "source": []}, "handles": [], "commands": [], "conflicts": []} for k, n in enumerate((300, 4000, 20))])
    assert [c["id"] for c in tight["claims"]] == ["0", "2"]
    with pytest.raises(ValueError):
        packet.fill({"agent_role": "x", "domains": [], "scenarios": [], "project_keys": [], "max_tokens": 10}, [])


def test_graph_walks_two_levels_and_keeps_to_allowed_edges(spark):
    e = [("e1", "a", "b", "supports"), ("e2", "b", "c", "refines"), ("e3", "c", "d", "conflicts_with"), ("e4", "c", "a", "depends_on"), ("e0", "b", "a", "refines")]
    edges = spark.createDataFrame([(*x, "{}") for x in e], schemas.schema("edges"))
    start = spark.createDataFrame([("q", "a")], "query_id string, id string")
    got = {r.id: (r.depth, r.score, r.type) for r in graph.expand(start, edges, 2).collect()}
    assert got == {"b": (1, 0.6, "refines"), "c": (1, 0.6, "depends_on")}
    with pytest.raises(ValueError):
        graph.expand(start, edges, 3)


def test_graph_build_and_widened_results(spark, corpus):
    nodes, edges = graph.build(corpus)
    kinds = {r.type: r.n for r in nodes.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds["knowledge"] == corpus.count() and kinds["scenario"] == 1
    assert edges.where("type = 'conflicts_with'").count() == 1 and edges.select("id").distinct().count() == edges.count()
    n, e = graph.query(nodes, edges, ids=["knowledge:k_vue"], depth=1)
    assert "knowledge:k_review" in {r.id for r in n.collect()} and e.count() >= 4
    ranked = retrieval.retrieve(ask(spark, "mysql ddl online change"), corpus)
    wide = retrieval.add_graph(ranked, ask(spark, "mysql ddl online change"), corpus, edges)
    assert set(ids(ranked)) <= set(ids(wide))
    lines = [r.line for r in graph.mermaid(nodes, edges).collect()]
    assert lines[0] == "graph LR" and len(lines) == 1 + nodes.count() + edges.count()


def test_labels_and_tokens(spark):
    c = lambda f, *a: spark.range(1).select(f(*[F.lit(x) for x in a]).alias("x")).first().x
    assert c(access.domain_matches, "frontend/lint", "Frontend") and not c(access.domain_matches, "frontend", "front")
    assert c(access.fuzzy_matches, "vue lint", "lint") and not c(access.fuzzy_matches, "a/lint", "b/lint")
    assert c(text.query_tokens, "Vue-SFC 退款流 a vue-sfc x_y") == ["vue-sfc", "x_y", "退款", "款流", "退款流"]
    assert c(text.cjk_ngrams, "退") == [] and c(text.estimate_tokens, "退款abcde") == 4 and c(text.estimate_tokens, "😀😀a") == 2
    assert c(text.normalise_label, "  A__b  C--d ") == "a-b-c-d" and c(text.snake, "SubagentStop") == "subagent_stop"


def test_access_is_never_widened(spark, corpus):
    docs = retrieval.prepare(corpus)
    q = ask(spark, "x")
    pairs = docs.select(F.struct(*docs.columns).alias("d")).crossJoin(q.select(F.struct(*q.columns).alias("q")))
    for level, more in (("public", 0), ("internal", 1), ("secret", 2)):
        n = pairs.withColumn("q", F.col("q").withField("clearance", F.lit(level))).where(access.is_accessible("d", "q")).count()
        assert n == {0: 0, 1: 16, 2: 17}[more]
