"""Evaluation, policies, ledgers, synchronisation, ingestion, governance, vault, audit, embeddings."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from quillmere.functions import redaction
from quillmere.operators import audit, embeddings, evaluation, governance, ingestion, ledger, policy, sync

CASES = "case_id string, expected array<string>, forbidden array<string>, abstain boolean, expected_ranks map<string,int>, grades map<string,int>"


def test_eval_and_suite(spark):
    cases = spark.createDataFrame([("a", ["x"], ["z"], False, {"x": 1}, {}), ("b", ["y"], [], False, {"y": 1}, {"y": 3}), ("c", [], [], True, {}, {})], CASES)
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "z", 2), ("b", "w", 1), ("b", "y", 2)], "query_id string, id string, rank int")
    packets = spark.createDataFrame([("a", ["x"]), ("b", ["w", "y"])], "query_id string, injected array<string>")
    rows = {r.case_id: r for r in evaluation.run_cases(cases, ranked, packets).collect()}
    assert rows["a"].passed and not rows["b"].passed and rows["b"].rank_violations == ["y"] and rows["c"].passed
    assert rows["b"].reciprocal_rank == 0.5 and rows["b"].recall_1 == 0.0 and abs(rows["b"].ndcg_5 - 1 / 1.584962500721156) < 1e-9
    s = evaluation.suite(evaluation.run_cases(cases, ranked, packets)).first()
    assert (s.total, s.passed, s.recall_1, s.mrr, s.abstention_precision) == (3, 2, 0.5, 0.75, 1.0)


def test_calibration_picks_safety_first(spark):
    cases = spark.createDataFrame([("a", ["x"], ["z"], False), ("b", [], [], True)], "case_id string, expected array<string>, forbidden array<string>, abstain boolean")
    cands = spark.createDataFrame([("a", "x", 0.9, 0.9), ("a", "z", 0.9, 0.2), ("b", "y", 0.6, 0.1)], "case_id string, id string, base double, model double")
    feedback = spark.createDataFrame([("z", "not_useful")], "memory_id string, usefulness string")
    grid = spark.createDataFrame(list(itertools.product((0.3, 0.5, 0.7), (0.2, 0.8), (1, 3))), "min_score double, base_weight double, result_limit int")
    rows = evaluation.calibrate(cases, cands, feedback, grid).orderBy("place").collect()
    assert len(rows) == 12 and rows[0].false_injections == 0 and rows[0].abstention_failures == 0 and rows[0].recall == 1.0 and rows[0].min_score == 0.7 and rows[0].base_weight == 0.2


def test_policy_mining_counts_runs_once_and_needs_a_scope(spark):
    runs = spark.createDataFrame([(f"r{n}", ["d"] if n < 4 else [], [], []) for n in range(8)], "query_run_id string, domains array<string>, scenarios array<string>, project_keys array<string>")
    row = lambda run, reason, **m: (run, "m", m.get("use"), reason, ["good"], ["bad"])
    f = [row("r0", "missing_expected")] * 5 + [row("r1", "missing_expected"), row("r2", "missing_expected", use="not_useful"), row("r0", "conflicting_evidence")] + [row(f"r{n}", "stale_source") for n in range(4, 8)]
    feedback = spark.createDataFrame(f, "query_run_id string, memory_id string, usefulness string, reason string, expected_ids array<string>, forbidden_ids array<string>")
    got = policy.mine(feedback, runs).collect()
    assert len(got) == 1
    p = got[0]
    assert (p.kind, p.reason, p.runs, p.prefer, p.suppress, p.route_domains, p.decision) == ("retrieval", "missing_expected", 3, ["good"], ["bad", "m"], ["d"], None)
    again = policy.propose(policy.mine(feedback, runs), policy.mine(feedback, runs))
    assert again.count() == 1


def test_shadow_policies(spark):
    cases = spark.createDataFrame([("a", "fix the lint", ["d"], [], [], ["x"], [], False)], "case_id string, task string, domains array<string>, scenarios array<string>, project_keys array<string>, expected array<string>, forbidden array<string>, abstain boolean")
    results = spark.createDataFrame([("a", "y", 1, True), ("a", "x", 2, True), ("a", "z", 3, True)], "case_id string, id string, rank int, injected boolean")
    shape = "policy_id string, status string, domains array<string>, scenarios array<string>, project_keys array<string>, excluded_terms array<string>, all_terms array<string>, any_terms array<string>, prefer array<string>, suppress array<string>, abstain_without_preferred boolean"
    one = ("p", "shadow", ["d"], [], [], [], ["LINT"], [], ["x"], ["y"], False)
    got = policy.shadow(cases, results, spark.createDataFrame([one], shape)).first()
    assert got.matched == ["x", "z"] and got.policies == ["p"] and got.passed
    for other in (("p", "deprecated", *one[2:]), (*one[:2], ["other"], *one[3:]), (*one[:5], ["lint"], *one[6:])):
        assert policy.shadow(cases, results, spark.createDataFrame([other], shape)).first().matched == ["y", "x", "z"]
    gone = (*one[:8], ["nothing"], [], True)
    assert policy.shadow(cases, results, spark.createDataFrame([gone], shape)).first().matched == []


def test_reasoning_decisions(spark):
    context = "struct<has_unresolved_conflict: boolean, has_expired_fact: boolean, has_documented_evidence: boolean, expanded_layers: array<string>, operation_risk: string>"
    cases = spark.createDataFrame([("a", (True, False, True, ["synopsis"], "low")), ("b", (False, False, True, ["knowledge"], "high"))], f"case_id string, context {context}")
    rules = spark.createDataFrame([("a", ["unresolved_conflict"], [], "warn"), ("a", ["insufficient_detail"], ["knowledge"], "abstain"), ("b", ["expired_fact"], [], "abstain")], "case_id string, checks array<string>, required_layers array<string>, on_violation string")
    got = {r.case_id: (r.decision, r.violations) for r in policy.reasoning(cases, rules).collect()}
    assert got == {"a": ("abstain", ["insufficient_detail", "required_layer:knowledge", "unresolved_conflict"]), "b": ("proceed", [])}


def event(n, stage="query", key=None, stream="s1", **more):
    return {"stream_type": "support", "stream_id": stream, "stage": stage, "event_type": "note", "summary": f"e{n}", "project_keys": ["b", "a"], "actor_type": "owner", "capture_mode": "direct_material", "parent_event_id": None, "payload_object": None, "idempotency_key": key, "event_id": f"id{n}", "timestamp": f"2025-01-01T00:00:{n:02d}Z", **more}


def test_ledger_appends_once_and_verifies(spark):
    first = spark.createDataFrame([event(1, "intake", "k1"), event(2, parent_event_id="id1"), event(3, "closure"), event(4, "nonsense"), event(5, parent_event_id="nope")], ledger.EVENT_INPUT)
    got = ledger.append(None, first)
    assert {r.event_id: r.outcome for r in got.collect()} == {"id1": "appended", "id2": "appended", "id3": "appended", "id4": "invalid_stage", "id5": "unknown_parent"}
    kept = spark.createDataFrame(got.where("outcome = 'appended'").collect(), got.schema)
    again = ledger.append(kept, spark.createDataFrame([event(1, "intake", "k1", timestamp="2025-01-02"), event(6, "query", "k1"), event(7, "recurrence", "k2")], ledger.EVENT_INPUT))
    assert {r.event_id: r.outcome for r in again.collect()} == {"id1": "duplicate", "id6": "conflict", "id7": "appended"}
    whole = kept.unionByName(again.where("outcome = 'appended'"))
    assert ledger.verify(whole).first().valid and ledger.stream_summary(whole).first().status == "closed"
    broken = whole.withColumn("previous_hash", F.when(F.col("sequence") == 3, "x").otherwise(F.col("previous_hash")))
    assert ledger.verify(broken).first().first_bad == 3


def test_pairing_uses_the_start_right_before(spark):
    rows = [("k", "00:00:01", "start"), ("k", "00:00:02", "start"), ("k", "00:00:05", "stop"), ("k", "00:00:06", "stop"), ("j", "00:00:07", "stop"), (None, "00:00:08", "start"), (None, "00:00:09", "stop")]
    df = spark.createDataFrame([(k, f"2025-01-01 {t}", e) for k, t, e in rows], "key string, t string, event string").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r.key, r.t.second): (r.paired, r.duration_ms) for r in ledger.pair_starts(df, "key", "t", "event").where("event = 'stop'").collect()}
    assert got == {("k", 5): (True, 3000), ("k", 6): (False, None), ("j", 7): (False, None), (None, 9): (False, None)}


def plan_one(has, b, lo, r):
    if has:
        if lo == r:
            return "record_tombstone" if lo is None else "record"
        if lo != b and r != b:
            return "conflict"
        if lo != b:
            return "delete_remote" if lo is None else "push"
        return "delete_local" if r is None else "pull"
    if lo is not None and lo == r:
        return "record"
    return {(True, False): "push", (False, True): "pull", (True, True): "conflict"}.get((lo is not None, r is not None), "record_tombstone")


def test_sync_whole_matrix(spark):
    states = (None, "same", "other", "third", "deleted")
    combos = [c for c in itertools.product(states, states, states[:4]) if any(c)]
    name = lambda c: "/".join(map(str, c))
    value = lambda s: None if s == "deleted" else s
    base = spark.createDataFrame([(name(c), value(c[0]), c[0] == "deleted") for c in combos if c[0]], "path string, hash string, deleted boolean")
    remote = spark.createDataFrame([(name(c), value(c[1]), c[1] == "deleted", True) for c in combos if c[1]], "path string, hash string, deleted boolean, accessible boolean")
    local = spark.createDataFrame([(name(c), c[2]) for c in combos if c[2]], "path string, hash string")
    got = {r.path: r.action for r in sync.plan(local, remote, base).collect()}
    assert got == {name(c): plan_one(c[0] is not None, value(c[0]), c[2], value(c[1])) for c in combos}
    hidden = sync.plan(local, remote.withColumn("accessible", F.lit(False)), base).where("action in ('delete_local', 'pull')").join(remote, "path", "left_semi")
    assert hidden.count() == 0


def test_update_states(spark):
    v = "struct<path_hash: string, commit_sha: string, revision: string, etag: string, opaque_version: string, updated_at: string>"
    m = lambda i, a="available", p="p", o="v", **s: (i, a, p, o, tuple(s.get(k) for k in ingestion.SIGNALS))
    manifests = spark.createDataFrame([m("same", path_hash="A"), m("body", path_hash="a"), m("meta", path_hash="a", etag="1"), m("profile", p="old", path_hash="a"), m("lost", o=None, path_hash="a"), m("back", a="missing", path_hash="a"), m("gone", path_hash="a"), m("blind", etag="1"), m("rev", revision="1")], f"source_id string, availability string, processing_profile string, vault_object string, version {v}")
    probes = [("same", {"path_hash": "a"}), ("body", {"path_hash": "b"}), ("meta", {"path_hash": "a", "etag": "2"}), ("profile", {"path_hash": "a"}), ("lost", {"path_hash": "a"}), ("back", {"path_hash": "a"}), ("blind", {"revision": "1"}), ("rev", {"revision": "2"}), ("fresh", {})]
    p = spark.createDataFrame([(i, *[s.get(k) for k in ingestion.SIGNALS]) for i, s in probes], "source_id string, " + ", ".join(f"{k} string" for k in ingestion.SIGNALS))
    want = {"same": "unchanged", "body": "content_changed", "meta": "metadata_only", "profile": "processing_profile_changed", "lost": "evidence_missing", "back": "restored", "gone": "removed", "blind": "update_unknown", "rev": "update_unknown", "fresh": "new"}
    got = ingestion.check_updates(manifests, p, "p", complete=True)
    assert {r.source_id: r.state for r in got.collect()} == want
    assert "gone" not in {r.source_id for r in ingestion.check_updates(manifests, p, "p", complete=False).collect()}
    assert {r.state: r.n for r in ingestion.update_summary(got).collect()}["update_unknown"] == 2


def test_sections(spark):
    html = "<p>x</p><h1>A</h1>one<h2>B &amp; C</h2><p>two</p><h3></h3><h2>D</h2><h1>E</h1>three"
    got = ingestion.sections(spark.createDataFrame([("s", html), ("t", "plain"), ("u", None)], "source_id string, content string")).orderBy("source_id", "position").collect()
    assert [(r.source_id, r.heading_path) for r in got] == [("s", ["A"]), ("s", ["A", "B & C"]), ("s", ["A", "D"]), ("s", ["E"]), ("t", ["body"]), ("u", ["body"])]
    assert got[3].text_hash == "sha256:" + hashlib.sha256(b"three").hexdigest() and got[2].text_hash == "sha256:" + hashlib.sha256(b"D").hexdigest()
    assert all(html[r.char_start :].startswith("<h") for r in got[:4])


def test_redaction_order(spark):
    rows = ["Authorization: Bearer abcdefghijklmnop1234", "password = hunter2hunter2", "mail a.b@c.org or +86 13812345678", "order=12345678901234", "sk-abcdefghijklmnopqrstuv", None]
    df = redaction.redact(spark.createDataFrame([(n, t) for n, t in enumerate(rows)], "n int, t string"), "t").orderBy("n").collect()
    assert [r.redactions for r in df[:5]] == [{"authorization_header": 1}, {"secret_assignment": 1}, {"phone": 1, "email": 1}, {}, {"openai_style_key": 1}]
    assert df[1].redacted == "password = [REDACTED_SECRET]" and df[5].redacted is None


def test_governance_status_order(spark):
    cols = "id string, layer string, kind string, body string, capture_mode string, actor_type string, source_authority string, confidence double"
    long = "b" * 300
    rows = [("thin", "knowledge", "semantic", "b", "direct_material", "owner", "user_confirmed", 1.0), ("auto", "knowledge", "semantic", long, "automated_session", "owner", "user_confirmed", 1.0), ("user", "knowledge", "semantic", long, "explicit_remember", "owner", "user_confirmed", 0.1), ("doc", "knowledge", "semantic", long, "direct_material", "owner", "documented", 0.8), ("weak", "knowledge", "semantic", long, "direct_material", "owner", "documented", 0.79), ("proc", "knowledge", "procedural", long, "verified_task", "agent", "verified_task", 0.75), ("profile", "knowledge", "profile", "b", "explicit_remember", "owner", "user_confirmed", 1.0)]
    got = {r.id: r.s for r in spark.createDataFrame(rows, cols).withColumn("s", governance.candidate_status()).collect()}
    assert got == {"thin": "proposed", "auto": "proposed", "user": "active", "doc": "active", "weak": "proposed", "proc": "active", "profile": "active"}


def test_skill_needs_three_sessions_and_feedback(spark):
    rows = [(f"o{n}", "procedural", "D", " T ", "s", "verified_task", None, None, f"sess{n}", "m", None) for n in range(3)]
    obs = spark.createDataFrame(rows, "id string, kind string, domain string, title string, summary string, source_authority string, supersedes string, conflicts_with string, session_hash string, target string, useful_feedback int")
    f = lambda n: spark.createDataFrame([("m", n)], "memory_id string, net long")
    assert governance.propose_skills(obs, f(3)).count() == 1 and governance.propose_skills(obs, f(2)).count() == 0
    assert governance.propose_skills(obs.where("id <> 'o2'"), f(9)).count() == 0
    assert governance.propose_skills(obs.withColumn("conflicts_with", F.when(F.col("id") == "o1", "x")), f(9)).count() == 0


def test_vault_round_trip(spark):
    empty = spark.createDataFrame([], "vault_id string, key_id string, bytes long, sealed binary")
    tombs = spark.createDataFrame([], "vault_id string")
    key = "0123456789abcdef0123456789abcdef"
    content = spark.createDataFrame([(b"one",), (b"two",), (b"one",)], "content binary")
    vault = governance.vault_put(empty, tombs, content, key, "k1")
    vault = spark.createDataFrame(vault.collect(), vault.schema)
    assert vault.count() == 2 and governance.vault_status(vault).first().bytes == 6
    ids = vault.select("vault_id")
    assert {bytes(r.content) for r in governance.vault_get(vault, ids, key, "k1").collect()} == {b"one", b"two"}
    left, tombs = governance.vault_delete(vault, tombs, ids.limit(1))
    assert left.count() == 1 and tombs.count() == 1
    with pytest.raises(Exception, match="deleted for good|another key"):
        governance.vault_put(left, tombs, content, key, "k1").collect()
    with pytest.raises(Exception):
        governance.vault_get(vault, ids, "x" * 32, "k1").collect()


def test_audit_finds_what_is_wrong(spark):
    from quillmere import schemas
    from tests.test_retrieval import doc

    anchor = {"source_id": "s1", "section_id": "sec1", "quote_hash": "h1", "char_start": 0, "char_end": 1}
    claim = lambda i, h: {"id": i, "statement": "s", "status": "supported", "confidence": 1.0, "evidence": [{**anchor, "quote_hash": h}]}
    docs = spark.createDataFrame([doc("k_ok", "t", "b" * 700, claims=[claim("c1", "h1")], source=["source:s1"]), doc("k_bad", "t", "thin", claims=[claim("c2", "old")], source=["source:s9"], project_keys=["p?"])], schemas.schema("knowledge"))
    shape = schemas.schema("manifest")
    row = lambda i, **m: {"source_id": i, "connector": "c", "title": i, "content_hash": "x", "availability": "available", "version": {"path_hash": "p"}, "sections": [{"section_id": "sec1", "heading_path": [], "text_hash": "h1", "char_start": 0, "char_end": 1}], "processing_status": "refined", "processed_content_hash": "x", "refined_knowledge_ids": ["k_ok"], "project_keys": [], "vault_object": "v1", **m}
    manifests = spark.createDataFrame([row("s1"), row("s2", processing_status="duplicate", duplicate_of="s2", vault_object=None), row("s3", processing_status="pending", version=None, availability="missing", vault_object="v2")], shape).withColumn("redaction_policy", F.lit("secrets-and-pii"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    got = audit.findings(docs, manifests, empty("project_key string"), spark.createDataFrame([("v1",)], "vault_id string"), empty("connector_id string, state string, updates_available int, verification_required int"), empty("connector_id string, mode string, complete boolean, unresolved int, failures array<struct<source_id: string, error: string>>"), empty("stream_id string, valid boolean, first_bad long"), empty("event_id string, payload_object string"))
    codes = sorted((r.code, r.subject) for r in got.collect())
    assert codes == sorted([("knowledge_body_too_thin", "k_bad"), ("unknown_evidence_anchor", "k_bad"), ("missing_source_manifest", "k_bad"), ("unknown_project_key", "k_bad"), ("invalid_duplicate_source", "s2"), ("source_without_vault_object", "s2"), ("missing_vault_object", "s3"), ("source_without_refined_knowledge", "s3"), ("source_without_upstream_version", "s3"), ("source_missing_upstream", "s3")])
    s = audit.summary(docs, manifests).first()
    assert (s.source_documents, s.classified_sources, s.claim_coverage, s.knowledge_documents) == (3, 2, 0.5, 2)


def test_embeddings_refresh_and_aliases(spark):
    embed = lambda df: embeddings.hash_embed(df, "id", "text", 32)
    docs = spark.createDataFrame([("a", "p", "alpha beta"), ("b", "p", ""), ("c", "p", "gamma")], "id string, path string, text string")
    first, n = embeddings.refresh(spark.createDataFrame([], "id string, path string, content_hash string, vector array<double>"), docs, embed)
    assert n.first().computed == 3
    first = spark.createDataFrame(first.collect(), first.schema)
    second, n = embeddings.refresh(first, docs.where("id <> 'c'").withColumn("text", F.when(F.col("id") == "a", "alpha").otherwise(F.col("text"))), embed)
    assert (n.first().reused, n.first().computed, n.first().removed) == (1, 1, 1) and second.count() == 2
    items = spark.createDataFrame([("a", "alpha beta", "alpha text", ["alpha"])], "id string, title string, synopsis string, aliases array<string>")
    got = {r.alias: r for r in embeddings.suggest_aliases(items, first, embed, spark.createDataFrame([("a", "find omega")], "id string, task string")).collect()}
    assert "alpha" not in got and got["omega"].score >= 0.85 and len(got) <= 5
    with pytest.raises(ValueError):
        embeddings.require_profile(spark.createDataFrame([("x",)], "provider string").select("provider", *[F.lit(None).alias(c) for c in embeddings.PROFILE[1:]]), {"provider": "y"})
