"""Queries over ledgers, feedback, policies, candidates, vaults, catalogues, graphs and sources, each through its operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.functions import projects, text
from quillmere.operators import embeddings, governance, graph, ingestion, ledger, policy, retrieval
from quillmere.plans import heart
from quillmere.plans.search import table
from quillmere.storage import settle


def _name(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _pick(n: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


# --------------------------------------------------------------------------- ledgers


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as lifecycle events: some of no known stage, with unknown parents or keys used before."""
    i, kind = F.col("event_id"), F.col("event_type")
    support = F.when(kind == "purchase", "closure").when(kind == "error", "escalation").when(kind == "signup", "intake").otherwise("query")
    other = F.when(kind == "purchase", "release").when(kind == "error", "incident").when(kind == "signup", "discovery").otherwise("review")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "support").otherwise("initiative").alias("stream_type"), _name("u", F.col("user_id")).alias("stream_id"),
        F.when(i % 31 == 0, "nonsense").when(F.col("user_id") % 2 == 0, support).otherwise(other).alias("stage"), kind.alias("event_type"), F.col("props").alias("summary"),
        F.array(_name("p", F.col("user_id") % 3), F.lit("a")).alias("project_keys"), F.lit("owner").alias("actor_type"), F.lit("direct_material").alias("capture_mode"), F.when(i % 17 == 0, F.lit("nobody")).alias("parent_event_id"), F.lit(None).cast("string").alias("payload_object"),
        F.when(i % 5 == 0, F.concat_ws(":", kind, F.col("user_id").cast("string"))).alias("idempotency_key"), _name("e", i).alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
    )


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every event, and the number and hash of those that entered their stream's chain."""
    return ledger.append(None, _events(spark, sf_dir)).select("event_id", "outcome", F.col("sequence").cast("long").alias("sequence"), "input_hash", "record_hash")


_LEDGER = """
inp AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'support' ELSE 'initiative' END AS st, 'u' || user_id AS sid, event_id AS i, 'e' || event_id AS eid, CAST(epoch_us(ts) AS VARCHAR) AS tm, event_id % 31 = 0 AS bad_stage, event_id % 17 = 0 AS bad_parent,
    CASE WHEN event_id % 31 = 0 THEN 'nonsense' WHEN user_id % 2 = 0 THEN CASE event_type WHEN 'purchase' THEN 'closure' WHEN 'error' THEN 'escalation' WHEN 'signup' THEN 'intake' ELSE 'query' END
      ELSE CASE event_type WHEN 'purchase' THEN 'release' WHEN 'error' THEN 'incident' WHEN 'signup' THEN 'discovery' ELSE 'review' END END AS stage,
    event_type, props, user_id, CASE WHEN event_id % 5 = 0 THEN event_type || ':' || user_id END AS k FROM events),
hashed AS (
  SELECT *, sha256('{"stream_type":"' || st || '","stream_id":"' || sid || '","stage":"' || stage || '","event_type":"' || event_type || '","summary":' || CAST(to_json(props) AS VARCHAR) || ',"project_keys":["a","p' || (user_id % 3)
    || '"],"actor_type":"owner","capture_mode":"direct_material","parent_event_id":' || CASE WHEN bad_parent THEN '"nobody"' ELSE 'null' END || ',"payload_object":null}') AS own, row_number() OVER (PARTITION BY st, sid ORDER BY tm, eid) AS n FROM inp),
firsts AS (SELECT st, sid, k, min(n) AS first, min_by(own, n) AS said FROM hashed WHERE k IS NOT NULL AND NOT bad_stage AND NOT bad_parent GROUP BY ALL),
judged AS (
  SELECT h.*, CASE WHEN bad_stage THEN 'invalid_stage' WHEN f.first < h.n THEN CASE WHEN f.said = h.own THEN 'duplicate' ELSE 'conflict' END WHEN bad_parent THEN 'unknown_parent' ELSE 'appended' END AS outcome
  FROM hashed h LEFT JOIN firsts f ON f.st = h.st AND f.sid = h.sid AND f.k = h.k),
numbered AS (SELECT *, CASE WHEN outcome = 'appended' THEN row_number() OVER (PARTITION BY st, sid, outcome ORDER BY n) END AS seq FROM judged)
"""
LEDGER_APPEND = f"""
WITH RECURSIVE {_LEDGER},
chain(st, sid, seq, hash) AS (
  SELECT st, sid, seq, sha256(chr(0) || chr(10) || '1' || chr(10) || eid || chr(10) || tm || chr(10) || own) FROM numbered WHERE seq = 1
  UNION ALL SELECT x.st, x.sid, x.seq, sha256(c.hash || chr(10) || x.seq || chr(10) || x.eid || chr(10) || x.tm || chr(10) || x.own) FROM chain c JOIN numbered x ON x.st = c.st AND x.sid = c.sid AND x.seq = c.seq + 1)
SELECT eid AS event_id, outcome, n.seq AS sequence, own AS input_hash, c.hash AS record_hash FROM numbered n LEFT JOIN chain c ON c.st = n.st AND c.sid = n.sid AND c.seq = n.seq
"""


def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a ledger in which some summaries, links and ids were changed afterwards: valid or not, and where first."""
    i = F.regexp_replace("event_id", "^e", "").cast("long")
    kept = settle(ledger.append(None, _events(spark, sf_dir)), "ledger").where("outcome = 'appended'")  # read three times
    changed = kept.withColumns({"summary": F.when(i % 997 == 0, F.concat("summary", F.lit("x"))).otherwise(F.col("summary")), "previous_hash": F.when(i % 991 == 1, F.lit("0")).otherwise(F.col("previous_hash")), "timestamp": F.when(i % 983 == 2, F.lit("0")).otherwise(F.col("timestamp"))})
    return ledger.verify(changed)


LEDGER_VERIFY = f"WITH {_LEDGER} SELECT st AS stream_type, sid AS stream_id, NOT bool_or(i % 997 = 0 OR i % 991 = 1 OR i % 983 = 2) AS valid, min(seq) FILTER (i % 997 = 0 OR i % 991 = 1 OR i % 983 = 2) AS first_bad FROM numbered WHERE seq IS NOT NULL GROUP BY ALL"


# --------------------------------------------------------------------------- feedback and policies


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(kind.isin("click", "purchase", "view"), _name("r", i % 400)).alias("query_run_id"), F.when(i % 3 != 0, _name("e", i)).alias("event_id"), F.when(i % 7 != 0, _name("m", F.col("user_id") % 20)).alias("memory_id"),
        F.format_string("%08d", F.floor(i / 50).cast("long")).alias("timestamp"), _name("f", i % 3).alias("file"), i.alias("line"), _pick(i, "useful", "not_useful", "unknown").alias("usefulness"),
        _pick(i, "wrong_route", "missing_expected", "forbidden_injection", "should_abstain", "stale_source", "insufficient_detail", "conflicting_evidence", "reasoning_failure", "other").alias("reason"),
        F.array(_name("m", i % 13)).alias("expected_ids"), F.when(i % 2 == 0, F.array(_name("m", i % 17))).alias("forbidden_ids"),
    )


_FEEDBACK = """
fb AS (
  SELECT CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'r' || (event_id % 400) END AS run, CASE WHEN event_id % 3 <> 0 THEN 'e' || event_id END AS eid, CASE WHEN event_id % 7 <> 0 THEN 'm' || (user_id % 20) END AS mem,
    event_id // 50 AS tm, 'f' || (event_id % 3) AS file, event_id AS line, ['useful', 'not_useful', 'unknown'][event_id % 3 + 1] AS usefulness,
    ['wrong_route', 'missing_expected', 'forbidden_injection', 'should_abstain', 'stale_source', 'insufficient_detail', 'conflicting_evidence', 'reasoning_failure', 'other'][event_id % 9 + 1] AS reason, 'm' || (event_id % 13) AS good, CASE WHEN event_id % 2 = 0 THEN 'm' || (event_id % 17) END AS bad FROM events)
"""


def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest feedback of each key (memory and run, else event, else place in the log)."""
    return policy.latest_feedback(_feedback(spark, sf_dir)).select("file", "line", "memory_id", "query_run_id", "usefulness")


LEDGER_LATEST = f"""
WITH {_FEEDBACK}
SELECT file, line, mem AS memory_id, run AS query_run_id, usefulness FROM fb
QUALIFY row_number() OVER (PARTITION BY CASE WHEN run IS NOT NULL THEN coalesce(mem, 'query') || chr(0) || run WHEN eid IS NOT NULL THEN eid ELSE 'file:' || line END ORDER BY tm DESC, file DESC, line DESC) = 1
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 400
    rows = table(spark, sf_dir, "events").select(n.alias("n")).distinct()
    n = F.col("n")
    return rows.select(_name("r", n).alias("query_run_id"), F.when(n % 3 != 0, F.array(_name("d", n % 5))).otherwise(_none()).alias("domains"), F.when(n % 4 == 0, F.array(_name("s", n % 2), F.lit("a"))).otherwise(_none()).alias("scenarios"), _none().alias("project_keys"))


def mining_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy proposals mined from feedback: reasons and scopes that at least three runs share."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    return policy.mine(_feedback(spark, sf_dir), _runs(spark, sf_dir)).select("policy_id", "kind", "status", "reason", F.to_json("scope").alias("scope"), "runs", *map(joined, ("evidence", "prefer", "suppress", "route_domains")), "abstain", "decision")


_RUNS = "runs AS (SELECT 'r' || n AS run, CASE WHEN n % 3 <> 0 THEN ['d' || (n % 5)] ELSE []::VARCHAR[] END AS domains, CASE WHEN n % 4 = 0 THEN list_sort(['s' || (n % 2), 'a']) ELSE []::VARCHAR[] END AS scenarios FROM (SELECT DISTINCT event_id % 400 AS n FROM events))"
MINING_GROUPS = f"""
WITH {_FEEDBACK}, {_RUNS},
j AS (SELECT fb.*, '{{"domains":' || CAST(to_json(domains) AS VARCHAR) || ',"scenarios":' || CAST(to_json(scenarios) AS VARCHAR) || ',"project_keys":[]}}' AS scope, domains FROM fb JOIN runs USING (run) WHERE reason <> 'other' AND (len(domains) > 0 OR len(scenarios) > 0)),
g AS (
  SELECT reason, scope, any_value(domains) AS domains, list_sort(list(DISTINCT run)) AS evidence, list_sort(list(DISTINCT good)) AS prefer, coalesce(list(DISTINCT bad) FILTER (bad IS NOT NULL), []) AS bad, coalesce(list(DISTINCT mem) FILTER (usefulness = 'not_useful' AND mem IS NOT NULL), []) AS disliked
  FROM j GROUP BY reason, scope),
p AS (SELECT *, reason IN ('wrong_route', 'missing_expected', 'forbidden_injection', 'should_abstain', 'stale_source') AS r FROM g WHERE len(evidence) >= 3)
SELECT 'policy_mined_' || CASE WHEN r THEN 'retrieval' ELSE 'reasoning' END || '_' || sha256(reason || chr(0) || scope || chr(0) || CAST(to_json(evidence) AS VARCHAR))[1:16] AS policy_id, CASE WHEN r THEN 'retrieval' ELSE 'reasoning' END AS kind, 'shadow' AS status, reason, scope,
  len(evidence) AS runs, array_to_string(evidence, ',') AS evidence, CASE WHEN r THEN array_to_string(prefer, ',') ELSE '' END AS prefer, CASE WHEN r THEN array_to_string(list_sort(list_distinct(list_concat(bad, disliked))), ',') ELSE '' END AS suppress,
  CASE WHEN reason IN ('wrong_route', 'missing_expected') THEN array_to_string(domains, ',') ELSE '' END AS route_domains, reason = 'should_abstain' AS abstain, CASE WHEN r THEN NULL WHEN reason = 'conflicting_evidence' THEN 'abstain' ELSE 'warn' END AS decision FROM p
"""


def _shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as cases, their suppliers by balance as results, regions as policies."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    sup = lambda k: _name("s", F.col("n_nationkey") + k)
    cases = n.select(_name("n", key).alias("case_id"), F.concat(F.lit("trade with "), F.lower("n_name")).alias("task"), F.array(_name("r", region)).alias("domains"), _none().alias("scenarios"), _none().alias("project_keys"), F.when(key % 6 == 5, _none()).otherwise(F.array(sup(25))).alias("expected"), F.array(sup(50)).alias("forbidden"), (key % 6 == 5).alias("abstain"))
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))
    results = s.select(_name("n", F.col("s_nationkey")).alias("case_id"), _name("s", F.col("s_suppkey")).alias("id"), rank.alias("rank")).withColumn("injected", F.col("rank") <= 3)
    ids = lambda rest: s.agg(F.array_sort(F.collect_list(F.when(F.col("s_suppkey") % 10 == rest, _name("s", F.col("s_suppkey"))))).alias("ids"))
    k = F.col("r_regionkey")
    rows = table(spark, sf_dir, "region").crossJoin(ids(3).withColumnRenamed("ids", "prefer")).crossJoin(ids(4).withColumnRenamed("ids", "suppress"))  # one row each
    policies = rows.select(_name("p", k).alias("policy_id"), F.when(k == 4, "deprecated").otherwise("shadow").alias("status"), F.array(_name("r", k)).alias("domains"), _none().alias("scenarios"), _none().alias("project_keys"), F.array(F.lit("ARGENTINA")).alias("excluded_terms"), F.array(F.lit("Trade")).alias("all_terms"), F.when(k == 1, F.array(F.lit("a"))).otherwise(_none()).alias("any_terms"), "prefer", "suppress", (k % 2 == 0).alias("abstain_without_preferred"))
    return policy.shadow(cases, results, policies)


def policy_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case under the shadow policies that apply to it."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    return _shadowed(spark, sf_dir).select("case_id", *map(joined, ("policies", "matched", "injected")), "false_injection", "abstention_failure", "passed")


def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the simulation over all cases."""
    return policy.shadow_metrics(_shadowed(spark, sf_dir)).select("total", "passed", "failed", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "false_injection_rate", "abstention_failure_rate")])


_SHADOW = """
c AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS case_id, n_regionkey AS r, lower(n_name) AS name, CASE WHEN n_nationkey % 6 = 5 THEN []::VARCHAR[] ELSE ['s' || (n_nationkey + 25)] END AS expected, 's' || (n_nationkey + 50) AS bad, n_nationkey % 6 = 5 AS abstain FROM nation),
app AS (SELECT case_id, r, r % 2 = 0 AS stop FROM c WHERE r <> 4 AND name <> 'argentina' AND (r <> 1 OR contains('trade with ' || name, 'a'))),
res AS (SELECT 'n' || s_nationkey AS case_id, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier),
kept AS (SELECT res.*, app.case_id IS NOT NULL AND s % 10 = 3 AS liked, stop, max(app.case_id IS NOT NULL AND s % 10 = 3) OVER (PARTITION BY res.case_id) AS any_liked FROM res LEFT JOIN app USING (case_id) WHERE NOT (app.case_id IS NOT NULL AND s % 10 = 4)),
lists AS (SELECT case_id, list('s' || s ORDER BY liked DESC, rank) AS matched, coalesce(list('s' || s ORDER BY liked DESC, rank) FILTER (rank <= 3), []) AS injected FROM kept WHERE NOT coalesce(stop, FALSE) OR any_liked GROUP BY case_id),
o AS (SELECT c.*, CASE WHEN app.case_id IS NOT NULL THEN 'p' || app.r ELSE '' END AS policies, coalesce(matched, []) AS matched, coalesce(injected, []) AS injected FROM c LEFT JOIN lists USING (case_id) LEFT JOIN app USING (case_id)),
v AS (SELECT *, list_contains(injected, bad) AS false_injection, abstain AND len(injected) > 0 AS abstention_failure, len(list_filter(expected, lambda x: NOT list_contains(injected, x))) = 0 AND NOT list_contains(injected, bad) AND (NOT abstain OR len(injected) = 0) AS passed FROM o)
"""
POLICY_SHADOW = f"WITH {_SHADOW} SELECT case_id, policies, array_to_string(matched, ',') AS matched, array_to_string(injected, ',') AS injected, false_injection, abstention_failure, passed FROM v"
_HIT = "round(coalesce(avg(CASE WHEN list_contains(list_slice(matched, 1, {0}), expected[1]) THEN 1.0 ELSE 0.0 END) FILTER (len(expected) > 0), 1.0), 6)::DOUBLE"
POLICY_METRICS = f"""
WITH {_SHADOW}
SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, {_HIT.format(1)} AS recall_1, {_HIT.format(3)} AS recall_3, round(avg(CASE WHEN false_injection THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS false_injection_rate,
  round(count(*) FILTER (abstention_failure) / count(*) FILTER (abstain), 6)::DOUBLE AS abstention_failure_rate FROM v
"""


def policy_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on orders as cases, under two rules each."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    layers = F.when(k % 3 == 0, F.array(F.lit("synopsis"), F.lit("knowledge"))).otherwise(F.array(F.lit("synopsis")))
    cases = o.select(_name("o", k).alias("case_id"), F.struct((k % 5 == 0).alias("has_unresolved_conflict"), (k % 7 == 0).alias("has_expired_fact"), (k % 2 == 0).alias("has_documented_evidence"), layers.alias("expanded_layers"), F.when(k % 4 == 1, "high").otherwise("low").alias("operation_risk")).alias("context"))
    rule = lambda checks, need, then: F.struct(F.array(*map(F.lit, checks)).alias("checks"), need.alias("required_layers"), F.lit(then).alias("on_violation"))
    rules = o.select(_name("o", k).alias("case_id"), F.explode(F.array(rule(("unresolved_conflict", "expired_fact"), _none(), "warn"), rule(("high_risk_without_evidence", "missing_documented_evidence"), F.when(k % 6 == 1, F.array(F.lit("evidence"))).otherwise(_none()), "abstain"))).alias("r")).select("case_id", "r.*")
    return policy.reasoning(cases, rules).select("case_id", "decision", F.array_join("violations", ",").alias("violations"))


POLICY_REASONING = """
WITH v AS (SELECT o_orderkey AS k, list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'unresolved_conflict' END, CASE WHEN o_orderkey % 7 = 0 THEN 'expired_fact' END], lambda x: x IS NOT NULL) AS a,
  list_filter([CASE WHEN o_orderkey % 2 <> 0 THEN 'missing_documented_evidence' END, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 2 <> 0 THEN 'high_risk_without_evidence' END, CASE WHEN o_orderkey % 6 = 1 THEN 'required_layer:evidence' END], lambda x: x IS NOT NULL) AS b FROM orders)
SELECT 'o' || k AS case_id, CASE WHEN len(b) > 0 THEN 'abstain' WHEN len(a) > 0 THEN 'warn' ELSE 'proceed' END AS decision, array_to_string(list_sort(list_concat(a, b)), ',') AS violations FROM v
"""

# --------------------------------------------------------------------------- candidates, catalogues, vault


def candidate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates: active at once, or proposed."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("knowledge").alias("layer"), F.coalesce("text", F.lit("")).alias("body"), _pick(i, "profile", "semantic", "procedural").alias("kind"), _pick(i, "direct_material", "direct_material", "automated_session", "direct_material").alias("capture_mode"), _pick(i, "owner", "customer", "owner", "owner", "owner").alias("actor_type"), _pick(i, "user_confirmed", "documented", "verified_task", "model_inferred", "documented", "verified_task", "documented").alias("source_authority"), (i % 11 / 10).alias("confidence"))
    return rows.select("doc_id", governance.candidate_status().alias("status"))


CANDIDATE_STATUS = """
WITH c AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS body, ['profile', 'semantic', 'procedural'][doc_id % 3 + 1] AS kind, ['direct_material', 'direct_material', 'automated_session', 'direct_material'][doc_id % 4 + 1] AS mode, doc_id % 5 = 1 AS customer,
  ['user_confirmed', 'documented', 'verified_task', 'model_inferred', 'documented', 'verified_task', 'documented'][doc_id % 7 + 1] AS authority, doc_id % 11 / 10 AS confidence FROM documents)
SELECT doc_id, CASE WHEN (kind <> 'profile' AND length(body) < 300) OR mode = 'automated_session' OR customer THEN 'proposed' WHEN authority = 'user_confirmed' THEN 'active' WHEN authority = 'documented' AND confidence >= 0.8 THEN 'active'
  WHEN authority = 'verified_task' AND kind = 'procedural' AND confidence >= 0.75 THEN 'active' ELSE 'proposed' END AS status FROM c
"""


def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every document after active ones deprecated what they supersede."""
    return governance.supersede(heart.knowledge(spark, sf_dir)).select("id", "status")


SUPERSEDED = """
WITH s AS (SELECT DISTINCT 'k_' || (doc_id + 3) AS id FROM documents WHERE doc_id % 29 = 0 AND doc_id % 13 <> 0)
SELECT 'k_' || doc_id AS id, CASE WHEN doc_id % 13 = 0 OR 'k_' || doc_id IN (SELECT id FROM s) THEN 'deprecated' ELSE 'active' END AS status FROM documents
"""


def capture_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What captured material does to known material: duplicate, replace or new."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    known = d.where(i % 2 == 0).select(_name("m", i).alias("source"), text.content_hash(F.col("text")).alias("hash"))
    material = d.select(_name("m", i - i % 3).alias("source"), F.when(i % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return governance.capture(known, material).groupBy("source", "action").agg(F.count(F.lit(1)).alias("n"))


CAPTURE_ACTIONS = """
WITH k AS (SELECT 'm' || doc_id AS source, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 2 = 0),
m AS (SELECT 'm' || (doc_id - doc_id % 3) AS source, sha256(coalesce(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END, '')) AS h FROM documents)
SELECT source, CASE WHEN h IN (SELECT h FROM k) THEN 'duplicate' WHEN source IN (SELECT source FROM k) THEN 'replace' ELSE 'new' END AS action, count(*) AS n FROM m GROUP BY ALL
"""


def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of documents as knowledge: counts by status, kind, domain, scenario and alias."""
    return governance.catalogue(heart.knowledge(spark, sf_dir))


CATALOGUE_COUNTS = """
WITH d AS (SELECT * FROM documents WHERE doc_id IS NOT NULL)
SELECT 'status' AS dimension, CASE WHEN doc_id % 13 = 0 THEN 'deprecated' ELSE 'active' END AS value, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'kind', CASE WHEN doc_id % 19 = 0 THEN 'source' ELSE ['semantic', 'procedural', 'principle', 'episodic', 'profile', 'skill'][doc_id % 6 + 1] END, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'domain', lang || '/' || source, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'scenarios', s, count(*) FROM (SELECT unnest(CASE WHEN doc_id % 3 = 0 THEN ['topic_' || (doc_id % 7), 'case-' || (doc_id % 4)] ELSE ['topic_' || (doc_id % 7)] END) AS s FROM d) GROUP BY s
UNION ALL SELECT 'aliases', source, count(*) FROM d WHERE doc_id % 4 = 0 GROUP BY 2
"""


def vault_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts sealed, each different one once, opened again: ids, sizes and hashes of what came out."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    empty = spark.createDataFrame([], "vault_id string, key_id string, bytes long, sealed binary")
    key = "0123456789abcdef0123456789abcdef"  # of this query only
    vault = settle(governance.vault_put(empty, empty.select("vault_id"), d, key, "k1"), "vault")
    return governance.vault_get(vault, vault.select("vault_id"), key, "k1").join(vault.select("vault_id", "bytes"), "vault_id").select("vault_id", "bytes", F.sha2("content", 256).alias("sha256"))


VAULT_ROUND_TRIP = "SELECT DISTINCT 'vault_sha256_' || sha256(t) AS vault_id, CAST(octet_length(encode(t)) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM (SELECT coalesce(text, '') AS t FROM documents)"


def maintenance_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations matched with the catalogue by domain and name, and what each proposes."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    catalog = d.where(i % 2 == 0).select(_name("k", i).alias("id"), F.when(i % 10 == 0, "deprecated").otherwise("active").alias("status"), F.col("lang").alias("domain"), _name("Title  ", i % 40).alias("title"), F.array(F.concat(F.lit("also "), (i % 30).cast("string"))).alias("aliases"), F.substring("text", 1, 30).alias("summary"))
    observed = d.where(i % 3 == 0).select(_name("o", i).alias("id"), F.upper("lang").alias("domain"), F.when(i % 2 == 0, _name("title ", i % 40)).otherwise(_name("ALSO ", i % 30)).alias("title"), F.substring("text", 1, 12).alias("summary"), F.when(i % 9 == 0, F.lit("k1")).alias("supersedes"), F.when(i % 4 == 3, F.lit("k2")).alias("conflicts_with"))
    return governance.propose_maintenance(governance.match_observations(observed, catalog)).select("proposal_id", "type", F.element_at("observation_ids", 1).alias("observation"), F.array_join("target_ids", ",").alias("targets"))


MAINTENANCE_PROPOSALS = r"""
WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
k AS (SELECT 'k' || doc_id AS id, lang, 'title ' || (doc_id % 40) AS a, 'also ' || (doc_id % 30) AS b, substring(text, 1, 30) AS summary FROM d WHERE doc_id % 2 = 0 AND doc_id % 10 <> 0),
names AS (SELECT id, lang, a AS t, summary FROM k UNION SELECT id, lang, b, summary FROM k),
f AS (SELECT lang, t, min(id) AS id, min_by(summary, id) AS summary FROM names GROUP BY ALL),
o AS (SELECT 'o' || doc_id AS id, upper(lang) AS domain, lang, CASE WHEN doc_id % 2 = 0 THEN 'title ' || (doc_id % 40) ELSE 'also ' || (doc_id % 30) END AS t, substring(text, 1, 12) AS summary, doc_id % 9 = 0 AS s, doc_id % 4 = 3 AS c FROM d WHERE doc_id % 3 = 0),
m AS (SELECT o.*, f.id AS target, lower(trim(regexp_replace(o.summary, '\s+', ' ', 'g'))) AS x, lower(trim(regexp_replace(f.summary, '\s+', ' ', 'g'))) AS y FROM o LEFT JOIN f ON f.lang = lower(o.lang) AND f.t = o.t),
p AS (SELECT *, CASE WHEN s THEN 'update' WHEN c THEN 'conflict' WHEN target IS NOT NULL AND (contains(x, y) OR contains(y, x)) THEN 'duplicate' ELSE 'consolidation' END AS type, CASE WHEN s THEN 'k1' WHEN c THEN 'k2' ELSE coalesce(target, '') END AS targets FROM m)
SELECT sha256(type || chr(0) || domain || chr(0) || id || chr(0) || targets)[1:20] AS proposal_id, type, id AS observation, targets FROM p
"""


def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the knowledge graph of all documents."""
    nodes, edges = graph.build(heart.knowledge(spark, sf_dir))
    return nodes.select(F.lit("node").alias("what"), "id", "type", F.col("label").alias("value")).unionByName(edges.select(F.lit("edge").alias("what"), "id", "type", F.concat_ws(" ", "source", "target").alias("value")))


GRAPH_BUILD = """
WITH d AS (SELECT *, 'knowledge:k_' || doc_id AS k FROM documents WHERE doc_id IS NOT NULL),
e AS (
  SELECT k AS source, 'domain:' || lang || '/' || source AS target, 'belongs_to_domain' AS type, 'domain' AS kind, lang || '/' || source AS label FROM d
  UNION ALL SELECT k, 'scenario:' || s, 'used_in_scenario', 'scenario', s FROM (SELECT k, unnest(CASE WHEN doc_id % 3 = 0 THEN ['topic_' || (doc_id % 7), 'case-' || (doc_id % 4)] ELSE ['topic_' || (doc_id % 7)] END) AS s FROM d)
  UNION ALL SELECT k, 'project:p' || (doc_id % 8), 'belongs_to_project', 'project', 'p' || (doc_id % 8) FROM d WHERE doc_id % 4 = 3
  UNION ALL SELECT k, 'source:' || source, 'sourced_from', 'source', source FROM d
  UNION ALL SELECT k, 'knowledge:k_' || (doc_id + 2), CASE WHEN doc_id % 2 = 0 THEN 'depends_on' ELSE 'conflicts_with' END, NULL, NULL FROM d WHERE doc_id % 3 = 1
  UNION ALL SELECT k, 'knowledge:k_' || (doc_id + 3), 'supersedes', NULL, NULL FROM d WHERE doc_id % 29 = 0
  UNION ALL SELECT k, 'knowledge:k_' || (doc_id + 2), 'conflicts_with', NULL, NULL FROM d WHERE doc_id % 10 = 3)
SELECT 'node' AS what, k AS id, 'knowledge' AS type, substring(coalesce(text, ''), 1, 40) AS value FROM d
UNION ALL SELECT DISTINCT 'node', target, kind, label FROM e WHERE kind IS NOT NULL
UNION ALL SELECT DISTINCT 'edge', 'edge_' || sha256(source || chr(0) || target || chr(0) || type)[1:20], type, source || ' ' || target FROM e
"""


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document's weighted labels against every request that names one of them."""
    docs, asked = retrieval.prepare(heart.knowledge(spark, sf_dir)), heart.asked(spark, sf_dir)
    return retrieval.metadata_scores(None, docs, asked).select("query_id", "id", F.round("metadata", 6).alias("metadata"))


LABEL_SCORES = f"WITH {heart._BASE}, {heart._SIDES}, pairs AS (SELECT query_id, id FROM reqs CROSS JOIN docs), {heart._features('pairs', 'reqs', 'w')} SELECT query_id, id, round(metadata, 6) AS metadata FROM w_meta WHERE metadata > 0"


# --------------------------------------------------------------------------- index, embeddings, prompts


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the kept index of texts: documents and occurrences of each."""
    from quillmere.plans.search import _index

    rows = _index(spark, sf_dir).table.where("term is not null")
    return rows.groupBy("term").agg(F.sum("df").alias("documents"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("occurrences"))


INDEX_TERMS = r"SELECT t AS term, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+')) AS t FROM documents) WHERE t <> '' GROUP BY t"


def embedding_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vectors a refresh keeps and computes, after some texts and paths changed, and how many there are."""
    i = F.col("conv_id") * 100 + F.col("turn")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat(F.lit("p/"), "conv_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"), i.alias("i"))
    embed = lambda df: embeddings.hash_embed(df, "id", "text")
    then = turns.where("i % 5 <> 0").select("id", F.when(F.col("i") % 7 == 0, F.lit("old")).otherwise(F.col("path")).alias("path"), F.when(F.col("i") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    old = settle(embed(then).join(then.select("id", "path", text.content_hash(F.col("text")).alias("content_hash")), "id").select("id", "path", "content_hash", "vector"), "vectors")
    made, counts = embeddings.refresh(old, turns.where("i % 11 <> 0").select("id", "path", "text"), embed)
    return made.crossJoin(counts).select("id", "content_hash", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), "reused", "computed", "removed")


EMBEDDING_REFRESH = r"""
WITH t AS (SELECT conv_id || ':' || turn AS id, coalesce(text, '') AS text, conv_id * 100 + turn AS i FROM conversations),
n AS (SELECT *, i % 5 <> 0 AS was, i % 5 <> 0 AND i % 7 <> 0 AND i % 3 <> 0 AS same FROM t WHERE i % 11 <> 0),
f AS (SELECT id, sha256(x) AS h FROM (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_/-]+'), lambda x: length(x) BETWEEN 2 AND 48))) AS x FROM t)),
b AS (SELECT id, max(abs(v)) > 0 AS filled FROM (SELECT id, CAST(('0x' || h[1:4]) AS INTEGER) % 64 AS b, sum(CASE WHEN CAST(('0x' || h[5:6]) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM f GROUP BY ALL) GROUP BY id)
SELECT n.id, 'sha256:' || sha256(text) AS content_hash, CASE WHEN filled THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, (SELECT count(*) FROM n WHERE same) AS reused, (SELECT count(*) FROM n WHERE NOT same) AS computed, (SELECT count(*) FROM t WHERE i % 5 <> 0 AND i % 11 = 0) AS removed FROM n LEFT JOIN b USING (id)
"""


def catalogue_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items that prompts get, best five each; prompts are the users' first turns."""
    d = table(spark, sf_dir, "documents")
    items = d.select(_name("k_", F.col("doc_id")).alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"), F.substring(F.coalesce("text", F.lit("")), 61, 60).alias("summary"), F.col("lang").alias("domain"), (F.col("doc_id") % 10 / 10).alias("confidence"))
    prompts = table(spark, sf_dir, "conversations").where("role = 'user' and turn = 0").select(_name("c", F.col("conv_id")).alias("query_id"), F.when(F.col("conv_id") % 9 == 0, "show knowledge").otherwise(F.coalesce("text", F.lit(""))).alias("task"))
    return embeddings.filter_catalogue(items, prompts).select("query_id", "id", F.col("hits").cast("long").alias("hits"), "rank")


CATALOGUE_PROMPTS = r"""
WITH items AS (SELECT 'k_' || doc_id AS id, substring(coalesce(text, ''), 1, 60) AS title, substring(coalesce(text, ''), 61, 60) AS summary, lang, doc_id % 10 / 10 AS confidence FROM documents),
t AS (SELECT id, confidence, unnest(list_distinct(list_filter(regexp_split_to_array(lower(id || ' ' || title || ' ' || summary || ' ' || lang), '[^\p{L}\p{N}_/-]+'), lambda x: length(x) >= 2))) AS term FROM items),
p AS (SELECT 'c' || conv_id AS query_id, list_filter(list_distinct(list_filter(regexp_split_to_array(lower(CASE WHEN conv_id % 9 = 0 THEN 'show knowledge' ELSE coalesce(text, '') END), '[^\p{L}\p{N}_/-]+'), lambda x: length(x) >= 2)), lambda x: x NOT IN ('show', 'list', 'browse', 'view', 'knowledge', 'memory', 'memories', 'rules', 'catalog', 'sop')) AS terms FROM conversations WHERE role = 'user' AND turn = 0),
h AS (SELECT query_id, id, count(*) AS hits, any_value(confidence) AS confidence FROM (SELECT query_id, unnest(terms) AS term FROM p) JOIN t USING (term) GROUP BY query_id, id
  UNION ALL SELECT query_id, id, 0, confidence FROM p CROSS JOIN (SELECT id, confidence FROM items ORDER BY confidence DESC, id LIMIT 5) WHERE len(terms) = 0)
SELECT query_id, id, hits, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, confidence DESC, id) AS INTEGER) AS rank FROM h QUALIFY rank <= 5
"""


def hook_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn of a conversation would be given: catalogue, none, below or context."""
    i = F.col("conv_id") + F.col("turn")
    prompt = F.when(i % 6 == 0, "please list all the rules").when(i % 6 == 1, "有哪些知识可以看").otherwise(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", embeddings.injection(prompt, F.when(i % 4 != 0, i % 11 / 10)).alias("decision"))


HOOK_DECISIONS = "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 < 2 THEN 'catalogue' WHEN (conv_id + turn) % 4 = 0 THEN 'none' WHEN (conv_id + turn) % 11 / 10 < 0.55 THEN 'below' ELSE 'context' END AS decision FROM conversations"


# --------------------------------------------------------------------------- sources


def _signed(i: Column, changed: Column) -> Column:
    return F.when(changed, _name("h", i + 1)).otherwise(_name("h", i))


def fetched_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change class of every source after a fetch, and whether its review starts anew."""
    i = F.col("doc_id")
    side = lambda available, h, f, p: F.struct(available.alias("availability"), h.alias("content_hash"), f.alias("fingerprint"), p.alias("processing_profile"))
    state = lambda gone: F.when(gone, "missing").otherwise("available")
    old = F.when(i % 7 != 0, side(state(i % 5 == 0), _name("H", i), _name("f", i), F.lit("p1")))
    new = F.when(i % 11 != 0, side(state(i % 13 == 0), F.lower(_signed(i, i % 3 == 0)), F.when(i % 4 == 0, "g").otherwise(_name("f", i)), F.when(i % 9 == 1, "p2").otherwise("p1")))
    rows = table(spark, sf_dir, "documents").select("doc_id", old.alias("old"), new.alias("new")).where("old is not null or new is not null")
    return ingestion.classify_fetched(rows).select("doc_id", "change", F.coalesce("review_reset", F.lit(False)).alias("review_reset"))


FETCHED_CHANGES = """
WITH r AS (SELECT doc_id AS i, doc_id % 7 <> 0 AS o, doc_id % 11 <> 0 AS n, doc_id % 5 = 0 AS om, doc_id % 13 = 0 AS nm FROM documents),
c AS (SELECT i, CASE WHEN NOT o THEN 'new' WHEN NOT om AND (NOT n OR nm) THEN 'removed' WHEN om AND n AND NOT nm THEN 'restored' WHEN n AND i % 3 = 0 THEN 'content_changed' WHEN n AND i % 4 = 0 THEN 'metadata_only' WHEN NOT n OR i % 9 = 1 THEN 'metadata_only' ELSE 'unchanged' END AS change FROM r WHERE o OR n)
SELECT i AS doc_id, change, change IN ('content_changed', 'restored') AS review_reset FROM c
"""


def _health(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    registrations = s.select(_name("c", k).alias("connector_id"), (k % 3).alias("generation"), F.lit("f").alias("scope_fingerprint"), F.when(k % 2 == 0, "2025-02-01").alias("ingested_at"))
    reports = s.where(k % 5 != 0).select(_name("c", k).alias("connector_id"), F.when(k % 7 == 0, F.lit(9)).otherwise(k % 3).alias("generation"), F.lit("f").alias("scope_fingerprint"), F.when(k % 4 == 0, "2025-01-01").otherwise("2025-03-01").alias("checked_at"), (k % 6).alias("updates_available"), (k % 2).alias("verification_required"))
    return ingestion.update_health(registrations, reports)


def update_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors by whether their last check still holds, with the totals."""
    each, totals = _health(spark, sf_dir)
    return each.crossJoin(totals.select("registered", F.col("unchecked").alias("not_current"), "stale", F.col("updates_available").alias("all_updates")))  # totals is one row


UPDATE_HEALTH = """
WITH e AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'unchecked' WHEN s_suppkey % 7 = 0 THEN 'stale' WHEN s_suppkey % 4 = 0 THEN 'stale' ELSE 'current' END AS state FROM supplier),
c AS (SELECT 'c' || k AS connector_id, state, CASE WHEN state = 'current' THEN k % 6 ELSE 0 END AS updates_available, CASE WHEN state = 'current' THEN k % 2 ELSE 0 END AS verification_required FROM e)
SELECT *, (SELECT count(*) FROM c) AS registered, (SELECT count(*) FROM c WHERE state <> 'current') AS not_current, (SELECT count(*) FROM c WHERE state = 'stale') AS stale, (SELECT CAST(sum(updates_available) AS BIGINT) FROM c) AS all_updates FROM c
"""


def review_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after reviews that name the hash that is there now; others are refused."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    m = d.select(_name("s", i).alias("source_id"), _name("h", i).alias("content_hash"), F.when(i % 3 == 0, "pending").otherwise("refined").alias("processing_status"), F.when(i % 3 != 0, _signed(i, i % 4 == 0)).alias("processed_content_hash"), F.when(i % 9 == 0, "missing").otherwise("available").alias("availability"), F.lit(None).cast("string").alias("duplicate_of"), _none().alias("refined_knowledge_ids"))
    receipts = d.where(i % 5 == 0).select(_name("s", i).alias("source_id"), _signed(i, i % 2 == 0).alias("expected_hash"), F.lit("refined").alias("status"), F.lit(None).cast("string").alias("duplicate_of"), F.array(_name("k_", i)).alias("refined_knowledge_ids"))
    out, refused = ingestion.mark_reviewed(m, receipts)
    late = refused.select("source_id", F.lit(True).alias("refused"))
    return out.withColumn("review", ingestion.review_state()).join(late, "source_id", "left").select("source_id", "processing_status", "review", F.coalesce("refused", F.lit(False)).alias("refused"))


REVIEW_MARKS = """
WITH m AS (SELECT doc_id AS i, doc_id % 5 = 0 AND doc_id % 2 <> 0 AS done, doc_id % 5 = 0 AND doc_id % 2 = 0 AS refused FROM documents)
SELECT 's' || i AS source_id, CASE WHEN done OR i % 3 <> 0 THEN 'refined' ELSE 'pending' END AS processing_status, CASE WHEN done THEN 'current' WHEN i % 3 = 0 THEN CASE WHEN i % 9 = 0 THEN 'missing' ELSE 'pending' END WHEN i % 4 = 0 THEN 'stale' ELSE 'current' END AS review, refused FROM m
"""


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, names, keys and escapes of part names and page addresses."""
    p = table(spark, sf_dir, "part")
    name = F.col("p_name")
    remote = F.concat(F.lit("https://user:pw@Host.org:8443/Team//"), F.regexp_replace("p_brand", "#", "-"), F.lit(".git/"))
    key = projects.project_key(remote)
    return p.select(
        "p_partkey", text.slug(F.concat(name, F.lit(" -- É!"))).alias("slug"), text.snake(F.concat(F.lit("SubagentStop "), name)).alias("snake"), text.mermaid_label(F.concat(F.lit('["a"]'), name)).alias("mermaid"), key.alias("project"), projects.display_name(key).alias("display"),
        F.array_join(projects.project_aliases(key), ",").alias("aliases"), F.array_join(text.adjacent_pairs(text.terms(name)), ",").alias("pairs"), text.strip_markup(F.concat(F.lit("<p class='x'>a &amp;lt; b&#169;c &apos;"), name, F.lit("&apos;</p>"))).alias("plain"),
        F.array_join(text.cjk_ngrams(F.concat(F.lit("退款流程"), name, F.lit("灰度"))), ",").alias("grams"),
    )


TEXT_HELPERS = r"""
WITH p AS (SELECT p_partkey, p_name, lower('host.org/Team/' || replace(p_brand, '#', '-')) AS k, lower('Team/' || replace(p_brand, '#', '-')) AS tail FROM part),
t AS (SELECT *, list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}_/-]+'), lambda x: length(x) >= 2) AS l FROM p)
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' -- É!'), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g')[1:80], '-+$', '') AS slug, 'subagent_stop_' || lower(regexp_replace(p_name, '[\s-]+', '_', 'g')) AS snake, ' ''a'' ' || p_name AS mermaid, k AS project,
  split_part(k, '/', 3) AS display, tail || ',' || split_part(k, '/', 3) AS aliases, array_to_string(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]), ',') AS pairs, 'a < b c ''' || p_name || '''' AS plain, '退款,款流,流程,退款流,款流程,灰度' AS grams FROM t
"""

_ALL = (
    ledger_append, ledger_verify, ledger_latest, mining_groups, policy_shadow, policy_metrics, policy_reasoning, candidate_status, superseded, capture_actions, catalogue_counts, vault_round_trip, maintenance_proposals, graph_build, label_scores,
    index_terms, embedding_refresh, catalogue_prompts, hook_decisions, fetched_changes, update_health, review_marks, text_helpers,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
