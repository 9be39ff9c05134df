"""A whole suite, from YAML to metrics, and the small helpers."""

from pyspark.sql import functions as F

from quillmere import config
from quillmere.functions import projects, text
from quillmere.operators import evaluation, packet, policy, retrieval
from quillmere.sources import suites

SUITE = """
documents:
  - {id: k_cache, title: Cache stampede guard, domain: backend/cache, scenarios: [incident], aliases: [thundering herd], tags: [redis], body: Guard hot keys with a lock and jittered expiry so that a cache stampede cannot reach the database.}
  - {id: k_queue, title: Queue retry budget, domain: backend/queue, scenarios: [incident], aliases: [poison message], tags: [kafka], body: Give every consumer a retry budget and park poison messages in a dead letter topic.}
  - {id: k_index, title: Online index build, domain: data/postgres, scenarios: [schema-migration], aliases: [concurrent index], tags: [postgres], body: Build a concurrent index online and drop the invalid one when the build fails.}
  - {id: k_old, title: Old cache rule, domain: backend/cache, scenarios: [incident], body: Cache stampede guard with a global lock., valid_until: 2024-05-01}
  - {id: k_p1, title: Refund ledger of project one, domain: business/refund, scenarios: [support], project_keys: [p1], body: The refund ledger keeps one row for each partial refund.}
  - {id: k_p2, title: Refund ledger of project two, domain: business/refund, scenarios: [support], project_keys: [p2], body: The refund ledger groups partial refunds by order.}
  - {id: k_han, title: 灰度发布回滚, domain: ops/release, scenarios: [release], aliases: [灰度回滚], body: 灰度发布失败时先切流量，再回滚版本。}
  - {id: k_f1, title: Filler one, domain: misc/a, scenarios: [other], body: Nothing of note about weather and lunch.}
  - {id: k_f2, title: Filler two, domain: misc/b, scenarios: [other], body: Nothing of note about chairs and paper.}
  - {id: k_f3, title: Filler three, domain: misc/c, scenarios: [other], body: Nothing of note about carpets and tea.}
cases:
  - {task: guard against a cache stampede on hot keys, domains: [backend/cache], expected_memories: [k_cache], expected_ranks: {k_cache: 1}, forbidden_memories: [k_old]}
  - {task: poison message retry budget for consumers, expected_memories: [k_queue], expected_ranks: {k_queue: 1}}
  - {task: build a concurrent index online, scenarios: [schema-migration], expected_memories: [k_index], forbidden_memories: [k_cache]}
  - {task: partial refund ledger, domains: [business/refund], project_keys: [p1], expected_memories: [k_p1], forbidden_memories: [k_p2]}
  - {task: 灰度发布失败怎么回滚, domains: [ops/release], expected_memories: [k_han]}
  - {task: purple elephants dancing quietly, abstain: true}
"""


def test_suite_passes(spark):
    knowledge, asked, cases = suites.load(spark, SUITE)
    ranked = retrieval.retrieve(asked, knowledge)
    ranked = spark.createDataFrame(ranked.collect(), ranked.schema)
    packets = packet.build(ranked)
    packets = spark.createDataFrame(packets.collect(), packets.schema)
    results = evaluation.run_cases(cases, ranked, packets)
    failed = [r.asDict() for r in results.where("not passed").collect()]
    assert not failed
    s = evaluation.suite(results).first()
    assert (s.total, s.recall_1, s.mrr, s.false_injection_rate, s.abstention_precision) == (6, 1.0, 1.0, 0.0, 1.0)
    runs = policy.merge_runs(policy.run_events(asked, ranked, packets, "2025-01-01")).collect()
    assert len(runs) == 6 and sum(bool(r.injected_ids) for r in runs) == 5 and all(len(r.task_hash) == 64 for r in runs)


def test_helpers(spark):
    c = lambda f, *a: spark.range(1).select(f(*[F.lit(x) for x in a]).alias("x")).first().x
    for remote in ("git@Host.org:Team/Repo.git", "https://user:pw@host.org:8443/team//repo.git/", "ssh://git@host.org/team/repo"):
        assert c(projects.project_key, remote) == "host.org/team/repo"
    assert c(projects.project_aliases, "host.org/team/repo") == ["team/repo", "repo"] and c(projects.display_name, "x") == "x"
    assert c(projects.redact_remote, "https://u:p@h/x") == "https://h/x" and c(projects.redact_remote, "git@h:x") == "git@h:x"
    assert c(text.clean_export, '<p id="1">a <cite type="user" x>Bob</cite><img src="s" src-token="t"/></p>') == '<p>a [REDACTED_PERSON]<img doc-ref="t"/></p>'
    assert config.settings(user={"hook": {"max_tokens": 5}}, local={"hook": {"least_score": 0.1}})["hook"] == {"least_score": 0.1, "max_tokens": 5}
