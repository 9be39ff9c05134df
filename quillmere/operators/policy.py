"""Feedback, query runs, policy mining and simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.text import short_hash
from quillmere.operators.evaluation import recall_at

#: Feedback reasons that make retrieval policies and reasoning policies.
RETRIEVAL_REASONS = ("wrong_route", "missing_expected", "forbidden_injection", "should_abstain", "stale_source")
REASONING_REASONS = ("insufficient_detail", "conflicting_evidence", "reasoning_failure")
READY_RUNS = 30


def feedback_key() -> Column:
    """memory and run, or the event, or the place in the log."""
    return F.when(F.col("query_run_id").isNotNull(), F.concat_ws("\0", F.coalesce("memory_id", F.lit("query")), "query_run_id")).when(F.col("event_id").isNotNull(), F.col("event_id")).otherwise(F.concat_ws(":", "file", F.col("line").cast("string")))


def latest_feedback(events: DataFrame) -> DataFrame:
    """One row for each key: the newest, and of equal times the later line (events carry file and line)."""
    order = Window.partitionBy("_key").orderBy(F.col("timestamp").desc(), F.col("file").desc(), F.col("line").desc())
    return events.withColumn("_key", feedback_key()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_key")


def net_usefulness(feedback: DataFrame) -> DataFrame:
    """(memory_id, net): useful counts 1, not_useful -1, else 0."""
    value = F.when(F.col("usefulness") == "useful", 1).when(F.col("usefulness") == "not_useful", -1).otherwise(0)
    return feedback.where("memory_id is not null").groupBy("memory_id").agg(F.sum(value).alias("net"))


def merge_runs(events: DataFrame) -> DataFrame:
    """Query runs from their two phases: retrieval rows, with the packet's injected ids where there is one."""
    first = lambda phase, c: F.min_by(F.when(F.col("phase") == phase, F.col(c)), F.when(F.col("phase") == phase, F.col("timestamp")))
    rows = events.groupBy("query_run_id").agg(first("retrieval", "task_hash").alias("task_hash"), first("retrieval", "domains").alias("domains"), first("retrieval", "scenarios").alias("scenarios"), first("retrieval", "project_keys").alias("project_keys"), first("retrieval", "matched_ids").alias("matched_ids"), first("packet", "injected_ids").alias("injected_ids"), F.min(F.when(F.col("phase") == "retrieval", F.col("timestamp"))).alias("timestamp"))
    return rows.where("timestamp is not null").orderBy("timestamp", "query_run_id")


def run_events(asked: DataFrame, ranked: DataFrame, packets: DataFrame, at: str) -> DataFrame:
    """Two rows for each request: what retrieval found and what the packet took. Of the task only hash and length are kept."""
    ids = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("matched_ids"))
    none = F.array().cast("array<string>")
    first = asked.join(ids, "query_id", "left").select(F.col("query_id").alias("query_run_id"), F.lit("retrieval").alias("phase"), F.lit(at).alias("timestamp"), F.sha2(F.col("task").cast("binary"), 256).alias("task_hash"), F.length("task").alias("task_length"), "domains", "scenarios", "project_keys", F.coalesce("matched_ids", none).alias("matched_ids"), F.lit(None).cast("array<string>").alias("injected_ids"))
    second = packets.select(F.col("query_id").alias("query_run_id"), F.lit("packet").alias("phase"), F.lit(at).alias("timestamp"), F.col("injected").alias("injected_ids"))
    return first.unionByName(second, allowMissingColumns=True)


def is_bounded(domains: Column, scenarios: Column, projects: Column) -> Column:
    return (F.coalesce(F.size(domains), F.lit(0)) > 0) | (F.coalesce(F.size(scenarios), F.lit(0)) > 0) | (F.coalesce(F.size(projects), F.lit(0)) > 0)


def mine(feedback: DataFrame, runs: DataFrame, threshold: int = 3) -> DataFrame:
    """Shadow policy proposals from feedback: groups of (reason, scope) with enough different runs.

    Runs without a domain, scenario or project are no ground for a policy. prefer: expected ids;
    suppress: forbidden ids and disliked ones; route domains for the first two reasons only.
    """
    scope = F.struct(F.array_sort("domains").alias("domains"), F.array_sort("scenarios").alias("scenarios"), F.array_sort("project_keys").alias("project_keys"))
    known = runs.where(is_bounded(F.col("domains"), F.col("scenarios"), F.col("project_keys"))).select("query_run_id", scope.alias("scope"))
    rows = feedback.where(F.col("reason").isin(*RETRIEVAL_REASONS, *REASONING_REASONS)).join(known, "query_run_id")
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), F.array().cast("array<string>"))))))
    groups = rows.groupBy("reason", "scope").agg(F.count_distinct("query_run_id").alias("runs"), F.array_sort(F.collect_set("query_run_id")).alias("evidence"), ids("expected_ids").alias("prefer"), ids("forbidden_ids").alias("_forbidden"), F.array_sort(F.collect_set(F.when(F.col("usefulness") == "not_useful", F.col("memory_id")))).alias("_disliked"))
    retrieval = F.col("reason").isin(*RETRIEVAL_REASONS)
    kind = F.when(retrieval, "retrieval").otherwise("reasoning")
    decision = F.when(retrieval, F.lit(None).cast("string")).when(F.col("reason") == "conflicting_evidence", "abstain").otherwise("warn")
    identity = short_hash("", 16, F.col("reason"), F.to_json("scope"), F.to_json("evidence"))
    none = F.array().cast("array<string>")
    return groups.where(F.col("runs") >= threshold).select(
        F.concat(F.lit("policy_mined_"), kind, F.lit("_"), identity).alias("policy_id"), kind.alias("kind"), F.lit("shadow").alias("status"), "reason", "scope", "runs", "evidence",
        F.when(retrieval, F.col("prefer")).otherwise(none).alias("prefer"),
        F.when(retrieval, F.array_sort(F.array_union("_forbidden", "_disliked"))).otherwise(none).alias("suppress"),
        F.when(F.col("reason").isin(*RETRIEVAL_REASONS[:2]), F.col("scope.domains")).otherwise(none).alias("route_domains"),
        (F.col("reason") == "should_abstain").alias("abstain"), decision.alias("decision"),
    )


def mine_failures(failures: DataFrame, threshold: int = 3) -> DataFrame:
    """(shape, scope, cases) of failed evaluation cases that come up often enough."""
    return failures.where(is_bounded(F.col("scope.domains"), F.col("scope.scenarios"), F.col("scope.project_keys"))).groupBy("shape", "scope").agg(F.count(F.lit(1)).alias("cases")).where(F.col("cases") >= threshold)


def propose(old: DataFrame, new: DataFrame) -> DataFrame:
    """Proposals with an id that is not there yet are added; a known id stays as it was decided."""
    return old.unionByName(new.join(old.select("policy_id"), "policy_id", "left_anti"), allowMissingColumns=True)


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (policy_id, accepted): shadow proposals become accepted or rejected; decided ones stay."""
    rows = proposals.join(decisions.groupBy("policy_id").agg(F.max("accepted").alias("_a")), "policy_id", "left")
    return rows.withColumn("status", F.when((F.col("status") == "shadow") & F.col("_a").isNotNull(), F.when(F.col("_a"), "accepted").otherwise("rejected")).otherwise(F.col("status"))).drop("_a")


def applies(policy: str, task: Column, domains: Column, scenarios: Column, projects: Column) -> Column:
    """Scope meets the case; no excluded term, every required and, if any are named, one optional term in the task."""
    p = lambda c: F.col(f"{policy}.{c}")
    meets = lambda own, theirs: (F.coalesce(F.size(own), F.lit(0)) == 0) | F.arrays_overlap(own, theirs)
    has = lambda t: F.contains(F.lower(task), F.lower(t))
    return meets(p("domains"), domains) & meets(p("scenarios"), scenarios) & meets(p("project_keys"), projects) & ~F.coalesce(F.exists(p("excluded_terms"), has), F.lit(False)) & F.coalesce(F.forall(p("all_terms"), has), F.lit(True)) & ((F.coalesce(F.size(p("any_terms")), F.lit(0)) == 0) | F.exists(p("any_terms"), has))


def shadow(cases: DataFrame, results: DataFrame, policies: DataFrame) -> DataFrame:
    """What the ranking of each case would be under the shadow policies that apply to it.

    cases: case_id, task, domains, scenarios, project_keys, expected, forbidden, abstain.
    results: case_id, id, rank, injected. policies: policy_id, status, the scope and term arrays,
    prefer, suppress, abstain_without_preferred. Suppressed ids go, preferred ones come first,
    and a policy may abstain when no preferred id is left.
    """
    live = policies.where("status = 'shadow'").select(F.struct(*policies.columns).alias("p"))
    pairs = cases.join(live, applies("p", F.col("task"), F.col("domains"), F.col("scenarios"), F.col("project_keys")))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(f"p.{c}"), F.array().cast("array<string>"))))))
    plan = pairs.groupBy("case_id").agg(F.array_sort(F.collect_set("p.policy_id")).alias("policies"), flat("prefer").alias("_prefer"), flat("suppress").alias("_suppress"), F.max("p.abstain_without_preferred").alias("_abstain"))
    rows = results.join(plan, "case_id", "left").where(~F.coalesce(F.array_contains("_suppress", F.col("id")), F.lit(False))).withColumn("_liked", F.coalesce(F.array_contains("_prefer", F.col("id")), F.lit(False)))
    order = Window.partitionBy("case_id").orderBy(F.col("_liked").desc(), "rank")
    liked = F.max("_liked").over(Window.partitionBy("case_id"))
    kept = rows.withColumn("_any", liked).where(~F.coalesce("_abstain", F.lit(False)) | F.col("_any")).withColumn("_place", F.row_number().over(order))
    found = kept.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "id"))), lambda x: x["id"]).alias("matched"), F.transform(F.array_sort(F.collect_list(F.when(F.col("injected"), F.struct("_place", "id")))), lambda x: x["id"]).alias("injected"))
    none = F.array().cast("array<string>")
    out = cases.join(found, "case_id", "left").join(plan.select("case_id", "policies"), "case_id", "left").withColumn("matched", F.coalesce("matched", none)).withColumn("injected", F.coalesce("injected", none)).withColumn("policies", F.coalesce("policies", none))
    bad, abstained = F.size(F.array_intersect("forbidden", "injected")) > 0, F.size("injected") == 0
    passed = (F.size(F.array_except("expected", "injected")) == 0) & ~bad & (~F.col("abstain") | abstained)
    return out.select("case_id", "policies", "matched", "injected", "expected", "abstain", bad.alias("false_injection"), (F.col("abstain") & ~abstained).alias("abstention_failure"), passed.alias("passed"))


def shadow_metrics(results: DataFrame) -> DataFrame:
    """One row; recall over answerable cases, 1 if there is none."""
    answerable = F.size("expected") > 0
    mean = lambda k: F.coalesce(F.avg(F.when(answerable, recall_at(F.col("expected"), F.col("matched"), k))), F.lit(1.0))
    wanted = F.count_if("abstain")
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), mean(1).alias("recall_1"), mean(3).alias("recall_3"), F.coalesce(F.avg(F.col("false_injection").cast("double")), F.lit(0.0)).alias("false_injection_rate"), F.when(wanted == 0, 0.0).otherwise(F.count_if("abstention_failure") / wanted).alias("abstention_failure_rate"))


def reasoning(cases: DataFrame, policies: DataFrame) -> DataFrame:
    """(case_id, decision, violations): abstain above warn above proceed over a case's policies.

    cases: case_id, context (has_unresolved_conflict, has_expired_fact, has_documented_evidence,
    expanded_layers, operation_risk). policies: case_id, checks, required_layers, on_violation.
    """
    c = lambda f: F.col(f"context.{f}")
    broken = F.array(
        F.when(c("has_unresolved_conflict"), "unresolved_conflict"),
        F.when(c("has_expired_fact"), "expired_fact"),
        F.when(~c("has_documented_evidence"), "missing_documented_evidence"),
        F.when(~F.array_contains(c("expanded_layers"), "knowledge"), "insufficient_detail"),
        F.when((c("operation_risk") == "high") & ~c("has_documented_evidence"), "high_risk_without_evidence"),
    )
    rows = policies.join(cases.where("context is not null"), "case_id")
    layers = F.transform(F.array_except("required_layers", c("expanded_layers")), lambda x: F.concat(F.lit("required_layer:"), x))
    found = rows.withColumn("_v", F.concat(F.array_intersect("checks", F.filter(broken, lambda x: x.isNotNull())), layers))
    level = F.when(F.size("_v") == 0, 0).when(F.col("on_violation") == "abstain", 2).otherwise(1)
    each = found.groupBy("case_id").agg(F.max(level).alias("_level"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_v")))).alias("violations"))
    out = cases.select("case_id").join(each, "case_id", "left")
    return out.select("case_id", F.element_at(F.array(F.lit("proceed"), F.lit("warn"), F.lit("abstain")), F.coalesce("_level", F.lit(0)) + 1).alias("decision"), F.coalesce("violations", F.array().cast("array<string>")).alias("violations"))


def status(policies: DataFrame, runs: DataFrame) -> DataFrame:
    """Counters of policies, and whether simulation is ready: 30 scoped runs and a shadow policy."""
    p = policies.agg(F.count_if(F.col("status") == "shadow").alias("shadow"), F.count_if(F.col("status") == "deprecated").alias("deprecated"))
    r = runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(is_bounded(F.col("domains"), F.col("scenarios"), F.col("project_keys"))).alias("scoped_runs"))
    return p.crossJoin(r).withColumn("ready", (F.col("scoped_runs") >= READY_RUNS) & (F.col("shadow") > 0))


def in_order(policies: DataFrame) -> DataFrame:
    return policies.orderBy(F.col("priority").desc(), "policy_id")
