"""Retrieval metrics, calibration, policy simulation and provider comparison, over tables of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Decimal places of scores that decide an order.
PLACES = 12


def _none() -> Column:
    return F.array().cast("array<string>")


def recall_at(expected: Column, found: Column, k: int) -> Column:
    """Share of expected ids among the first k; 1 if none is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(expected, F.slice(found, 1, k))) / F.size(expected))


def reciprocal_rank(expected: Column, found: Column) -> Column:
    """1 / place of the first expected id, 0 without one; 1 if none is expected."""
    places = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(expected) == 0, 1.0).when(F.size(places) == 0, 0.0).otherwise(1.0 / F.array_min(places))


def _dcg(grades: Column) -> Column:
    gains = F.transform(grades, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2.0))
    return F.aggregate(gains, F.lit(0.0), lambda s, g: s + g)


def ndcg_at(grades: Column, found: Column, k: int = 5) -> Column:
    """grades: map of id to 0..3. 1 if the ideal is 0."""
    own = F.transform(F.slice(found, 1, k), lambda x: F.coalesce(F.element_at(grades, x), F.lit(0)).cast("double"))
    ideal = F.slice(F.reverse(F.array_sort(F.transform(F.map_values(grades), lambda g: g.cast("double")))), 1, k)
    return F.when(_dcg(ideal) == 0, 1.0).otherwise(_dcg(own) / _dcg(ideal))


def run_cases(cases: DataFrame, ranked: DataFrame, packets: DataFrame) -> DataFrame:
    """One row for each case: metrics, what is wrong, passed.

    cases: case_id, expected, forbidden, abstain, expected_ranks (map), grades (map). ranked:
    query_id, id, rank. packets: query_id, injected. Ranks are judged on what was matched;
    expected and forbidden ids on what was injected.
    """
    matched = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("matched"))
    rows = cases.join(matched, cases.case_id == matched.query_id, "left").drop("query_id").join(packets.select(F.col("query_id"), "injected"), F.col("case_id") == F.col("query_id"), "left").drop("query_id")
    rows = rows.withColumn("matched", F.coalesce("matched", _none())).withColumn("injected", F.coalesce("injected", _none()))
    ranks = F.map_from_entries(F.transform("matched", lambda x, i: F.struct(x, i + 1)))
    late = F.map_keys(F.map_filter("expected_ranks", lambda k, v: F.coalesce(F.element_at(ranks, k), F.lit(1 << 30)) > v))
    grades = F.when(F.size("grades") > 0, F.col("grades")).otherwise(F.map_from_entries(F.transform("expected", lambda x: F.struct(x, F.lit(1)))))
    rows = rows.withColumn("missing", F.array_except("expected", "injected")).withColumn("forbidden_injected", F.array_intersect("forbidden", "injected")).withColumn("rank_violations", late).withColumn("abstained", F.size("injected") == 0)
    passed = (F.size("missing") == 0) & (F.size("forbidden_injected") == 0) & (F.size("rank_violations") == 0) & (~F.col("abstain") | F.col("abstained"))
    return rows.select(
        "case_id", "abstain", "expected", "matched", "injected", "missing", "forbidden_injected", "rank_violations", "abstained",
        *[recall_at(F.col("expected"), F.col("matched"), k).alias(f"recall_{k}") for k in (1, 3, 5)],
        reciprocal_rank(F.col("expected"), F.col("matched")).alias("reciprocal_rank"),
        ndcg_at(grades, F.col("matched")).alias("ndcg_5"),
        passed.alias("passed"),
    )


def suite(results: DataFrame) -> DataFrame:
    """Means of run_cases(): recall, MRR and nDCG over answerable cases only; one row."""
    answerable = F.size("expected") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(answerable, F.col(c))), F.lit(0.0))
    predicted, right, wanted = F.count_if("abstained"), F.count_if(F.col("abstained") & F.col("abstain")), F.count_if("abstain")
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        *[mean(c).alias(c) for c in ("recall_1", "recall_3", "recall_5", "ndcg_5")], mean("reciprocal_rank").alias("mrr"),
        F.coalesce(F.avg((F.size("forbidden_injected") > 0).cast("double")), F.lit(0.0)).alias("false_injection_rate"),
        F.when(predicted == 0, F.when(wanted == 0, 1.0).otherwise(0.0)).otherwise(right / predicted).alias("abstention_precision"),
    )


def calibrate(cases: DataFrame, candidates: DataFrame, feedback: DataFrame, grid: DataFrame) -> DataFrame:
    """One row for each configuration, best first (`place` 1).

    cases: case_id, expected, forbidden, abstain. candidates: case_id, id, base, model. feedback:
    memory_id, usefulness. grid: min_score, base_weight, result_limit (a few dozen rows). A
    candidate's score is base_weight * base + (1 - base_weight) * model, to PLACES places; recall
    and mrr are compared to as many, since the last bits of a mean depend on the order of its sum.
    """
    disliked = feedback.where("usefulness = 'not_useful'").select(F.col("memory_id").alias("id")).distinct().withColumn("_bad", F.lit(True))
    near = lambda c: F.round(c, PLACES)
    scored = candidates.crossJoin(grid).withColumn("_s", near(F.col("base_weight") * F.col("base") + (1 - F.col("base_weight")) * F.col("model"))).where("_s >= min_score")
    order = Window.partitionBy("min_score", "base_weight", "result_limit", "case_id").orderBy(F.col("_s").desc(), "id")
    chosen = scored.withColumn("_r", F.row_number().over(order)).where("_r <= result_limit").join(disliked, "id", "left")
    per = chosen.groupBy("min_score", "base_weight", "result_limit", "case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("found"), F.count_if("_bad").alias("_disliked"))
    keys = ["min_score", "base_weight", "result_limit"]
    all_ = cases.crossJoin(grid).join(per, [*keys, "case_id"], "left").withColumn("found", F.coalesce("found", _none()))
    answerable = F.size("expected") > 0
    out = all_.groupBy(*keys).agg(
        F.sum(F.size(F.array_intersect("forbidden", "found"))).alias("false_injections"),
        F.count_if(F.col("abstain") & (F.size("found") > 0)).alias("abstention_failures"),
        F.sum(F.coalesce("_disliked", F.lit(0))).alias("disliked_hits"),
        F.coalesce(F.sum(F.when(answerable, F.size(F.array_intersect("expected", "found")))) / F.sum(F.when(answerable, F.size("expected"))), F.lit(1.0)).alias("recall"),
        F.coalesce(F.avg(F.when(answerable, reciprocal_rank(F.col("expected"), F.col("found")))), F.lit(1.0)).alias("mrr"),
    )
    best = Window.orderBy("false_injections", "abstention_failures", "disliked_hits", near("recall").desc(), near("mrr").desc(), F.col("min_score").desc(), "base_weight", "result_limit")
    return out.withColumn("place", F.row_number().over(best))  # the grid's rows only


def provider_metrics(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Metrics of each provider over all cases; unanswerable ones count as recalled.

    results: provider, case_id, ids, latency_ms, unmapped.
    """
    rows = cases.join(results, "case_id")
    bad = F.size(F.array_intersect("forbidden", "ids")) > 0
    found = F.size("ids") > 0
    passed = (F.size(F.array_except("expected", "ids")) == 0) & ~bad & (~F.col("abstain") | ~found)
    predicted, wanted = F.count_if(~found), F.count_if("abstain")
    return rows.groupBy("provider").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"),
        F.avg(recall_at(F.col("expected"), F.col("ids"), 1)).alias("recall_1"), F.avg(recall_at(F.col("expected"), F.col("ids"), 3)).alias("recall_3"),
        F.avg(bad.cast("double")).alias("false_injection_rate"),
        F.when(predicted == 0, 1.0).otherwise(F.count_if(~found & F.col("abstain")) / predicted).alias("abstention_precision"),
        F.when(wanted == 0, 0.0).otherwise(F.count_if(F.col("abstain") & found) / wanted).alias("abstention_failure_rate"),
        F.avg("latency_ms").alias("average_latency_ms"), F.sum("unmapped").alias("unmapped"),
    )


def regressions(metrics: DataFrame, native: str = "native") -> DataFrame:
    """Providers that pass fewer cases, inject more or fail to abstain more often than the native one."""
    own = metrics.where(F.col("provider") == native).select(F.col("passed").alias("_p"), F.col("false_injection_rate").alias("_f"), F.col("abstention_failure_rate").alias("_a"))
    rows = metrics.where(F.col("provider") != native).crossJoin(F.broadcast(own))  # own is one row
    return rows.select("provider", ((F.col("passed") < F.col("_p")) | (F.col("false_injection_rate") > F.col("_f")) | (F.col("abstention_failure_rate") > F.col("_a"))).alias("regressed"))


def comparison_markdown(metrics: DataFrame) -> DataFrame:
    """Rows of a Markdown table of provider_metrics(), by provider."""
    f = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double"))
    line = F.concat_ws(" | ", "provider", F.col("passed").cast("string"), F.col("failed").cast("string"), f("recall_1", 4), f("recall_3", 4), f("false_injection_rate", 4), f("abstention_failure_rate", 4), f("average_latency_ms", 2), F.col("unmapped").cast("string"))
    return metrics.select("provider", F.concat(F.lit("| "), line, F.lit(" |")).alias("line")).orderBy("provider")


def normalise_results(raw: DataFrame, most: int = 100) -> DataFrame:
    """(provider, case_id, position, id, text, score) from JSON answers of three shapes: a list, {"results"}, {"data"}."""
    answer = F.try_parse_json("response")
    items = F.coalesce(*[F.try_variant_get(answer, p, "array<variant>") for p in ("$.results", "$.data", "$")])
    rows = raw.select("provider", "case_id", F.posexplode(F.slice(items, 1, most)).alias("position", "_x"))
    get = lambda kind, *paths: F.coalesce(*[F.try_variant_get("_x", f"$.{p}", kind) for p in paths])
    return rows.select("provider", "case_id", "position", get("string", "id", "memory_id", "uuid").alias("id"), get("string", "text", "content", "memory").alias("text"), get("double", "score", "relevance", "similarity").alias("score"))
