"""Quality audit of knowledge and sources: findings and a summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes that are errors; all others are warnings.
ERRORS = ("event_timeline_invalid", "missing_source_manifest", "unknown_evidence_anchor", "source_ingestion_failed", "invalid_refined_knowledge", "invalid_duplicate_source", "source_without_vault_object", "missing_vault_object")
#: Limits.
LIMITS = {"body": 600, "head_share": 0.65, "aliases": 8, "scenarios": 6, "tags": 8}


def _current(knowledge: DataFrame) -> DataFrame:
    return knowledge.where("status = 'active' and layer = 'knowledge'")


def _anchors(knowledge: DataFrame) -> DataFrame:
    """Every anchor of every supported claim of current knowledge; a claim without one has a null row."""
    claims = _current(knowledge).select("id", "file_path", F.explode("claims").alias("c")).where("c.status = 'supported'")
    return claims.select("id", "file_path", F.col("c.id").alias("claim_id"), F.explode_outer("c.evidence").alias("a"))


def _grounded(knowledge: DataFrame, manifests: DataFrame) -> DataFrame:
    """(id, file_path, claim_id, grounded): all of a claim's anchors are sections of available sources, with the hash."""
    there = manifests.where("availability = 'available'").select("source_id", F.explode("sections").alias("s")).select(F.col("source_id").alias("_src"), F.col("s.section_id").alias("_sec"), F.col("s.text_hash").alias("_hash"))
    rows = _anchors(knowledge).join(there.distinct(), (F.col("a.source_id") == F.col("_src")) & (F.col("a.section_id") == F.col("_sec")) & (F.col("a.quote_hash") == F.col("_hash")), "left")
    return rows.groupBy("id", "file_path", "claim_id").agg(F.min(F.col("a").isNull() | F.col("_src").isNotNull()).alias("grounded"))


def findings(knowledge: DataFrame, manifests: DataFrame, projects: DataFrame, vault: DataFrame, health: DataFrame, checkpoints: DataFrame, streams: DataFrame, payloads_missing: DataFrame) -> DataFrame:
    """(severity, code, subject, message), sorted.

    manifests: MANIFEST columns plus redaction_policy. projects (project_key). vault (vault_id).
    health: update_health() rows. checkpoints: connector_id, mode, complete, unresolved,
    failures array<struct<source_id, error>>. streams: ledger.verify() rows. payloads_missing:
    (event_id, payload_object) without a vault object.
    """

    def found(df: DataFrame, code: str, subject: str, message: Column) -> DataFrame:
        return df.select(F.lit("error" if code in ERRORS else "warning").alias("severity"), F.lit(code).alias("code"), F.col(subject).alias("subject"), message.cast("string").alias("message"))

    now = _current(knowledge)
    text = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    length = F.length(F.trim(F.coalesce("body", F.lit(""))))
    share = F.greatest(F.lit(0.0), F.col("raw_length") - F.length("body")) / F.col("raw_length") if "raw_length" in knowledge.columns else F.lit(0.0)
    known = projects.select("project_key").distinct()
    sources = manifests.select(F.col("source_id").alias("_known")).distinct()
    wanted = now.select("id", F.explode("source").alias("_ref")).where(F.startswith("_ref", F.lit("source:"))).select("id", F.regexp_replace("_ref", "^source:", "").alias("_known"))
    pending = F.col("processing_status") == "pending"
    refined = manifests.where("processing_status = 'refined'").select("source_id", F.explode("refined_knowledge_ids").alias("id"))
    hashes = manifests.select("source_id", F.explode("sections").alias("s")).select("source_id", F.col("s.section_id").alias("section_id"), F.col("s.text_hash").alias("quote_hash"))
    current = _anchors(knowledge).where("a is not null").select("id", "a.source_id", "a.section_id", "a.quote_hash").join(hashes.distinct(), ["source_id", "section_id", "quote_hash"], "left_semi").select("id", "source_id").distinct()
    target = manifests.select(F.col("source_id").alias("_t"), F.col("availability").alias("_ta"), F.col("processing_status").alias("_tp"))
    doubles = manifests.where("processing_status = 'duplicate'").join(target, F.col("duplicate_of") == F.col("_t"), "left")
    upstream = F.coalesce(*[F.col(f"version.{s}") for s in ("path_hash", "commit_sha", "revision", "etag", "opaque_version", "updated_at")])
    held = vault.select(F.col("vault_id").alias("vault_object")).distinct()
    unknown = now.select(F.col("id").alias("subject"), F.explode("project_keys").alias("project_key")).unionByName(manifests.select(F.col("source_id").alias("subject"), F.explode("project_keys").alias("project_key"))).join(known, "project_key", "left_anti")
    parts = [
        found(now.where((F.col("kind") != "profile") & (length < LIMITS["body"])), "knowledge_body_too_thin", "id", text(length.cast("string"), "characters")),
        found(now.where(share > LIMITS["head_share"]), "metadata_frontmatter_dominates", "id", text("share", F.round(share, 3).cast("string"))),
        *[found(now.where(F.size(c) > LIMITS[c]), f"too_many_{c}", "id", text(F.size(c).cast("string"), c)) for c in ("aliases", "scenarios", "tags")],
        found(unknown, "unknown_project_key", "subject", F.col("project_key")),
        found(wanted.join(sources, "_known", "left_anti"), "missing_source_manifest", "id", F.col("_known")),
        found(_grounded(knowledge, manifests).where("not grounded"), "unknown_evidence_anchor", "id", F.col("claim_id")),
        found(manifests.where("availability = 'missing'"), "source_missing_upstream", "source_id", F.col("title")),
        found(manifests.where(pending), "source_without_refined_knowledge", "source_id", F.col("title")),
        found(manifests.where(~pending & ~F.col("processed_content_hash").eqNullSafe(F.col("content_hash"))), "source_review_stale", "source_id", F.col("title")),
        found(refined.join(current, ["source_id", "id"], "left_anti"), "invalid_refined_knowledge", "source_id", F.col("id")),
        found(doubles.where(F.col("_t").isNull() | (F.col("_ta") != "available") | (F.col("_tp") == "duplicate") | (F.col("_t") == F.col("source_id"))), "invalid_duplicate_source", "source_id", F.col("duplicate_of")),
        found(manifests.where("vault_object is null"), "source_without_vault_object", "source_id", F.col("title")),
        found(manifests.where("vault_object is not null").join(held, "vault_object", "left_anti"), "missing_vault_object", "source_id", F.col("vault_object")),
        found(manifests.where(upstream.isNull()), "source_without_upstream_version", "source_id", F.col("title")),
        found(manifests.where("redaction_policy = 'not-applied'"), "source_redaction_not_recorded", "source_id", F.col("title")),
        found(health.where("state = 'unchecked'"), "source_connector_unchecked", "connector_id", F.col("connector_id")),
        found(health.where("state = 'stale'"), "source_update_check_stale", "connector_id", F.col("connector_id")),
        found(health.where("state = 'current' and updates_available > 0"), "source_update_available", "connector_id", F.col("updates_available")),
        found(health.where("state = 'current' and verification_required > 0"), "source_update_verification_required", "connector_id", F.col("verification_required")),
        found(checkpoints.where("mode = 'complete' and not complete"), "source_inventory_incomplete", "connector_id", F.col("unresolved")),
        found(checkpoints.select("connector_id", F.explode("failures").alias("f")), "source_ingestion_failed", "connector_id", text(F.col("f.source_id"), F.col("f.error"))),
        found(streams.where("not valid"), "event_timeline_invalid", "stream_id", F.col("first_bad")),
        found(payloads_missing, "event_payload_missing", "event_id", F.col("payload_object")),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("severity", "code", "subject")


def summary(knowledge: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row: counts, coverages (1 for no rows) and exact medians (0 for no rows)."""
    classified = (F.col("processing_status") != "pending") & F.col("processed_content_hash").eqNullSafe(F.col("content_hash"))
    ratio = lambda test: F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(F.count_if(test) / F.count(F.lit(1)))
    m = manifests.agg(F.count(F.lit(1)).alias("source_documents"), F.count_if(classified).alias("classified_sources"), ratio(classified).alias("source_coverage"), ratio(F.col("availability") == "available").alias("availability_coverage"), ratio(F.col("vault_object").isNotNull()).alias("vault_coverage"))
    k = knowledge.where("status = 'active'").agg(F.count_if(F.col("layer") == "knowledge").alias("knowledge_documents"), F.count_if(F.col("layer") == "synopsis").alias("synopsis_documents"), F.coalesce(F.median(F.when(F.col("layer") == "knowledge", F.length(F.trim("body")))), F.lit(0.0)).alias("median_body_chars"))
    c = _grounded(knowledge, manifests).agg(F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(F.count_if("grounded") / F.count(F.lit(1))).alias("claim_coverage"))
    return m.crossJoin(k).crossJoin(c)
