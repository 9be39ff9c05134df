"""Evaluation suites in YAML: a small corpus and its cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.schemas import requests, schema

CASE = "case_id string, expected array<string>, forbidden array<string>, abstain boolean, expected_ranks map<string,int>, grades map<string,int>"


def document(item: dict) -> dict:
    """A whole document from a suite's short form: aliases weigh 0.8, the first scenario 1 and others 0.7, tags 0.7."""
    names = lambda k: item.get(k) or []
    return {
        "id": item["id"], "kind": item.get("kind", "semantic"), "layer": "knowledge", "title": item["title"], "synopsis": item["body"][:500],
        "aliases": [{"value": a, "kind": "user_phrase", "weight": 0.8, "source": "documented"} for a in names("aliases")],
        "domain": item["domain"], "related_domains": [],
        "scenarios": [{"id": s, "role": "secondary" if k else "primary", "weight": 0.7 if k else 1.0} for k, s in enumerate(names("scenarios"))],
        "tags": [{"value": t, "weight": 0.7, "source": "taxonomy", "retrieval": True} for t in names("tags")],
        "status": item.get("status", "active"), "confidence": 0.9, "source_authority": "documented", "source": ["eval:suite"], "claims": [], "related_knowledge": [], "supersedes": [], "conflicts_with": [],
        "visibility": "project", "sensitivity": "internal", "project_keys": names("project_keys"), "capture_mode": "direct_material", "actor_type": "owner", "corroboration_count": 1, "episodes": [],
        "created_at": str(item.get("valid_from", "2024-01-01")), "updated_at": str(item.get("valid_from", "2024-01-01")), "valid_from": str(item.get("valid_from", "2024-01-01")),
        "valid_until": str(item["valid_until"]) if item.get("valid_until") else None, "file_path": f"knowledge/{item.get('kind', 'semantic')}/{item['domain']}/{item['id']}.md", "body": f"# {item['title']}\n\n{item['body']}\n",
    }


def load(spark: SparkSession, text: str, now: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(knowledge, requests, cases) of a suite: `documents` and `cases`, or one case on its own."""
    import yaml

    suite = yaml.safe_load(text)
    cases = suite["cases"] if "cases" in suite else [suite] if "task" in suite else []
    ids = [c.get("id") or f"case-{k:04d}" for k, c in enumerate(cases, 1)]
    rows = [{"query_id": i, "task": c["task"], "domains": c.get("domains") or ([c["domain"]] if c.get("domain") else []), "scenarios": c.get("scenarios") or [], "project_keys": c.get("project_keys") or [], "max_tokens": c.get("max_tokens", 4500), "now": str(c.get("now") or now or "2025-01-01")} for i, c in zip(ids, cases, strict=True)]
    asked = requests(spark.createDataFrame(rows, "query_id string, task string, domains array<string>, scenarios array<string>, project_keys array<string>, max_tokens int, now string"))
    judged = [(i, c.get("expected_memories") or [], c.get("forbidden_memories") or [], bool(c.get("abstain")), c.get("expected_ranks") or {}, c.get("relevance_grades") or {}) for i, c in zip(ids, cases, strict=True)]
    return spark.createDataFrame([document(d) for d in suite.get("documents") or []], schema("knowledge")), asked, spark.createDataFrame(judged, CASE)
