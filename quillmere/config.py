"""Plain configuration: layers merged in a fixed order."""

from __future__ import annotations

#: Defaults that change answers.
DEFAULTS = {
    "retrieval": {"dense_k": 20, "graph_depth": 1, "graph_decay": 0.6, "rerank_window": 30, "rerank_keep": 8, "rerank_least": 0.55, "rerank_base_weight": 0.3, "rerank_model_weight": 0.7},
    "hook": {"least_score": 0.55, "max_tokens": 1200},
    "request": {"max_tokens": 4500, "clearance": "internal"},
}


def merge(*layers: dict) -> dict:
    """Later layers win; objects are merged, lists and values replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings(environment: dict | None = None, user: dict | None = None, project: dict | None = None, local: dict | None = None) -> dict:
    """Defaults, then environment, user, project and local layers, the last of which wins."""
    return merge(DEFAULTS, environment or {}, user or {}, project or {}, local or {})
