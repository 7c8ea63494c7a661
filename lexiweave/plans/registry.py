"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_queries", "consistency_queries", "evaluation_queries", "relational_queries", "review_queries", "judgment_queries", "answer_queries", "control_queries", "loop_queries", "batch_queries", "inference_queries", "source_queries", "request_queries", "audit_queries")
FLAGSHIP = "g09_summary_metrics"


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"lexiweave.plans.{m}").QUERIES
    return out


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
