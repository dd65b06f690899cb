"""Composed jobs and the test-table bindings used by ``__spark_entry__``."""

from __future__ import annotations

import importlib

_MODULES = ("q_sources", "q_clean", "q_prepare", "q_profile", "q_evaluate", "q_monitor", "q_score", "q_jobs",
            "q_metrics", "q_registry", "q_train", "q_checks", "q_streams")


def load_all():
    """Import every binding module (registration side effect) and return (QUERIES, ORACLE)."""
    from tabwatch.plans import catalog

    for m in _MODULES:
        importlib.import_module(f"tabwatch.plans.{m}")
    return catalog.QUERIES, catalog.ORACLE
