"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

GROUPS = ["search_queries", "recipe_queries", "history_queries", "graph_queries", "source_queries", "audit_queries",
          "catalog_queries"]


def load_all() -> None:
    """Import every query group; registration happens on import."""
    for g in GROUPS:
        importlib.import_module(f"rollbook.plans.{g}")
