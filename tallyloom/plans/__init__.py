"""Queries over the supplied tables."""

from __future__ import annotations

import importlib

#: Modules with a registry ``R``, in the order in which their queries are listed.
MODULES = ["relational_queries", "finding_queries", "text_queries", "graph_queries", "extra_queries"]


def all_registries() -> list:
    return [importlib.import_module(f"tallyloom.plans.{m}").R for m in MODULES]
