"""Registered queries: each module pairs a Spark plan with the SQL text that checks it."""

from __future__ import annotations

import importlib

MODULES = ("geometry", "selection", "matching", "evaluation", "quality", "tracking", "dataset")


def load_all():
    for m in MODULES:
        importlib.import_module(f"fieldlens.plans.{m}_queries")
    from fieldlens.plans.registry import REGISTRY

    return REGISTRY
