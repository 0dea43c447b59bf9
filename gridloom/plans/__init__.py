"""Whole pipelines and the registered queries."""

from __future__ import annotations

import importlib

MODULES = ("flagship", "grids", "covers", "rules", "inputs", "relations", "changes", "loading", "extensions")


def load_all():
    """Import every module that registers queries and return the registry."""
    for name in MODULES:
        importlib.import_module(f"gridloom.plans.{name}")
    return importlib.import_module("gridloom.plans.registry")
