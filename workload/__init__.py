"""Queries over the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("compare", "standardize", "reports", "matching", "resolve", "pricing", "sources", "plans")


def load_registry():
    for module in MODULES:
        importlib.import_module(f"workload.{module}")
    from workload.base import REGISTRY
    return REGISTRY
