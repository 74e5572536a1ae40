"""Driver queries: each pairs a DataFrame built from the operators with the same result in SQL."""

from __future__ import annotations

import importlib

MODULES = ["features", "drift", "metrics", "rolling", "contracts", "scalars", "models", "streams", "sources"]


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    found: dict = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"checks.{name}")
        except ModuleNotFoundError:
            continue
        found.update(module.QUERIES)
    return found
