"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("scans", "relational", "columns", "learners")


def load() -> tuple[dict, dict]:
    """(queries, check SQL) of every query module."""
    from quillrank.queries import registry

    for module in MODULES:
        importlib.import_module(f"quillrank.queries.{module}")
    return registry.QUERIES, registry.CHECKS
