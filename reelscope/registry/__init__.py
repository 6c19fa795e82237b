"""Named queries over the benchmark tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "aggregates", "sources", "joins", "windows", "frames", "ranks", "plans", "streams")


def load() -> tuple[dict, dict]:
    """Import every query module and return (queries, oracle)."""
    from reelscope.registry import base

    for name in MODULES:
        importlib.import_module(f"reelscope.registry.{name}")
    return base.QUERIES, base.ORACLE
