"""All queries by name and the SQL they must agree with."""

from __future__ import annotations

import importlib

from mnemoloom.plans import base

MODULES = ("relational", "scalars", "vectors", "events", "graphs", "geometry", "contexts", "evaluation", "consolidation")


def _loaded() -> None:
    for module in MODULES:
        importlib.import_module(f"mnemoloom.plans.{module}")


def queries() -> dict:
    _loaded()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(base.ORACLES)
