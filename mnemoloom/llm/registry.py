"""Queries of the subpackage and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

import importlib

#: Modules that each define QUERIES and ORACLE_SQL.
MODULES = ("q_chat", "q_secrets", "q_quality", "q_bpe", "q_packing", "q_fingerprint", "q_language", "q_neardup", "q_warc", "q_html")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"mnemoloom.llm.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
