"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("spam", "subjects", "mixing", "pii", "forms", "sitelines", "tokens", "packing", "quality")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in MODULES:
    _module = importlib.import_module(f"textlake.llm.{_m}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
