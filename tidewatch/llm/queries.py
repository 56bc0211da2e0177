"""Queries of the subpackage, one module per problem. A missing module is an error, not a smaller set of queries."""

from __future__ import annotations

import importlib

_PARTS = ("p3", "p4", "p5", "p6", "p7", "p8", "p9", "p10")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in _PARTS:
    _module = importlib.import_module(f"tidewatch.llm.{_part}_queries")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
