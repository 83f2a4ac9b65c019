"""Named queries over the driver tables and the SQL that states their results."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _name in ("dims", "headers", "flows", "l7", "streams", "more", "capture"):
    _part = importlib.import_module(f"netlens.plans.q_{_name}")
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
