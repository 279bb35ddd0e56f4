"""Registered queries, by name, and their SQL."""

from __future__ import annotations

from . import flows, records, text

MODULES = [text, records, flows]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
