"""Imports every module that registers queries; the entry point reads the two dicts from here."""

from __future__ import annotations

from orrery.plans import compounds, evidences, facts, graphs, letters, pdfs, programmes, search, sql_surface, stored, streams, tables, templates  # noqa: F401
from orrery.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
