"""All queries of the library outside the text operators, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("signals", "joins", "corpus", "cohorts", "graphs", "tracks", "streams")

QUERIES, SQL = {}, {}
for _name in MODULES:
    _module = import_module(f"signalloom.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
