"""Queries over the engine's own operators, and the SQL each must equal."""

from __future__ import annotations

from . import queries_alerts, queries_reports, queries_rules, queries_windows

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (queries_windows, queries_rules, queries_alerts, queries_reports):
    for _name, (_query, _sql) in _module.TABLE.items():
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLES[_name] = _sql
