"""Registered queries of the core library and their SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _name in ("queries_tracks", "queries_play", "queries_pose", "queries_tracking", "queries_more", "queries_extra", "queries_relational", "queries_cells", "queries_overlay", "queries_runs"):
    _module = import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)

FLAGSHIP = "agg01_movement_summary"
