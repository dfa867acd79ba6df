"""Every query of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from reelwright.plans import logs, matching, pictures, protocols, records, reports, selections, timelines, versions

_MODULES = (matching, timelines, records, versions, protocols, pictures, logs, reports, selections)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
