"""All queries of the plans, and their SQL."""

from __future__ import annotations

from wayfold.plans import assemble, editing, intake, linework, presenting, records, scenes, trajectories

_MODULES = (trajectories, records, scenes, editing, linework, intake, assemble, presenting)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
