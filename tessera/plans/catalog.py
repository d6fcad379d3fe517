"""All queries of the engine and their SQL."""

from __future__ import annotations

from tessera.plans import domain_queries, expansion_queries, pack_queries, planning_queries, relational_queries, scalar_queries, signal_queries, workflow_queries

MODULES = (scalar_queries, relational_queries, domain_queries, pack_queries, planning_queries, expansion_queries, workflow_queries, signal_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
