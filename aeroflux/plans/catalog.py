"""Every registered query of the inventory engine with its DuckDB SQL."""

from __future__ import annotations

from aeroflux.plans import geometry_queries, ingest_queries, inventory_queries, output_queries, spatial_queries, speciation_queries, temporal_queries

MODULES = (ingest_queries, inventory_queries, speciation_queries, temporal_queries, spatial_queries, geometry_queries, output_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
