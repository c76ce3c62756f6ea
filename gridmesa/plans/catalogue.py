"""Registry of the terrain queries and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from gridmesa.plans import queries_bases, queries_geometry, queries_graph, queries_grid, queries_sources

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (queries_grid, queries_geometry, queries_graph, queries_bases, queries_sources):
    QUERIES |= _part.REGISTER.queries
    ORACLES |= _part.REGISTER.oracles
