"""Named queries over the test tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from tilewright.plans import data_queries, expression_queries, geo_queries, map_queries, service_queries, source_queries, spatial_queries, value_queries

FLAGSHIP = "flagship_tile_density"
PARTS = [expression_queries, geo_queries, spatial_queries, data_queries, value_queries, map_queries, service_queries, source_queries]

QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
