"""All registered queries and their SQL."""

from tableprobe.plans import model_queries, profile_queries, scaling_queries, source_queries, timeseries_queries

_AREAS = [profile_queries, timeseries_queries, model_queries, source_queries, scaling_queries]

QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
