"""All queries over the star schema, by name."""

from heliograph.plans import cluster_queries, series_queries, source_queries, store_queries, stream_queries, usage_queries  # noqa: F401
from heliograph.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
