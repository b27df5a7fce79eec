"""Registry of the engine's own queries."""

from lodestrata.queries import graphs, knowledge, lifecycle, models, pipelines, relational, retrieval, streams, writes

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (relational, graphs, retrieval, streams, writes, models, pipelines, knowledge, lifecycle):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
