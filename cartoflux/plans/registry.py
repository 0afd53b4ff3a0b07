"""Every query of the library, by name, and the SQL that checks it."""

from cartoflux.plans import dimension_queries, map_queries, network_queries, text_queries

QUERIES: dict = network_queries.QUERIES | map_queries.QUERIES | dimension_queries.QUERIES | text_queries.QUERIES
ORACLE_SQL: dict = network_queries.SQL | map_queries.SQL | dimension_queries.SQL | text_queries.SQL
