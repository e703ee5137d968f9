"""All queries over the test tables by name, and DuckDB SQL for each that SQL can express."""

from marlstone.plans import document_queries, graph_queries, search_queries
from marlstone.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "hybrid_search"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "document_queries", "graph_queries", "search_queries"]
