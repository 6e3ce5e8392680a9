"""All queries of the library with their SQL twins."""

from .plans import graph_queries, kernel_queries, source_queries, table_queries, voxel_queries  # noqa: F401
from .query import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
