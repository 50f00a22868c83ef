"""Registered queries over the driver's tables, each with its DuckDB twin where SQL has one."""

from cueflow.queries import relational, scalars, sequential, streams
from cueflow.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "relational", "scalars", "sequential", "streams"]
