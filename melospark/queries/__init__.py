"""Queries over the given tables, one or more for each operator, with SQL for DuckDB."""

from melospark.queries import ratings, scores, tracks  # noqa: F401
from melospark.queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
