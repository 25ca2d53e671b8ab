"""All queries of the library."""

from . import q_aggs, q_expr, q_grid, q_joins, q_select, q_sources, q_windows  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
