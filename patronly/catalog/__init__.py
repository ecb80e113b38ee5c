"""Registered queries and their DuckDB statements."""

from . import (  # noqa: F401  (importing registers)
    order_queries, customer_queries, report_queries, feature_queries, model_queries,
    timeline_queries,
)
from .entries import ORACLES, QUERIES  # noqa: F401
