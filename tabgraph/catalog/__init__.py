"""Every registered query, by module."""

from tabgraph.catalog import dense, evaluation, relational, similarities, storage  # noqa: F401
from tabgraph.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
