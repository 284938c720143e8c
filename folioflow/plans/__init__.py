"""Registered queries over the given tables, each next to its SQL equivalent."""

from folioflow.plans import catalogue, columns, library, pages, search, streams  # noqa: F401, I001
from folioflow.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
