"""tallytree: company-filing statements, filing indexes and price series as plain Spark jobs."""

from tallytree.star import Star

__all__ = ["Star"]
