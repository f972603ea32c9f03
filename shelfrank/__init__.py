"""Catalogue search and recommendation as Spark DataFrame jobs."""

__all__ = ["functions", "operators", "plans", "sources"]
