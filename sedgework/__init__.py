"""Spark-first hybrid retrieval and corpus processing."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
