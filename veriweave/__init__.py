"""Data quality, record linkage, document building, graph and retrieval operators on Spark DataFrames."""

from veriweave.session import configure

__all__ = ["configure"]
