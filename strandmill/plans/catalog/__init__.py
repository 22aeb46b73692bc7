"""Queries by name. Importing the package fills the registry."""

from strandmill.plans.catalog import (  # noqa: F401
    cluster_queries, corpus, file_queries, metric_queries, rearrange, structure_queries, tokens,
)
from strandmill.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
