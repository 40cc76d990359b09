"""Importing this module registers every query."""

from curate.workload import learning, rebalancing, reports, scores, texts  # noqa: F401
from curate.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
