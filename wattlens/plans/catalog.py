"""Importing this module registers every query."""

from wattlens.plans import data_queries, grid_queries, list_queries, model_queries  # noqa: F401
from wattlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
