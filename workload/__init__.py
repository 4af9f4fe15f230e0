"""The engine's operators bound to the TPC-H-like test tables, each with its SQL where SQL can say it."""

from .registry import ORACLES, QUERIES
from . import detector_queries, feature_queries, refinement_queries, relational_queries, run_queries, source_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
