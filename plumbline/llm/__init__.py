"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from .registry import ORACLES, QUERIES
from . import queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
