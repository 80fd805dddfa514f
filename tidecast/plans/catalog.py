"""Imports every plan module, so that the registry is complete."""

from tidecast.plans import aggregates, decisions, models, screening, streams, tables  # noqa: F401
from tidecast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
