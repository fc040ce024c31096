"""All queries of the library by name, and their SQL."""

from . import aggregates, calendar, dedup, evaluation, experiments, gates, landing, models, series, streams, text, windows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
