"""Queries over the shared test tables, each with the SQL that must give the same rows."""

from . import cleaning, models, posterior, reports, scale, shapes, summaries, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
