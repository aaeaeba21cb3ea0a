"""Registered queries: each operator on whole given tables, with the SQL it must agree with."""

from . import aggregates, detection, evaluation, neighbourhood, series, sources, tables  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
