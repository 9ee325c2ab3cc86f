"""Registered queries over the test tables, each next to the SQL it must agree with."""

from . import adaptation, checks, knowledge, lifecycle, profiles, scalars, sources, streams, suggestions  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
