"""Importing this package registers every query."""

from rosterlab.catalog import files, identity, jobs, lineups, models, pool, scalars, search  # noqa: F401
from rosterlab.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
