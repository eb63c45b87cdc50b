"""Registered queries over the given tables, and the same as SQL."""

from varloom.plans import comparisons, labels, links, profiles, records, sampling, statistics  # noqa: F401  they register
from varloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
