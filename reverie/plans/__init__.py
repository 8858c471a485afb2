"""Named queries of the memory store."""

from reverie.plans import browsing, counting, flowing, keeping, ranking  # noqa: F401
from reverie.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
