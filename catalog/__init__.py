"""The query catalogue: each operator on the given tables, with an independent SQL statement of its result."""

from catalog import association, preparation, quality, sources, statistics, temporal, values  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
