"""Named queries over the test tables, each with the SQL that must give the same rows."""

from dqloom.catalog.registry import oracles, queries

__all__ = ["oracles", "queries"]
