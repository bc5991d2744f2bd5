"""Queries that bind the operators to the driver's tables, and SQL for each."""

from . import evidence, extra, search  # noqa: F401  (add their queries and SQL)
