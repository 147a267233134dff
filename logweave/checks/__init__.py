"""Queries that run every operator over the test tables, with equivalent SQL where there is one."""

from logweave.checks import changes, filters, io, lookups, parsing, streams  # noqa: F401
from logweave.checks.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
