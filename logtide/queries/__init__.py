"""Every operator as a query on the fixture tables, with the same query in SQL where SQL can say it."""

from __future__ import annotations

from logtide.queries import catalogue, copying, proving, purging, routing, streams  # noqa: F401
from logtide.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
