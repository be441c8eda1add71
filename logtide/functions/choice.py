"""Ordered choices."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F


def first_of(steps: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first test that holds, in one CASE."""
    case = None
    for test, value in steps:
        case = F.when(test, value) if case is None else case.when(test, value)
    return otherwise if case is None else case.otherwise(otherwise)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
