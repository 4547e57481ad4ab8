"""Small helpers of the tests."""

from __future__ import annotations

import datetime as dt


def day(n: int) -> dt.datetime:
    return dt.datetime(2024, 1, n)


def column(matrix, name: str) -> list:
    """A matrix's column in the order of its first."""
    return [r[name] for r in matrix.orderBy(matrix.columns[0]).collect()]
