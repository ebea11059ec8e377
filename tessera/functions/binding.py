"""Naming the value of an expression inside an expression, so that it is computed once and optimiser rules do not copy it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value)."""
    return F.element_at(F.transform(F.array(value), body), 1)
