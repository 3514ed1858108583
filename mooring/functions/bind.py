"""Binding a value in a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    A Column is an expression, not a value: used twice it is computed twice, and
    nested array functions multiply that. A lambda over a one-element array binds it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
