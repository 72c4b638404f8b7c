"""Evaluate an expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a lambda variable that holds ``value``.

    Spark does not share common sub-expressions inside lambdas: a split or regex mentioned in one would run
    again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
