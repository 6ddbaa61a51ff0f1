"""Naming the value of an expression within an expression.

A column that is used twice is computed twice once Catalyst has merged the projections, and a chain of such columns grows
without bound. let() gives a value a name inside one expression instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
