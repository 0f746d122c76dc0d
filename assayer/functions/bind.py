"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(value: Column) -> Column:
    """A generator of the value where it is not null, else of no row.

    Spark moves a filter on a computed column down to the table's scan and computes
    the column there too; nothing of a generator is computed twice.
    """
    return F.explode(F.array_compact(F.array(value)))
