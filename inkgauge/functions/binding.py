"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Used where the body reads the value repeatedly or from inside a lambda: there Spark would compute
    the expression again for every read, or for every array entry.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
