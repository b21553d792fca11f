"""Safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int_or_null(c: str | Column) -> Column:
    """Integer parse where bad input is NULL: surrounding blanks are
    accepted; ``"3.5"``, ``""`` and words give NULL."""
    return col_(c).try_cast("bigint")


def safe_add(x: str | Column, y: str | Column) -> Column:
    """``int(x) + int(y)``, NULL when either side is not an integer
    or the sum overflows."""
    return F.try_add(to_int_or_null(x), to_int_or_null(y))


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """``a / b`` as double, NULL for a zero divisor (plain ``/`` raises
    under ANSI mode)."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))
