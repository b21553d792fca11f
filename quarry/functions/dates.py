"""Date helpers.

Dates are always compared as calendar days (D9); the reference date of a
job is an explicit argument (D1), never the wall clock.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def days_between(start: str | Column, end: str | Column) -> Column:
    """``datediff('day', start, end)`` = calendar days from start to end.

    Spark's ``datediff`` takes (end, start). Both sides are reduced to
    dates first, so 23:00 -> 01:00 the next day counts as one day.
    """
    return F.datediff(F.to_date(col_(end)), F.to_date(col_(start)))


def shift_months(day: dt.date, months: int) -> dt.date:
    """Calendar-month offset that clamps to the month end (as a calendar
    ``DateOffset`` and Spark's ``add_months`` both do)."""
    m = day.month - 1 + months
    y = day.year + m // 12
    m = m % 12 + 1
    last = calendar.monthrange(y, m)[1]
    return dt.date(y, m, min(day.day, last))


# The date-filter presets of the booking report and the
# first day of its "All Time" window.
ALL_TIME_START = dt.date(2017, 1, 1)
# name: (days, months) back from the end, or None for the fixed start
PRESETS = {"Last Day": (0, 0), "Last 7 Days": (7, 0), "Last 28 Days": (28, 0), "Last 3 Months": (0, 3),
           "Last 6 Months": (0, 6), "Last 1 Year": (0, 12), "All Time": None}


def preset_window(preset: str, end: dt.date) -> tuple[dt.date, dt.date]:
    """named preset -> inclusive ``(start, end)``.

    Both ends are inclusive, so "Last 7 Days" covers 8 calendar days (D10).
    An unknown preset is an error.
    """
    if preset not in PRESETS:
        raise ValueError(f"invalid date filter: {preset!r}")
    back = PRESETS[preset]
    if back is None:
        return ALL_TIME_START, end
    days, months = back
    return shift_months(end, -months) - dt.timedelta(days=days), end


def month_name(c: str | Column) -> Column:
    """Full English month name (``March``); ``monthname`` gives ``Mar``."""
    return F.date_format(col_(c), "MMMM")


def parse_day_or_null(c: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Parse text to a date; malformed input gives NULL, not an error."""
    return F.to_date(F.try_to_timestamp(col_(c), F.lit(fmt)))


def same_day_prior_year(day_col: str | Column, end: dt.date) -> Column:
    """The day is ``end`` or the same day one year before; two half-open
    day ranges, which reach the scan."""
    day, next_day = F.to_date(col_(day_col)), dt.timedelta(days=1)
    in_day = lambda d: (day >= F.lit(d)) & (day < F.lit(d + next_day))
    return in_day(shift_months(end, -12)) | in_day(end)


def month_ranges(years: Iterable[int], months: Iterable[int] | None) -> list[tuple[dt.date, dt.date]]:
    """The half-open day ranges of the chosen months of the chosen years, in
    order, neighbours joined."""
    firsts = [dt.date(y, m, 1) for y in sorted(set(years)) for m in sorted(set(months or range(1, 13))) if 1 <= m <= 12]
    out: list[tuple[dt.date, dt.date]] = []
    for first in firsts:
        end = shift_months(first, 1)
        if out and out[-1][1] == first:
            out[-1] = (out[-1][0], end)
        else:
            out.append((first, end))
    return out
