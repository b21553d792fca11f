"""Booking report.

Every dataset behind a chart is a filter + projection + ``groupBy`` over
one scan. Date windows are compared as calendar days (D9), so the whole
end day is included, and the range predicates reach the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.codes import age_band, country_label, rvtype_label
from quarry.functions.dates import (PRESETS, month_name, month_ranges, preset_window,
                                    same_day_prior_year)
from quarry.functions.text import percent_label

DAY = dt.timedelta(days=1)


def _day(c: str) -> Column:
    return F.to_date(F.col(c))


def booking_range(df: DataFrame, start: dt.date, end: dt.date, lead_days: int = 0,
                  date_col: str = "booking_date") -> DataFrame:
    """Rows whose day is in ``[start - lead_days, end]``."""
    return df.filter(_day(date_col).between(F.lit(start - lead_days * DAY), F.lit(end)))


def period_summary(df: DataFrame, date_col: str = "booking_date",
                   value_col: str = "total_gmv") -> DataFrame:
    """Row count, first and last day, total value (one row)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.min(_day(date_col)).alias("first_day"),
                  F.max(_day(date_col)).alias("last_day"),
                  F.round(F.sum(value_col), 2).alias("total_gmv"))


def distinct_periods(df: DataFrame, date_col: str = "booking_date") -> DataFrame:
    """Distinct (year, month, month name) present."""
    day = _day(date_col)
    return df.select(F.year(day).alias("year"), F.month(day).alias("month"),
                     month_name(day).alias("month_name")).distinct()


def preset_totals(df: DataFrame, end: dt.date, presets: Iterable[str] = tuple(PRESETS),
                  date_col: str = "booking_date", value_col: str = "total_gmv") -> DataFrame:
    """F10 + A12 for many presets in ONE scan.

    Each preset becomes a pair of conditional aggregates over a single
    pass (the outer filter keeps only the widest window and is pushed to
    the scan); the one-row result is turned into one row per preset.
    """
    wins = [(p, *preset_window(p, end)) for p in presets]
    lo = min(s for _, s, _ in wins)
    day = _day(date_col)
    aggs = []
    for i, (_, s, e) in enumerate(wins):
        inside = day.between(F.lit(s), F.lit(e))
        aggs += [F.count_if(inside).alias(f"n{i}"),
                 F.sum(F.when(inside, F.col(value_col))).alias(f"g{i}")]
    wide = df.filter(day.between(F.lit(lo), F.lit(end))).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p).alias("preset"), F.lit(s).alias("start_date"),
                              F.lit(e).alias("end_date"), F.col(f"n{i}").alias("n_rows"),
                              F.round(F.coalesce(F.col(f"g{i}"), F.lit(0.0)), 2).alias("gmv"))
                     for i, (p, s, e) in enumerate(wins)])
    return wide.select(F.inline(rows))


def label_bookings(df: DataFrame, country_default: str = "OTHERS",
                   rvtype_default: str = "RV Cottage") -> DataFrame:
    """Country / vehicle labels and the age band as extra columns."""
    return df.withColumns({
        "country_label": country_label("country", country_default),
        "rvtype_label": rvtype_label("rvtype", rvtype_default),
        "age_band": age_band("user_age"),
    })


def distribution(df: DataFrame, col: str) -> DataFrame:
    """A10 + W1 + C24: count per category, share of all rows (2 decimals)
    and its ``12.35%`` label.

    The window over the aggregated rows has no partition key; its input
    is one row per category (bounded by the label map), not the data.
    """
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n").cast("double") * 100.0 / F.sum("n").over(Window.partitionBy()), 2)
    return g.withColumn("share", share).withColumn("share_label", percent_label("share"))


def metric_by_day(df: DataFrame, dim: str, value: str, how: str = "sum",
                  date_col: str = "booking_date", decimals: int = 2) -> DataFrame:
    """A11/A12 (D8): per (day, dimension) ``sum`` or ``avg`` of a metric
    plus the row count."""
    agg = {"sum": F.sum, "avg": F.avg}[how]
    return df.groupBy(_day(date_col).alias("booking_date"), F.col(dim)).agg(
        F.round(agg(value), decimals).alias(f"{how}_{value}"),
        F.count(F.lit(1)).alias("n_rows"))


def year_month_filter(df: DataFrame, years: Iterable[int] | None = None,
                      months: Iterable[int] | None = None,
                      date_col: str = "booking_date") -> DataFrame:
    """F11 (D11): keep the selected years and months; ``None`` = all. With
    years given the months are day ranges, which reach the scan."""
    day = _day(date_col)
    if years is not None:
        ranges = month_ranges(years, months)
        cond = F.lit(False)
        for first, end in ranges:
            cond = cond | ((day >= F.lit(first)) & (day < F.lit(end)))
        return df.filter(cond)
    return df if months is None else df.filter(F.month(day).isin(list(months)))


def prior_year_days(df: DataFrame, end: dt.date, date_col: str = "booking_date") -> DataFrame:
    """Rows on ``end`` or the same day one year earlier."""
    return df.filter(same_day_prior_year(date_col, end))


def booking_report(df: DataFrame, start: dt.date, end: dt.date, preset: str = "All Time",
                   years: Iterable[int] | None = None, months: Iterable[int] | None = None,
                   lead_days: int = 6, stage: bool = True) -> dict[str, DataFrame]:
    """All datasets of the report, each a lazy ``DataFrame``.

    Tab 1 uses ``[start - lead_days, end]``; tab 2 uses the preset window
    ending at ``end`` plus the optional year / month selection. With
    ``stage`` the two filtered, labelled windows are written once under the
    shared checkpoint folder, so the dozen datasets read those instead of
    rescanning the whole bookings table each.
    """
    tab1 = label_bookings(booking_range(df, start, end, lead_days))
    s2, e2 = preset_window(preset, end)
    tab2 = label_bookings(year_month_filter(booking_range(df, s2, e2), years, months))
    if stage:
        from quarry.sinks.tables import materialize
        tab1, tab2 = materialize(tab1, "booking-tab1"), materialize(tab2, "booking-tab2")
    out = {
        "summary": period_summary(tab1),
        "periods": distinct_periods(booking_range(tab1, start, end)),
        "presets": preset_totals(df, end),
        "country": distribution(tab1, "country_label"),
        "rvtype": distribution(tab1, "rvtype_label"),
        "age": distribution(tab1, "age_band"),
    }
    for dim in ("country_label", "rvtype_label", "age_band"):
        out[f"gmv_by_{dim}"] = metric_by_day(tab2, dim, "total_gmv", "sum")
        out[f"rate_by_{dim}"] = metric_by_day(tab2, dim, "payment_rate", "avg", decimals=4)
    return out
