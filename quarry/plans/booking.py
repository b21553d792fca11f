"""Booking-report queries on the test tables (q18-q31, q54).

Bookings = orders joined to customers (see ``fixtures.bookings``); tab 1
covers ``[BOOK_START - 6 days, BOOK_END]``, tab 2 the "Last 3 Months"
preset ending at ``BOOK_END``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry.functions.codes import AGE_BANDS, COUNTRY_LABELS, RVTYPE_LABELS
from quarry.functions.dates import preset_window
from quarry.operators.booking import (booking_range, distinct_periods, distribution,
                                      label_bookings, metric_by_day, period_summary,
                                      preset_totals, prior_year_days, year_month_filter)
from quarry.plans.fixtures import BOOK_END, BOOK_START, BOOKINGS_SQL, Tables, bookings, d
from quarry.plans.registry import query

LEAD = 6
TAB2_PRESET = "Last 3 Months"
YEARS = (1996, 1998)
MONTHS = (1, 2, 12)

COUNTRY_SQL = ("CASE country " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in COUNTRY_LABELS.items())
               + " ELSE 'OTHERS' END")
RVTYPE_SQL = ("coalesce(CASE rvtype " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in RVTYPE_LABELS.items())
              + " END, 'RV Cottage')")
AGE_SQL = (f"CASE WHEN user_age < 25 THEN '{AGE_BANDS[0]}' "
           f"WHEN user_age >= 25 AND user_age <= 40 THEN '{AGE_BANDS[1]}' "
           f"WHEN user_age > 40 THEN '{AGE_BANDS[2]}' ELSE '{AGE_BANDS[3]}' END")
LABELLED_SQL = f"""labelled AS (SELECT *, {COUNTRY_SQL} AS country_label, {RVTYPE_SQL} AS rvtype_label,
  {AGE_SQL} AS age_band FROM bookings)"""
TAB1_WHERE = f"booking_date BETWEEN CAST({d(BOOK_START)} - INTERVAL {LEAD} DAY AS DATE) AND {d(BOOK_END)}"
_S2 = f"CAST({d(BOOK_END)} - INTERVAL 3 MONTH AS DATE)"
TAB2_WHERE = f"booking_date BETWEEN {_S2} AND {d(BOOK_END)}"


def tab1(t: Tables):
    return label_bookings(booking_range(bookings(t), BOOK_START, BOOK_END, LEAD))


def tab2(t: Tables):
    s, e = preset_window(TAB2_PRESET, BOOK_END)
    return label_bookings(booking_range(bookings(t), s, e))


@query("q18_booking_range", f"""WITH {BOOKINGS_SQL}
SELECT count(*) AS n_rows, min(booking_date) AS first_day, max(booking_date) AS last_day,
       round(sum(total_gmv), 2) AS total_gmv
FROM bookings WHERE {TAB1_WHERE}""")
def q18(spark, root):
    return period_summary(booking_range(bookings(Tables(spark, root)), BOOK_START, BOOK_END, LEAD))


@query("q19_distinct_periods", f"""WITH {BOOKINGS_SQL}
SELECT DISTINCT CAST(year(booking_date) AS INTEGER) AS year, CAST(month(booking_date) AS INTEGER) AS month,
       monthname(booking_date) AS month_name
FROM bookings WHERE booking_date BETWEEN {d(BOOK_START)} AND {d(BOOK_END)}""")
def q19(spark, root):
    return distinct_periods(booking_range(bookings(Tables(spark, root)), BOOK_START, BOOK_END))


def _preset_sql():
    specs = [("Last Day", d(BOOK_END)),
             ("Last 7 Days", f"CAST({d(BOOK_END)} - INTERVAL 7 DAY AS DATE)"),
             ("Last 28 Days", f"CAST({d(BOOK_END)} - INTERVAL 28 DAY AS DATE)"),
             ("Last 3 Months", f"CAST({d(BOOK_END)} - INTERVAL 3 MONTH AS DATE)"),
             ("Last 6 Months", f"CAST({d(BOOK_END)} - INTERVAL 6 MONTH AS DATE)"),
             ("Last 1 Year", f"CAST({d(BOOK_END)} - INTERVAL 1 YEAR AS DATE)"),
             ("All Time", "DATE '2017-01-01'")]
    parts = [f"""SELECT '{p}' AS preset, {s} AS start_date, {d(BOOK_END)} AS end_date, count(*) AS n_rows,
  round(coalesce(sum(total_gmv), 0.0), 2) AS gmv FROM bookings
  WHERE booking_date BETWEEN {s} AND {d(BOOK_END)}""" for p, s in specs]
    return "\nUNION ALL\n".join(parts)


@query("q20_preset_totals", f"WITH {BOOKINGS_SQL}\n{_preset_sql()}")
def q20(spark, root):
    return preset_totals(bookings(Tables(spark, root)), BOOK_END)


def _dist_sql(col):
    return f"""WITH {BOOKINGS_SQL}, {LABELLED_SQL},
g AS (SELECT {col}, count(*) AS n FROM labelled WHERE {TAB1_WHERE} GROUP BY 1)
SELECT {col}, n, round(CAST(n AS DOUBLE) * 100.0 / sum(n) OVER (), 2) AS share,
       printf('%.2f%%', round(CAST(n AS DOUBLE) * 100.0 / sum(n) OVER (), 2)) AS share_label
FROM g"""


@query("q21_country_distribution", _dist_sql("country_label"))
def q21(spark, root):
    return distribution(tab1(Tables(spark, root)), "country_label")


@query("q22_vehicle_distribution", _dist_sql("rvtype_label"))
def q22(spark, root):
    return distribution(tab1(Tables(spark, root)), "rvtype_label")


@query("q23_age_band_distribution", _dist_sql("age_band"))
def q23(spark, root):
    return distribution(tab1(Tables(spark, root)), "age_band")


def _metric_sql(dim, value, how, decimals):
    return f"""WITH {BOOKINGS_SQL}, {LABELLED_SQL}
SELECT booking_date, {dim}, round({how}({value}), {decimals}) AS {how}_{value}, count(*) AS n_rows
FROM labelled WHERE {TAB2_WHERE} GROUP BY 1, 2"""


def _metric_query(name, dim, value, how, decimals):
    @query(name, _metric_sql(dim, value, how, decimals))
    def _q(spark, root):
        return metric_by_day(tab2(Tables(spark, root)), dim, value, how, decimals=decimals)
    return _q


_metric_query("q24_gmv_by_day_country", "country_label", "total_gmv", "sum", 2)
_metric_query("q25_gmv_by_day_vehicle", "rvtype_label", "total_gmv", "sum", 2)
_metric_query("q26_gmv_by_day_age", "age_band", "total_gmv", "sum", 2)
_metric_query("q27_rate_by_day_country", "country_label", "payment_rate", "avg", 4)
_metric_query("q28_rate_by_day_vehicle", "rvtype_label", "payment_rate", "avg", 4)
_metric_query("q29_rate_by_day_age", "age_band", "payment_rate", "avg", 4)


@query("q30_year_month_filter", f"""WITH {BOOKINGS_SQL}
SELECT CAST(year(booking_date) AS INTEGER) AS year, CAST(month(booking_date) AS INTEGER) AS month,
       count(*) AS n_rows, round(sum(total_gmv), 2) AS gmv
FROM bookings WHERE year(booking_date) IN {YEARS} AND month(booking_date) IN {MONTHS}
GROUP BY 1, 2""")
def q30(spark, root):
    df = year_month_filter(bookings(Tables(spark, root)), YEARS, MONTHS)
    day = F.col("booking_date")
    return df.groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("total_gmv"), 2).alias("gmv"))


@query("q31_prior_year_day", f"""WITH {BOOKINGS_SQL}
SELECT booking_date, count(*) AS n_rows, round(sum(total_gmv), 2) AS gmv FROM bookings
WHERE booking_date IN ({d(BOOK_END)}, CAST({d(BOOK_END)} - INTERVAL 1 YEAR AS DATE))
GROUP BY 1""")
def q31(spark, root):
    df = prior_year_days(bookings(Tables(spark, root)), BOOK_END)
    return df.groupBy("booking_date").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.round(F.sum("total_gmv"), 2).alias("gmv"))




# q54: the presets where "All Time" holds rows -------------------------------
LATE_END = dt.date(2020, 3, 31)
_LATE_SQL = _preset_sql().replace(d(BOOK_END), d(LATE_END)).replace("FROM bookings", "FROM late")


@query("q54_presets_all_time", f"""WITH {BOOKINGS_SQL},
late AS (SELECT * REPLACE (CAST(booking_date + INTERVAL 20 YEAR AS DATE) AS booking_date) FROM bookings)
{_LATE_SQL}""")
def q54(spark, root):
    b = bookings(Tables(spark, root))
    return preset_totals(b.withColumn("booking_date", F.add_months("booking_date", 240)), LATE_END)
