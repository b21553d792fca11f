"""Scalar helpers: safe arithmetic, dates and presets, labels, tokens."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions.codes import age_band, country_label, rvtype_label
from quarry.functions.dates import days_between, preset_window, shift_months
from quarry.functions.safe import safe_add, safe_divide
from quarry.functions.text import (WORD_PUNCT, base_name, percent_label, stem, token_count,
                                   truncate_tokens)


def test_safe_add_matches_int_parsing(spark):
    rows = [("1", "2"), (" 2 ", "3"), ("3.5", "1"), ("abc", "1"), ("", "1"), (None, "1"),
            ("9223372036854775807", "1")]
    df = spark.createDataFrame(rows, "x string, y string")
    got = [r.s for r in df.select(safe_add("x", "y").alias("s")).collect()]
    assert got == [3, 5, None, None, None, None, None]


def test_safe_divide_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r.q for r in df.select(safe_divide("a", "b").alias("q")).collect()] == [None, 1.5]


@pytest.mark.parametrize("end,preset,start", [
    (dt.date(2024, 5, 31), "Last 3 Months", dt.date(2024, 2, 29)),
    (dt.date(2024, 3, 31), "Last 6 Months", dt.date(2023, 9, 30)),
    (dt.date(2024, 2, 29), "Last 1 Year", dt.date(2023, 2, 28)),
    (dt.date(2024, 3, 10), "Last 7 Days", dt.date(2024, 3, 3)),
    (dt.date(2024, 3, 10), "Last Day", dt.date(2024, 3, 10)),
    (dt.date(2024, 3, 10), "All Time", dt.date(2017, 1, 1)),
])
def test_presets(end, preset, start):
    assert preset_window(preset, end) == (start, end)


def test_unknown_preset_is_an_error():
    with pytest.raises(ValueError):
        preset_window("Last Week", dt.date(2024, 1, 1))


def test_shift_months_agrees_with_spark(spark):
    days = [dt.date(2024, 3, 31), dt.date(2024, 5, 31), dt.date(2023, 12, 30), dt.date(2024, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for k in (-1, -3, -12, 1):
        got = [r.x for r in df.select(F.add_months("d", k).alias("x")).collect()]
        assert got == [shift_months(d, k) for d in days]


def test_days_between_counts_calendar_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))],
                               "a timestamp, b timestamp")
    assert df.select(days_between("a", "b").alias("n")).first().n == 1


def test_labels_and_bands(spark):
    df = spark.createDataFrame([(1, 0, 24), (2, 10, 25), (0, 11, 40), (None, 15, 41),
                                (5, 16, None), (2, None, 30)], "c int, r int, a int")
    got = df.select(country_label("c").alias("c"), rvtype_label("r").alias("r"),
                    age_band("a").alias("a")).collect()
    assert [tuple(x) for x in got] == [
        ("CANADA", "Fifth Wheel", "BELOW_25"), ("USA", "Travel Trailer", "MIDDLEAGE_25_40"),
        ("OTHERS", "Class C", "MIDDLEAGE_25_40"), ("OTHERS", "RV Cottage", "ABOVE_40"),
        ("OTHERS", "RV Cottage", "OTHERS"), ("USA", "RV Cottage", "MIDDLEAGE_25_40")]


def test_tokens_names_and_truncation(spark):
    df = spark.createDataFrame([("  def f(x):\n   return x+1 ", "a/b/c.tar.py")], "t string, p string")
    r = df.select(token_count("t").alias("ws"), token_count("t", WORD_PUNCT).alias("wp"),
                  truncate_tokens("t", 2).alias("head"), truncate_tokens("t", 10).alias("all"),
                  base_name("p").alias("b"), stem("p").alias("s"),
                  percent_label(F.lit(12.345)).alias("pct")).first()
    assert r.ws == 4 and r.wp == 10
    assert r.head == "  def f(x):" and r.all == "  def f(x):\n   return x+1 "
    assert r.b == "c.tar.py" and r.s == "c.tar"
    assert r.pct == "12.35%"
