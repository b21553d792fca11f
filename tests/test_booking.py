"""Booking report edges: day boundaries, lead-in, presets, labels, shares."""

import datetime as dt

from quarry.operators.booking import (booking_range, booking_report, distribution,
                                      label_bookings, preset_totals)

START, END = dt.date(2024, 3, 10), dt.date(2024, 3, 31)


def bookings(spark):
    ts = [dt.datetime(2024, 3, 31, 23, 59), dt.datetime(2024, 3, 31, 0, 0),
          dt.datetime(2024, 3, 4, 0, 0), dt.datetime(2024, 3, 3, 23, 59),
          dt.datetime(2024, 3, 10, 12, 0), dt.datetime(2024, 4, 1, 0, 0),
          dt.datetime(2023, 12, 31, 8, 0), dt.datetime(2024, 2, 29, 9, 0)]
    rows = [(i, t, c, r, a, 100.0 * (i + 1), float(i % 2)) for i, (t, c, r, a) in enumerate(zip(
        ts, [1, 2, 0, None, 1, 2, 1, 2], [0, 10, 11, 15, 16, None, 3, 4], [24, 25, 40, 41, None, 30, 50, 20]))]
    return spark.createDataFrame(rows, "booking_id long, booking_date timestamp, country int, rvtype int, "
                                       "user_age int, total_gmv double, payment_rate double")


def test_range_includes_whole_end_day_and_six_day_lead(spark):
    got = sorted(r.booking_id for r in booking_range(bookings(spark), START, END, 6).collect())
    # 23:59 on the end day kept; start-6 (03-04) kept; start-7 (03-03 23:59) and 04-01 dropped
    assert got == [0, 1, 2, 4]


def test_presets_in_one_scan(spark):
    p = {r.preset: (r.start_date, r.n_rows) for r in preset_totals(bookings(spark), END).collect()}
    assert p["Last Day"] == (END, 2)
    assert p["Last 7 Days"] == (dt.date(2024, 3, 24), 2)
    assert p["Last 1 Year"] == (dt.date(2023, 3, 31), 7)
    assert p["Last 3 Months"] == (dt.date(2023, 12, 31), 7)


def test_distribution_labels_and_shares(spark):
    lab = label_bookings(bookings(spark))
    d = {r.age_band: (r.n, r.share, r.share_label) for r in distribution(lab, "age_band").collect()}
    assert d["BELOW_25"] == (2, 25.0, "25.00%") and d["OTHERS"] == (1, 12.5, "12.50%")
    assert sum(v[1] for v in d.values()) == 100.0
    rv = {r.rvtype_label for r in lab.collect()}
    assert {"Fifth Wheel", "Travel Trailer", "Class C", "RV Cottage"} <= rv


def test_report_has_every_dataset(spark):
    rep = booking_report(bookings(spark), START, END, preset="Last 28 Days", years=[2024], months=[3])
    assert {"summary", "periods", "presets", "country", "rvtype", "age"} <= set(rep)
    assert rep["summary"].first().n_rows == 4
    assert all(df.columns for df in rep.values())


def test_staged_and_unstaged_reports_agree(spark):
    a = booking_report(bookings(spark), START, END, preset="Last 3 Months", stage=True)
    b = booking_report(bookings(spark), START, END, preset="Last 3 Months", stage=False)
    for k in a:
        assert sorted(map(tuple, a[k].collect())) == sorted(map(tuple, b[k].collect())), k
