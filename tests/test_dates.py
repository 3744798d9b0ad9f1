from __future__ import annotations

import calendar
import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import dates, numbers, text


def epoch(*parts):
    return calendar.timegm(dt.datetime(*parts).timetuple())


def evaluate(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [tuple(row)[1:] for row in df.select("i", *columns).orderBy("i").collect()]


CASES = [
    ("2026-01-17", epoch(2026, 1, 17), epoch(2026, 1, 17, 23, 59, 59)),
    ("2026-01-17T14:30:00", epoch(2026, 1, 17, 14, 30), epoch(2026, 1, 17, 14, 30)),
    ("17/01/2026", epoch(2026, 1, 17), epoch(2026, 1, 17, 23, 59, 59)),
    ("7/1/2026", epoch(2026, 1, 7), epoch(2026, 1, 7, 23, 59, 59)),
    ("2024-02-29", epoch(2024, 2, 29), epoch(2024, 2, 29, 23, 59, 59)),
    ("2024-01-15T10:00:00.123Z", epoch(2024, 1, 15, 10), epoch(2024, 1, 15, 10)),
    ("2024-01-15T10", epoch(2024, 1, 15, 10), epoch(2024, 1, 15, 10, 59, 59)),
    ("1737315600", 1737315600, 1737315600),
    ("-5", -5, -5),
    ("", None, None), ("abc", None, None), ("2026-13-01", None, None), ("2026-02-30", None, None), ("2023-02-29", None, None),
    ("1969-12-31", None, None), ("2101-01-01", None, None), ("32/01/2026", None, None), ("2026-01-17T24:00:00", None, None),
    ("2026-01-7", None, None), ("2026-01-17T14:75:00", None, None), ("2026-01-17Tx", epoch(2026, 1, 17), epoch(2026, 1, 17, 23, 59, 59)),
    ("2026-01-17T14:30:99", None, None), ("2026-01-17T1:2", epoch(2026, 1, 17, 1, 2), epoch(2026, 1, 17, 1, 2, 59)),
    ("99999999999999999999", None, None), ("12.5", None, None), ("2026-1-1", None, None),
]


def test_parse_date(spark):
    x = F.col("x")
    found = evaluate(spark, [c[0] for c in CASES], dates.parse_date(x).alias("a"), dates.parse_date_end_of_day(x).alias("b"))
    assert found == [(a, b) for _, a, b in CASES]


def test_bounds_are_read_like_columns():
    for value, start, end in CASES:
        if start is None and value:
            with pytest.raises(ValueError):
                dates.date_bound(value)
            continue
        assert dates.date_bound(value) == (start or 0), value
        assert dates.date_bound(value, end_of_day=True) == (end or 0), value
    assert dates.date_bound("2024-01-15 10:00:00", strict=True) == epoch(2024, 1, 15)
    assert dates.date_bound("2024-07-01", "America/New_York") == epoch(2024, 7, 1, 4)
    assert (dates.date_bound(None), dates.date_bound(5)) == (0, 5)


def test_blank_between_date_and_time(spark):
    x = F.col("x")
    found = evaluate(spark, ["2024-01-15 10:00:00"], dates.parse_date(x), dates.parse_date(x, strict=True))
    assert found == [(epoch(2024, 1, 15, 10), epoch(2024, 1, 15))]


def test_labels_do_not_depend_on_the_session_zone(spark):
    x = F.col("x").cast("bigint")
    columns = [label(x) for label in dates.PERIODS.values()] + [dates.epoch_text(x), dates.day_label(x, "America/New_York")]
    stamps = [epoch(2021, 1, 3), epoch(2024, 12, 30, 1), epoch(2024, 1, 1), 0, -1]
    wanted = [
        ("2021-01-03", "2020-W53", "2021-01", "2021", "2021-01-03 00:00:00", "2021-01-02"),
        ("2024-12-30", "2025-W01", "2024-12", "2024", "2024-12-30 01:00:00", "2024-12-29"),
        ("2024-01-01", "2024-W01", "2024-01", "2024", "2024-01-01 00:00:00", "2023-12-31"),
    ]
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = evaluate(spark, [str(s) for s in stamps], *columns)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert found[:3] == wanted
        assert {f[0] for f in found[3:]} == {"(no-date)"}


def test_iso_weeks(spark):
    days = [dt.datetime(y, m, d) for y in range(1999, 2033) for m, d in ((1, 1), (1, 3), (1, 4), (6, 15), (12, 28), (12, 29), (12, 31))]
    found = evaluate(spark, [str(calendar.timegm(d.timetuple())) for d in days], dates.week_label(F.col("x").cast("bigint")))
    assert [f[0] for f in found] == ["%04d-W%02d" % d.isocalendar()[:2] for d in days]


NUMBERS = [
    ("22.5", 22.5, 22.5), ("-127", -127.0, -127.0), ("+1.5e2", 150.0, 150.0), (" 5", 5.0, 5.0), ("5 ", None, 5.0), ("", None, None),
    ("22.5C", None, 22.5), ("abc", None, None), ("5d", None, 5.0), ("nan", None, None), ("inf", None, None), ("1e400", None, None),
    (".5", 0.5, 0.5), ("5.", 5.0, 5.0), ("5\n", None, 5.0), ("1e", None, 1.0),
]


def test_numbers(spark):
    x = F.col("x")
    found = evaluate(spark, [n[0] for n in NUMBERS], numbers.number(x), numbers.number_prefix(x))
    assert found == [(a, b) for _, a, b in NUMBERS]


@pytest.mark.parametrize("value,wanted", [
    ("1", "1"), ("-0.5e+3", "-0.5e+3"), ("01", '"01"'), ("1.", '"1."'), ("+1", '"+1"'), ("", "null"), ("null", "null"), ("true", "true"),
    ('say "hi"\n', '"say \\"hi\\"\\n"'), ("a/b\\c", '"a/b\\\\c"'), ("1\n", '"1\\n"'),
])
def test_json_scalar(spark, value, wanted):
    assert evaluate(spark, [value], text.json_scalar(F.col("x"))) == [(wanted,)]


def test_durations_and_trim(spark):
    seconds = F.col("x").cast("bigint")
    found = evaluate(spark, ["0", "59", "60", "3600", "86400", "93784"], text.duration_text(seconds))
    assert [f[0] for f in found] == ["0s", "59s", "1m 0s", "1h 0m 0s", "1d 0h 0m 0s", "1d 2h 3m 4s"]
    assert evaluate(spark, [" \t a b\r\n"], text.trim(F.col("x"))) == [("a b",)]
