from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import series

from .helpers import raw


def points(ts, vs, sensor="s"):
    return [{"sensor_id": sensor, "timestamp": t, "value": v} for t, v in zip(ts, vs)]


def averages(spark, rows, start, end, buckets):
    return [x["value"] for x in series.downsample(raw(spark, rows), None, start, end, buckets).collect()]


def test_downsampling(spark):
    assert averages(spark, points(range(100, 106), range(10, 70, 10)), 100, 106, 3) == [15, 35, 55]
    found = averages(spark, points(range(1000, 1100), range(100)), 1000, 1100, 10)
    assert len(found) == 10 and (found[0], found[-1]) == (4.5, 94.5)
    assert averages(spark, points((100, 150), (10, 20)), 100, 200, 10) == [10, 20]
    assert averages(spark, points((100,), (1,)), 100, 100, 3) == []


@pytest.mark.parametrize("start,end,buckets", [(100, 106, 3), (0, 7, 3), (0, 1000, 7), (5, 12, 50), (0, 399, 400), (10, 1000003, 400), (0, 86400, 371)])
def test_buckets_equal_their_bounds(spark, start, end, buckets):
    width = (end - start) / buckets
    bounds = [(start + int(i * width), start + int((i + 1) * width)) for i in range(buckets)]
    step = max(1, (end - start) // 3000)
    times = range(start - 2, end + 3, step)
    df = spark.createDataFrame([(t,) for t in times], "t bigint")
    low, high = series.bucket_span(start, end, buckets)
    assert (low, high) == (bounds[0][0], bounds[-1][1])
    bucket = F.when((df["t"] >= low) & (df["t"] < high), series.bucket_of(df["t"], start, end, buckets))
    for row in df.select("t", bucket.alias("b")).collect():
        wanted = next((i for i, (low, high) in enumerate(bounds) if low <= row["t"] < high), None)
        assert row["b"] == wanted, row


def test_bucket_limit(spark):
    assert len(averages(spark, points(range(1000), range(1000)), 0, 1000, 5000)) == 999  # a timestamp of 0 is none
    assert len(averages(spark, points(range(1000), range(1000)), 0, 1000, 0)) == 400


ROWS = points((300, 100, 200, 200, ""), ("3", "1C", "2", "2.5", "9")) + points((150,), ("x",)) + points((120, 500), (7, 8), "t")


def test_range(spark):
    r = raw(spark, ROWS)
    found = [tuple(x)[1:] for x in series.range_by_sensor(r, "s", 100, 200).collect()]
    assert found == [(100, 1.0), (200, 2.0), (200, 2.5)]
    with pytest.raises(ValueError):
        series.range_by_sensor(r, "s", 5, 5)
    many = series.range_by_sensor(r, spark.createDataFrame([("t",), ("zz",)], "id string"), 0, 1000)
    assert [tuple(x) for x in many.collect()] == [("t", 120, 7.0), ("t", 500, 8.0)]


def test_head_and_tail(spark):
    r = raw(spark, ROWS)
    assert [tuple(x)[1:] for x in series.tail_by_sensor(r, "s", 2).collect()] == [(200, 2.5), (300, 3.0)]
    assert [tuple(x)[1:] for x in series.head_by_sensor(r, ["s"], 2).collect()] == [(0, 9.0), (100, 1.0)]
    assert series.tail_by_sensor(r, None, 99).count() == 7
    untimed = raw(spark, [{"sensor_id": "u", "value": v} for v in (5, 6, 7)])
    assert [x["value"] for x in series.tail_by_sensor(untimed, "u", 2).collect()] == [6, 7]


def test_views(spark):
    r = raw(spark, ROWS)
    assert tuple(series.earliest_latest(r, ["s", "t"]).first()) == (100, 500)
    assert series.view_window("day", 100000) == (13600, 100000)
    found = series.multi_series_view(r, None, 100, 600, 5).collect()
    assert [(x["sensor_id"], x["bucket"], x["value"], x["min_value"], x["max_value"]) for x in found] == [
        ("s", 0, 1.0, 1.0, 3.0), ("s", 1, 2.25, 1.0, 3.0), ("s", 2, 3.0, 1.0, 3.0), ("t", 0, 7.0, 7.0, 8.0), ("t", 4, 8.0, 7.0, 8.0),
    ]
