"""Time series of sensors: range, head, tail, downsampling and the frame of a plot."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Readings
from .lookup import keep_in
from .ordered import first_n

BUCKETS = 400

# Lengths of the plot windows in seconds.
VIEWS = {"hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}

Ids = str | Sequence[str] | DataFrame | None


def _of_sensors(r: Readings, ids: Ids) -> DataFrame:
    if ids is None:
        return r.df.where(r.field("sensor_id").isNotNull())
    if isinstance(ids, DataFrame):
        return keep_in(r.df, r.field("sensor_id"), ids)
    wanted = [ids] if isinstance(ids, str) else list(ids)
    return r.df.where(r.equals_any("sensor_id", wanted))


def series(r: Readings, ids: Ids = None, keep: Sequence[str] = ()) -> DataFrame:
    """``sensor_id, timestamp (0 when absent), value`` of readings whose value starts with a number."""
    value = r.number_prefix("value")
    at = F.coalesce(r.timestamp(), F.lit(0).cast("bigint"))
    rows = _of_sensors(r, ids).select(
        r.field("sensor_id").alias("sensor_id"), at.alias("timestamp"), value.alias("value"), *keep
    )
    return rows.where(F.col("value").isNotNull())


def range_by_sensor(r: Readings, ids: Ids, start: int, end: int, ordered: bool = True) -> DataFrame:
    """Points with ``start <= timestamp <= end``, oldest first."""
    if start >= end:
        raise ValueError("start must be before end")
    # The second test is for bounds of 0 and less, which the first one takes for open.
    within = r.with_df(r.df.where(r.timestamp_between(start, end) & r.timestamp().between(start, end)))
    found = series(within, ids, r.order)
    if ordered:
        found = found.orderBy("sensor_id", "timestamp", *r.order)
    return found.select("sensor_id", "timestamp", "value")


def _end_of_series(r: Readings, ids: Ids, n: int, last: bool) -> DataFrame:
    direction = (lambda c: F.col(c).desc()) if last else (lambda c: F.col(c).asc())
    rows = series(r, ids, r.order)
    found = first_n(rows, ["sensor_id"], [direction(c) for c in ("timestamp", *r.order)], n)
    return found.orderBy("sensor_id", "timestamp", *r.order).select("sensor_id", "timestamp", "value")


def tail_by_sensor(r: Readings, ids: Ids, n: int) -> DataFrame:
    """The last n points per sensor, oldest first; ties (and series without times) by arrival."""
    return _end_of_series(r, ids, n, last=True)


def head_by_sensor(r: Readings, ids: Ids, n: int) -> DataFrame:
    """The first n points per sensor; points without a timestamp come first."""
    return _end_of_series(r, ids, n, last=False)


def earliest_latest(r: Readings, ids: Ids = None) -> DataFrame:
    """Smallest and largest timestamp of the sensors' points."""
    points = series(r, ids).where(F.col("timestamp") > 0)
    return points.agg(F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))


def bucket_start(index: Column, start: int, end: int, buckets: int) -> Column:
    return F.lit(start) + F.floor(index * F.lit((end - start) / buckets))


def bucket_of(timestamp: Column, start: int, end: int, buckets: int) -> Column:
    """Index of the bucket ``[start + floor(i w), start + floor((i + 1) w))`` for a timestamp inside of one.

    The index is computed, so no table of buckets has to be joined; a neighbour is taken where rounding of the
    division and of the bounds disagree.
    """
    width = (end - start) / buckets
    guess = F.ceil((timestamp - start + 1) / F.lit(width)) - 1
    low, high = bucket_start(guess, start, end, buckets), bucket_start(guess + 1, start, end, buckets)
    return (guess + F.when(timestamp < low, -1).when(timestamp >= high, 1).otherwise(0)).cast("int")


def bucket_span(start: int, end: int, buckets: int) -> tuple[int, int]:
    """First timestamp of the first bucket and the one after the last bucket."""
    return start, start + math.floor(buckets * ((end - start) / buckets))


def downsample(
    r: Readings, ids: Ids, start: int, end: int, buckets: int = BUCKETS, ordered: bool = True
) -> DataFrame:
    """Mean value per sensor and time bucket; empty buckets are left out.

    Any positive number of buckets; without one there are 400.  A window that ends before it starts has none.
    """
    if buckets <= 0:
        buckets = BUCKETS
    low, high = bucket_span(start, max(start, end), buckets)
    within = r.with_df(r.df.where(r.timestamp_between(low, high)))
    points = series(within, ids).where((F.col("timestamp") >= low) & (F.col("timestamp") < high))
    if start >= end:
        indexed = points.limit(0).withColumn("bucket", F.lit(0)).withColumn("bucket_start", F.col("timestamp"))
        return indexed.select("sensor_id", "bucket", "bucket_start", "value")
    bucket = bucket_of(F.col("timestamp"), start, end, buckets).alias("bucket")
    means = points.groupBy("sensor_id", bucket).agg(F.avg("value").alias("value"))
    found = means.select(
        "sensor_id", "bucket", bucket_start(F.col("bucket"), start, end, buckets).alias("bucket_start"), "value"
    )
    return found.orderBy("sensor_id", "bucket") if ordered else found


def view_window(mode: str, end: int) -> tuple[int, int]:
    """Start and end of the plot window of that length which ends at ``end``."""
    return end - VIEWS[mode], end


def multi_series_view(
    r: Readings, ids: Ids, start: int, end: int, buckets: int = BUCKETS, ordered: bool = True
) -> DataFrame:
    """Downsampled series over one window, each with its own scale ``min_value, max_value``."""
    points = downsample(r, ids, start, end, buckets, ordered=False)
    sensor = Window.partitionBy("sensor_id")
    scaled = points.withColumn("min_value", F.min("value").over(sensor)).withColumn("max_value", F.max("value").over(sensor))
    return scaled.orderBy("sensor_id", "bucket") if ordered else scaled
