"""Counting, distinct values and the latest reading per sensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import PERIODS, epoch_text
from ..model import MISSING, Readings


def count(r: Readings) -> DataFrame:
    return r.df.agg(F.count(F.lit(1)).alias("count"))


def _group(r: Readings, name: str) -> Column:
    return F.coalesce(r.field(name), F.lit(MISSING)).alias(name)


def count_by(r: Readings, *fields: str, period: str | None = None, ordered: bool = True) -> DataFrame:
    """Readings per combination of field texts and, if given, calendar ``period``.

    A missing field counts as ``(missing)``, an empty one as itself.  Largest counts first; a period alone is
    listed in time order.
    """
    if not fields and period is None:
        raise ValueError("name at least one field or a period")
    rows = [_group(r, name) for name in fields]
    groups = [F.col(f"`{name}`") for name in fields]
    names = list(fields)
    if period is not None:
        # As a column of its own, so that the text of a timestamp is parsed once.
        rows.append(r.timestamp().alias("_epoch"))
        groups.append(PERIODS[period](F.col("_epoch"), r.tz).alias(period))
        names.append(period)
    counts = r.df.select(*rows).groupBy(*groups).agg(F.count(F.lit(1)).alias("count"))
    if not ordered:
        return counts
    return counts.orderBy(*([F.desc("count")] if fields else []), *names)


def count_by_period(r: Readings, period: str, ordered: bool = True) -> DataFrame:
    return count_by(r, period=period, ordered=ordered)


def distinct(r: Readings, field: str, ordered: bool = True) -> DataFrame:
    """Non-empty distinct texts of a field, ascending."""
    values = r.df.select(r.field(field).alias(field)).where(F.col(f"`{field}`") != "").distinct()
    return values.orderBy(field) if ordered else values


def distinct_counts(r: Readings, field: str, ordered: bool = True) -> DataFrame:
    values = r.df.select(r.field(field).alias(field)).where(F.col(f"`{field}`") != "")
    counts = values.groupBy(field).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), field) if ordered else counts


def latest(r: Readings, limit: int = 0, ordered: bool = True) -> DataFrame:
    """Last timestamp per non-empty ``sensor_id``, ascending by id.

    ``limit`` > 0 keeps the first ids, < 0 the last ones (still ascending), 0 all.
    """
    rows = r.df.select(r.field("sensor_id").alias("sensor_id"), r.timestamp().alias("timestamp"))
    rows = rows.where((F.col("sensor_id") != "") & (F.col("timestamp") > 0))
    found = rows.groupBy("sensor_id").agg(F.max("timestamp").alias("timestamp"))
    if limit > 0:
        found = found.orderBy("sensor_id").limit(limit)
    elif limit < 0:
        found = found.orderBy(F.desc("sensor_id")).limit(-limit)
    result = found.select("sensor_id", "timestamp", epoch_text(F.col("timestamp"), r.tz).alias("iso_date"))
    return result.orderBy("sensor_id") if ordered or limit else result
