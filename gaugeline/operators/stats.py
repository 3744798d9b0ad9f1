"""Descriptive statistics of numeric fields, over everything or per group.

Every part returns one row per ``by`` group and ``column``; :func:`stats` joins the parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..functions.dates import epoch_text
from ..functions.text import duration_text
from ..model import MISSING, Readings
from ..session import fresh_path, written
from .ordered import change_summary, with_previous
from .quantiles import folded, quantiles, with_quantiles
from .skew import GROUP_ROWS

ALL = "all"
QUARTILES = (0.25, 0.5, 0.75)
GAP_FACTOR = 3
FENCE_FACTOR = 1.5

# A slice of a time line covers 2**TIME_BITS seconds, so it holds at most that many distinct timestamps.
TIME_BITS = 17


def numeric_columns(r: Readings) -> list[str]:
    """Fields of a typed frame that can hold numbers."""
    kinds = (T.NumericType, T.StringType)
    return sorted(c for c in r.columns if isinstance(r.type_of(c), kinds))


def measurements(r: Readings, columns: Sequence[str] | str = ("value",), by: Sequence[str] = ()) -> DataFrame:
    """Long form: ``by`` fields, ``column``, ``measure DOUBLE`` and the order columns; numbers only."""
    groups = [F.coalesce(r.field(c), F.lit(MISSING)).alias(c) for c in by]
    order = list(r.order)
    if columns == ALL and r.is_raw:
        pairs = r.df.select(*groups, *order, F.explode("fields").alias("column", "_text"))
        rows = pairs.select(*by, "column", numbers.number(F.col("_text")).alias("measure"), *order)
    else:
        names = numeric_columns(r) if columns == ALL else ([columns] if isinstance(columns, str) else list(columns))
        if len(names) == 1:
            rows = r.df.select(*groups, r.number(names[0]).alias("measure"), *order)
            # Not a literal: a constant key would turn the joins on it into nested loops.
            column = F.when(F.col("measure").isNotNull(), F.lit(names[0])).alias("column")
            rows = rows.select(*by, column, "measure", *order)
        else:
            pairs = [F.struct(F.lit(n).alias("column"), r.number(n).alias("measure")) for n in names]
            rows = r.df.select(*groups, *order, F.explode(F.array(*pairs)).alias("_m"))
            rows = rows.select(*by, "_m.column", "_m.measure", *order)
    return rows.where(F.col("measure").isNotNull())


def _keys(by: Sequence[str]) -> list[str]:
    return [*by, "column"]


def _basic(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    low, high = F.min("measure"), F.max("measure")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), low.alias("min"), high.alias("max"), (high - low).alias("range"),
        F.avg("measure").alias("mean"), F.coalesce(F.stddev_samp("measure"), F.lit(0.0)).alias("stddev"),
    )


def basic(r: Readings, columns: Sequence[str] | str = ("value",), by: Sequence[str] = ()) -> DataFrame:
    """``count, min, max, range, mean, stddev`` (sample deviation, 0 for a single value)."""
    return _basic(measurements(r, columns, by), _keys(by))


def quartiles(
    r: Readings, columns: Sequence[str] | str = ("value",), by: Sequence[str] = (), ranges: int | None = None,
    approximate: bool = False,
) -> DataFrame:
    """``q1, median, q3, iqr``; ``approximate`` takes them from a sketch in a single pass."""
    found = quantiles(measurements(r, columns, by), _keys(by), "measure", QUARTILES, ranges, approximate)
    q = F.col("quantiles")
    return found.select(
        *_keys(by), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr")
    )


def fences_of(counted: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Quartiles and outliers of folded values (``measure, _c``).

    Every distinct value knows the size and the quartiles of its group, so a sum counts it.
    """
    placed = with_quantiles(counted, keys, "measure", QUARTILES, ranges)
    v, q1, median, q3 = (F.col(c) for c in ("measure", "_q0", "_q1", "_q2"))
    reach = (q3 - q1) * FENCE_FACTOR
    outside = (v < q1 - reach) | (v > q3 + reach)
    number = F.coalesce(F.sum(F.when(outside, F.col("_c"))), F.lit(0).cast("bigint"))
    return placed.groupBy(*keys).agg(
        F.max(q1).alias("q1"), F.max(median).alias("median"), F.max(q3).alias("q3"), (F.max(q3) - F.max(q1)).alias("iqr"),
        number.alias("outliers"), (F.lit(100.0) * number / F.max("_n")).alias("outlier_percent"),
    )


def _fenced(rows: DataFrame, keys: Sequence[str], ranges: int | None) -> DataFrame:
    return fences_of(folded(rows, keys, "measure"), keys, ranges)


def summary_of(counted: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """What :func:`value_summary` gives, of folded values (``measure, _c``)."""
    v, c = F.col("measure"), F.col("_c")
    low, high = F.min(v), F.max(v)
    base = counted.groupBy(*keys).agg(
        F.sum(c).alias("count"), low.alias("min"), high.alias("max"), (high - low).alias("range"), (F.sum(c * v) / F.sum(c)).alias("mean"))
    off = v - F.col("mean")
    n = F.col("count")
    spread = counted.join(base.select(*keys, "mean"), list(keys)).groupBy(*keys).agg(F.sum(c * off * off).alias("_spread"))
    stddev = F.when(n > 1, F.sqrt(F.col("_spread") / (n - 1))).otherwise(F.lit(0.0)).alias("stddev")
    whole = base.join(spread, list(keys)).select(*keys, "count", "min", "max", "range", "mean", stddev)
    return whole.join(fences_of(counted, keys, ranges), list(keys))


def outliers(
    r: Readings, columns: Sequence[str] | str = ("value",), by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """``outliers, outlier_percent``: values strictly outside ``q1 - 1.5 iqr .. q3 + 1.5 iqr``."""
    keys = _keys(by)
    return _fenced(measurements(r, columns, by), keys, ranges).select(*keys, "outliers", "outlier_percent")


def value_summary(
    r: Readings, columns: Sequence[str] | str = ("value",), by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """What :func:`basic`, :func:`quartiles` and :func:`outliers` give; text is parsed once and its folded values are stored."""
    keys = _keys(by)
    rows = measurements(r, columns, by).select(*keys, "measure")
    if r.is_raw and not r.df.isStreaming:
        spark = r.df.sparkSession
        return summary_of(written(folded(rows, keys, "measure"), fresh_path(spark, "folded")), keys, ranges)
    return _basic(rows, keys).join(_fenced(rows, keys, ranges), keys)


def changes(
    r: Readings, columns: Sequence[str] | str = ("value",), by: Sequence[str] = (), order: str = "arrival",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Consecutive absolute changes: ``n_changes, change_min/max/mean, volatility, jump_size/from/to``.

    ``order`` is ``arrival`` or ``timestamp`` (ties by arrival; readings without a timestamp come first).
    """
    keys = _keys(by)
    if order == "arrival":
        rows = measurements(r, columns, by)
        return change_summary(rows, keys, "measure", r.order, r.arrival_levels(), limit, always=not by)
    if order != "timestamp":
        raise ValueError(f"unknown order {order!r}")
    timed = r.with_df(r.df.withColumn("_ts", F.coalesce(r.timestamp(), F.lit(0).cast("bigint"))))
    timed = replace(timed, order=("_ts", *r.order))
    rows = measurements(timed, columns, by)
    at = F.col("_ts")
    levels = [[F.shiftright(at, TIME_BITS)], *[[at, *level] for level in r.arrival_levels()]]
    return change_summary(rows, keys, "measure", timed.order, levels, limit, always=not by)


def moment(r: Readings) -> Column:
    """The timestamp that counts in time statistics."""
    return r.number("timestamp").cast("bigint") if r.strict else r.timestamp()


def _timestamps(r: Readings, by: Sequence[str]) -> DataFrame:
    groups = [F.coalesce(r.field(c), F.lit(MISSING)).alias(c) for c in by]
    return r.df.select(*groups, moment(r).alias("ts")).where(F.col("ts").isNotNull())


def time_range(r: Readings, by: Sequence[str] = ()) -> DataFrame:
    """First and last timestamp, duration and reading rate (NULL when the duration is 0)."""
    spans = _timestamps(r, by).groupBy(*by).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n_timestamps")
    ).where(F.col("n_timestamps") > 0)
    length = F.col("last") - F.col("first")

    def rate(unit: int) -> Column:
        return F.when(F.col("duration") > 0, F.col("n_timestamps") / (F.col("duration") / F.lit(float(unit))))

    return spans.withColumn("duration", length).select(
        *by, "first", "last", epoch_text(F.col("first"), r.tz).alias("first_text"),
        epoch_text(F.col("last"), r.tz).alias("last_text"), "duration",
        duration_text(F.col("duration")).alias("duration_text"), "n_timestamps",
        rate(3600).alias("per_hour"), rate(86400).alias("per_day"),
    )


def intervals(r: Readings, by: Sequence[str] = (), limit: int = GROUP_ROWS) -> DataFrame:
    """Histogram of the gaps between neighbouring timestamps: ``by, seconds, n``.

    Equal timestamps are folded first, so a slice of the time line has a bounded number of rows.
    """
    return intervals_of(_timestamps(r, by), by, limit)


def intervals_of(times: DataFrame, by: Sequence[str] = (), limit: int = GROUP_ROWS) -> DataFrame:
    """The same of rows ``by, ts``."""
    stamps = times.groupBy(*by, "ts").agg(F.count(F.lit(1)).alias("copies"))
    steps = with_previous(stamps, by, ["ts"], [[F.shiftright("ts", TIME_BITS)]], ["ts"], limit)
    zero = F.lit(0).cast("bigint")
    step = F.struct((F.col("ts") - F.col("previous.ts")).alias("seconds"), F.lit(1).cast("bigint").alias("n"))
    same = F.struct(zero.alias("seconds"), (F.col("copies") - 1).alias("n"))
    pairs = steps.select(*by, F.explode(F.array(step, same)).alias("_i")).select(*by, "_i.seconds", "_i.n")
    pairs = pairs.where(F.col("seconds").isNotNull() & (F.col("n") > 0))
    return pairs.groupBy(*by, "seconds").agg(F.sum("n").alias("n"))


def sampling_of(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``typical_interval`` (upper median), ``gaps`` (strictly more than 3 times that) and ``max_gap`` of a histogram of gaps.

    The windows see one row per distinct interval.  These add up to the length of the time line, so a group of
    k distinct intervals spans at least k * k / 2 seconds, which bounds k.
    """
    group = Window.partitionBy(*by)
    upto = group.orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(group))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("seconds"))).over(group)
    ranked = ranked.withColumn("typical_interval", middle)
    gap = F.col("seconds") > F.col("typical_interval") * GAP_FACTOR
    return ranked.groupBy(*by, "typical_interval").agg(
        F.coalesce(F.sum(F.when(gap, F.col("n"))), F.lit(0)).alias("gaps"),
        F.max(F.when(gap, F.col("seconds"))).alias("max_gap"),
    )


def sampling(r: Readings, by: Sequence[str] = (), limit: int = GROUP_ROWS) -> DataFrame:
    """What :func:`sampling_of` tells of the gaps between neighbouring timestamps."""
    return sampling_of(intervals(r, by, limit), by)


def stats(
    r: Readings, columns: Sequence[str] | str = ("value",), by: Sequence[str] = (), order: str = "arrival",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """All value statistics in one row per group and column; no rows when there are no numbers.

    The time line is reported by :func:`time_range` and :func:`sampling`.
    """
    return value_summary(r, columns, by).join(changes(r, columns, by, order, limit), _keys(by), "left")
