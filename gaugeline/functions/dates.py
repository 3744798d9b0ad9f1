"""Dates and epochs.

All arithmetic is done on epoch seconds and on DATE values, so that no result depends on the session
time zone: the zone is an argument (``tz``, default UTC).
"""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC = "UTC"
NO_DATE = "(no-date)"
DAY_SECONDS = 86400
START_OF_DAY = (0, 0, 0)
END_OF_DAY = (23, 59, 59)

# The layouts that are read, with years from 1970 to 2100.
YEAR = r"(19[7-9]\d|20\d\d|2100)"
SLASH_DATE = r"(?s)^\s*0*(\d{1,2})/\s*0*(\d{1,2})/\s*0*" + YEAR + r"(?!\d).*"
DASH_DATE = r"(?s)^(?=.{10})" + YEAR + r"-(\d\d)-\s*0*(\d{1,2})(?!\d).*"
EPOCH = r"^-?\d+\z"
# A clock follows a T or, unless strict, a blank.  Its later parts may be missing.
MARK = r"^(?:[^T]*T|\S+ +(?=\d))"
STRICT_MARK = r"^[^T]*T"
CLOCK = r"\s*0*([01]?\d|2[0-3])(?!\d)(?::\s*0*([0-5]?\d)(?!\d)(?::\s*0*([0-5]?\d)(?!\d))?)?(?!:\s*\d)"
ANY_CLOCK = r"\s*\d"


def wall_to_epoch(seconds: Column, tz: str) -> Column:
    """Epoch seconds of a wall clock reading (given as seconds since 1970 on that clock) in ``tz``."""
    if tz == UTC:
        return seconds
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(seconds), tz))


def epoch_to_wall(seconds: Column, tz: str) -> Column:
    """Wall clock seconds shown in ``tz`` at an epoch."""
    if tz == UTC:
        return seconds
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), tz))


def parse_date(text: Column, tz: str = UTC, end_of_day: bool = False, strict: bool = False) -> Column:
    """Epoch seconds of ``d/m/Y``, ``Y-m-d``, ``Y-m-dTH:M:S`` or epoch text; NULL when unreadable.

    ``end_of_day`` gives 23:59:59 to texts without a clock part.  A blank may stand in for the ``T``
    unless ``strict``.
    """
    defaults = END_OF_DAY if end_of_day else START_OF_DAY
    default_clock = defaults[0] * 3600 + defaults[1] * 60 + defaults[2]

    def day_seconds(layout: str, ymd: str) -> Column:
        date = F.regexp_replace(text, layout, ymd).try_cast("date")
        return F.unix_date(date).cast("bigint") * DAY_SECONDS

    mark = STRICT_MARK if strict else MARK
    hour, minute, second = (
        F.coalesce(F.regexp_extract(text, mark + CLOCK, i + 1).try_cast("int"), F.lit(defaults[i])) for i in range(3)
    )
    clock = F.when(~text.rlike(mark + ANY_CLOCK), F.lit(default_clock)).when(
        text.rlike(mark + CLOCK), hour * 3600 + minute * 60 + second
    )
    # The layouts exclude each other; epochs, the usual case, come first.
    return (
        F.when(text.rlike(EPOCH), text.try_cast("bigint"))
        .when(text.rlike(DASH_DATE), wall_to_epoch(day_seconds(DASH_DATE, "$1-$2-$3") + clock, tz))
        .when(text.rlike(SLASH_DATE), wall_to_epoch(day_seconds(SLASH_DATE, "$3-$2-$1") + default_clock, tz))
    )


def parse_date_end_of_day(text: Column, tz: str = UTC, strict: bool = False) -> Column:
    return parse_date(text, tz, end_of_day=True, strict=strict)


def date_bound(value: str | int | None, tz: str = UTC, end_of_day: bool = False, strict: bool = False) -> int:
    """A filter bound as epoch seconds; 0, which means "no bound", only when it is absent.

    Raises ValueError when it cannot be read.  Reads what :func:`parse_date` reads, but at once, so that plans hold plain literals.
    """
    if value is None or isinstance(value, int):
        return value or 0
    if re.search(EPOCH.replace(r"\z", r"\Z"), value):
        if abs(int(value)) >= 1 << 63:
            raise ValueError(f"date out of range: {value!r}")
        return int(value)
    clock = list(END_OF_DAY if end_of_day else START_OF_DAY)
    if found := re.search(SLASH_DATE, value):
        day, month, year = map(int, found.groups())
    elif found := re.search(DASH_DATE, value):
        year, month, day = map(int, found.groups())
        mark = STRICT_MARK if strict else MARK
        if re.search(mark + ANY_CLOCK, value):
            parts = re.search(mark + CLOCK, value)
            if not parts:
                raise ValueError(f"not a time of day: {value!r}")
            clock = [default if part is None else int(part) for part, default in zip(parts.groups(), clock)]
    elif value.strip():
        raise ValueError(f"not a date: {value!r}")
    else:
        return 0
    try:
        return int(dt.datetime(year, month, day, *clock, tzinfo=ZoneInfo(tz)).timestamp())
    except ValueError as error:
        raise ValueError(f"no such date: {value!r}") from error


# The last day but one with four digits in its year, in any zone.
LAST_EPOCH = 253_402_214_400


def day_of(epoch: int, tz: str = UTC) -> str:
    """The label of the day of an instant, as :func:`day_label` gives it."""
    return dt.datetime.fromtimestamp(min(epoch, LAST_EPOCH), ZoneInfo(tz)).date().isoformat()


def _dated(epoch: Column, tz: str, label) -> Column:
    date = F.date_from_unix_date(F.floor(epoch_to_wall(epoch, tz) / F.lit(DAY_SECONDS)).cast("int"))
    return F.when(epoch > 0, label(date)).otherwise(F.lit(NO_DATE))


def day_label(epoch: Column, tz: str = UTC) -> Column:
    return _dated(epoch, tz, lambda d: d.cast("string"))


def month_label(epoch: Column, tz: str = UTC) -> Column:
    return _dated(epoch, tz, lambda d: F.substring(d.cast("string"), 1, 7))


def year_label(epoch: Column, tz: str = UTC) -> Column:
    return _dated(epoch, tz, lambda d: F.substring(d.cast("string"), 1, 4))


def week_label(epoch: Column, tz: str = UTC) -> Column:
    """ISO week, ``yyyy-Www``."""

    def label(date: Column) -> Column:
        year = F.extract(F.lit("YEAROFWEEK"), date).cast("string")
        return F.concat(F.lpad(year, 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))

    return _dated(epoch, tz, label)


PERIODS = {"day": day_label, "week": week_label, "month": month_label, "year": year_label}


def epoch_text(epoch: Column, tz: str = UTC) -> Column:
    """``yyyy-MM-dd HH:mm:ss``."""
    wall = epoch_to_wall(epoch, tz)
    date = F.date_from_unix_date(F.floor(wall / F.lit(DAY_SECONDS)).cast("int")).cast("string")
    clock = F.pmod(wall, F.lit(DAY_SECONDS))

    def two(value: Column) -> Column:
        return F.lpad(F.floor(value).cast("string"), 2, "0")

    return F.concat(
        date, F.lit(" "), two(clock / 3600), F.lit(":"), two(F.pmod(clock, F.lit(3600)) / 60), F.lit(":"),
        two(F.pmod(clock, F.lit(60))),
    )
