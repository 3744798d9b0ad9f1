"""Text: trimming, durations and JSON rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import is_json_number


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n"))


def equals_ignore_case(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def duration_text(seconds: Column) -> Column:
    """``1d 2h 3m 4s``; leading zero units are left out."""
    parts = []
    for unit, size, larger in (("d", 86400, None), ("h", 3600, 86400), ("m", 60, 3600)):
        within = seconds if larger is None else F.pmod(seconds, F.lit(larger))
        count = F.floor(within / F.lit(size)).cast("string")
        parts.append(F.when(seconds >= size, F.concat(count, F.lit(unit))))
    return F.concat_ws(" ", *parts, F.concat(F.pmod(seconds, F.lit(60)).cast("string"), F.lit("s")))


def json_string(text: Column) -> Column:
    """A JSON string literal with quotes and escapes."""
    # {"x":"..."} without its braces and key.
    wrapped = F.rtrim(F.to_json(F.struct(text.alias("x"))), F.lit("}"))
    return F.substring(wrapped, 6, (1 << 31) - 1)


def json_scalar(text: Column) -> Column:
    """Empty and ``null`` give null; booleans and JSON numbers stay bare; anything else is quoted."""
    return (
        F.when(F.coalesce(text, F.lit("")).isin("", "null"), F.lit("null"))
        .when(text.isin("true", "false") | is_json_number(text), text)
        .otherwise(json_string(text))
    )
