"""Numbers held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number.
NUMBER = r"^[ \t\n\r\f\x0B]*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
NUMBER_PREFIX = r"^[ \t\n\r\f\x0B]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
JSON_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
INFINITY = float("inf")


def finite(value: Column) -> Column:
    """The DOUBLE itself, NULL for NaN and the infinities."""
    return F.when(F.abs(value) < INFINITY, value)


def number(text: Column) -> Column:
    """DOUBLE when the whole text is a decimal number, else NULL."""
    return finite(F.when(text.rlike(NUMBER), text).try_cast("double"))


def number_prefix(text: Column) -> Column:
    """DOUBLE of the leading number (``22.5C`` is 22.5), else NULL."""
    return finite(F.nullif(F.regexp_extract(text, NUMBER_PREFIX, 1), F.lit("")).try_cast("double"))


def is_json_number(text: Column) -> Column:
    return text.rlike(JSON_NUMBER)
