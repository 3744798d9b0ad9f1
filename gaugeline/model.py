"""The data model: a DataFrame of readings plus the way to reach a reading's fields.

A frame of readings comes in two forms which share every operator:

* *raw* - ``source, block, row, pos, fields MAP<STRING,STRING>`` as produced by ``sources``; the first four
  columns give the place of a reading in its input and sort like the input itself;
* *typed* - any DataFrame together with a mapping from field names to its columns.

Operators only use :meth:`Readings.field` and its relatives.  NULL from these means "missing"; the empty
string and the text ``null`` are values of their own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import dates, numbers

MISSING = "(missing)"
RAW_ORDER = ("source", "block", "row", "pos")

# A slice of the arrival order holds at most 2**SLICE_BITS consecutive positions.
SLICE_BITS = 18

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Readings:
    """A frame of readings.

    ``columns`` maps field names to columns of a typed frame and is ``None`` for a raw frame.  ``order`` names
    the columns that together give each reading its unique place; their sort order is the arrival order.
    ``order_depth`` states that readings which agree in the first so many order columns are few.  ``day`` names the
    column of a staged table's partitions, the day of each reading as ``YYYY-MM-DD``.
    """

    df: DataFrame
    columns: Mapping[str, str] | None = None
    order: tuple[str, ...] = RAW_ORDER
    tz: str = dates.UTC
    strict: bool = False
    order_depth: int | None = None
    day: str | None = None
    _types: Mapping[str, T.DataType] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "_types", {f.name: f.dataType for f in self.df.schema.fields})
        missing = [c for c in self.order if c not in self._types]
        if missing:
            raise ValueError(f"order columns not in the frame: {missing}")

    # -- construction ----------------------------------------------------------------------------------------

    @classmethod
    def typed(
        cls, df: DataFrame, columns: Mapping[str, str] | Sequence[str], order: Sequence[str], tz: str = dates.UTC,
        strict: bool = False, order_depth: int | None = None,
    ) -> Readings:
        mapping = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
        unknown = [c for c in mapping.values() if c not in df.columns]
        if unknown:
            raise ValueError(f"mapped columns not in the frame: {unknown}")
        return cls(df, mapping, tuple(order), tz, strict, order_depth)

    def with_df(self, df: DataFrame, columns: Mapping[str, str] | None = None) -> Readings:
        return replace(self, df=df, columns=self.columns if columns is None else columns)

    @property
    def is_raw(self) -> bool:
        return self.columns is None

    # -- fields ----------------------------------------------------------------------------------------------

    def field(self, name: str) -> Column:
        """The field as text, NULL when missing."""
        if self.is_raw:
            return F.try_element_at(F.col("fields"), F.lit(name))
        if name not in self.columns:
            return F.lit(None).cast("string")
        column = self.native(name)
        return column if isinstance(self.type_of(name), T.StringType) else column.cast("string")

    def native(self, name: str) -> Column:
        return F.col(f"`{self.columns[name]}`")

    def type_of(self, name: str) -> T.DataType:
        return self._types[self.columns[name]]

    def equals_any(self, name: str, values: Sequence[str]) -> Column:
        """Field text is one of ``values``; NULL when the field is missing.

        Integral columns are compared as integers so that the predicate reaches a columnar file scan.
        """
        if not self.is_raw and name in self.columns and isinstance(self.type_of(name), _INTEGRAL):
            whole = sorted({int(v) for v in values if _is_canonical_integer(v)})
            if not whole:
                return F.when(self.native(name).isNotNull(), F.lit(False))
            return self.native(name).isin(whole)
        return self.field(name).isin(sorted(set(values)))

    def number(self, name: str) -> Column:
        """The field as DOUBLE when all of it is a number, else NULL."""
        if not self.is_raw and name in self.columns:
            kind = self.type_of(name)
            if isinstance(kind, _INTEGRAL):
                return self.native(name).cast("double")
            if isinstance(kind, _FRACTIONAL):
                return numbers.finite(self.native(name).cast("double"))
        return numbers.number(self.field(name))

    def number_prefix(self, name: str) -> Column:
        """As :meth:`number`, but text after a leading number is ignored."""
        if not self.is_raw and name in self.columns and isinstance(self.type_of(name), _INTEGRAL + _FRACTIONAL):
            return self.number(name)
        return numbers.number_prefix(self.field(name))

    # -- time ------------------------------------------------------------------------------------------------

    def timestamp(self) -> Column:
        """Epoch seconds of the reading, NULL when absent."""
        if not self.is_raw and "timestamp" in self.columns:
            kind, column = self.type_of("timestamp"), self.native("timestamp")
            if isinstance(kind, T.TimestampType):
                return F.unix_seconds(column)
            if isinstance(kind, T.TimestampNTZType):
                # For a timestamp without zone these are the seconds on its own clock, whatever the session zone.
                return dates.wall_to_epoch(F.unix_timestamp(column), self.tz)
            if isinstance(kind, T.DateType):
                return dates.wall_to_epoch(F.unix_date(column).cast("bigint") * dates.DAY_SECONDS, self.tz)
            if isinstance(kind, _INTEGRAL):
                return F.nullif(column.cast("bigint"), F.lit(0).cast("bigint"))
        parsed = dates.parse_date(self.field("timestamp"), self.tz, strict=self.strict)
        return F.nullif(parsed, F.lit(0).cast("bigint"))

    def timestamp_between(self, low: int, high: int) -> Column:
        """``low <= timestamp <= high``, where a bound of 0 or less is open; NULL without a timestamp.

        Stated on the stored column where its type allows, so that the file scan can skip data.
        """
        exact = self._moments_between(low, high)
        if self.day is None or self.day not in self._types:
            return exact
        # Text, as readings without a date have a label of their own, which sorts before any day.
        day = F.col(self.day).cast("string")
        days = [day >= dates.day_of(low, self.tz)] if low > 0 else []
        days += [day <= dates.day_of(high, self.tz)] if 0 < high < dates.LAST_EPOCH else []
        return reduce(Column.__and__, days, exact)

    def _moments_between(self, low: int, high: int) -> Column:
        kind = None if self.is_raw or "timestamp" not in self.columns else self.type_of("timestamp")
        if isinstance(kind, T.TimestampType):
            column, stop = self.native("timestamp"), high + 1

            def moment(seconds: int) -> Column:
                return F.timestamp_seconds(F.lit(seconds))

        elif isinstance(kind, T.TimestampNTZType) and self.tz == dates.UTC:
            column, stop = self.native("timestamp"), high + 1

            def moment(seconds: int) -> Column:
                wall = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)
                return F.expr(f"TIMESTAMP_NTZ'{wall.isoformat(sep=' ')}'")

        else:
            column, stop = self.timestamp(), high + 1

            def moment(seconds: int) -> Column:
                return F.lit(seconds).cast("bigint")

        tests = [column >= moment(low)] if low > 0 else []
        tests += [column < moment(stop)] if high > 0 else []
        return reduce(Column.__and__, tests) if tests else column.isNotNull()

    # -- arrival order ---------------------------------------------------------------------------------------

    def order_columns(self, descending: bool = False) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]

    def arrival_levels(self) -> list[list[Column]]:
        """Ever finer ways to cut the arrival order into runs of consecutive readings (see ``skew.sliced``).

        A level uses the high bits of one integral order column and all columns before it as they are.
        """
        if self.is_raw:
            at = [self.order.index("row")]
        else:
            depth = len(self.order) if self.order_depth is None else self.order_depth
            at = [i for i, c in enumerate(self.order[:depth]) if isinstance(self._types[c], _INTEGRAL)]
        if not at:
            raise ValueError("the arrival order needs an integral column")
        high = {i: F.shiftright(F.col(self.order[i]).cast("bigint"), SLICE_BITS) for i in at}
        return [[F.col(c) for c in self.order[:i]] + [high[i]] for i in at]


def _is_canonical_integer(text: str) -> bool:
    try:
        return str(int(text)) == text
    except ValueError:
        return False
