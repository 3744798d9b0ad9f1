"""Filters on readings.

All conditions of a :class:`FilterSpec` are ANDed.  A condition may be NULL where a field is missing; that
counts as failing, so keeping rows needs no NULL handling (and the conditions stay simple enough to reach the
file scan), while ``rejects`` negates the coalesced conjunction and therefore is its exact complement.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_bound
from ..model import Readings
from .errors import BUILTIN, ErrorDefinition, with_error
from .lookup import flag_in
from .unique import unique

NUL = "\x00"


@dataclass(frozen=True)
class FilterSpec:
    """Which readings to keep.  The methods return extended copies."""

    min_date: str | int | None = None
    max_date: str | int | None = None
    not_empty: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    only: tuple[tuple[str, tuple[str, ...]], ...] = ()
    exclude: tuple[tuple[str, tuple[str, ...]], ...] = ()
    allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    allowed_tables: tuple[tuple[str, DataFrame], ...] = ()
    remove_errors: bool = False
    errors: tuple[ErrorDefinition, ...] = BUILTIN
    unique: bool = False
    unique_scope: str = "global"
    invert: bool = False

    def dates(self, low: str | int | None = None, high: str | int | None = None) -> FilterSpec:
        """Both ends belong to the range; a date without a clock covers its whole day."""
        return replace(self, min_date=low, max_date=high)

    def require(self, *fields: str) -> FilterSpec:
        """Fields that must be there and not be empty."""
        return replace(self, not_empty=self.not_empty + fields)

    def forbid_null(self, *fields: str) -> FilterSpec:
        """Fields that must not hold the text ``null`` or a NUL character; missing is fine."""
        return replace(self, not_null=self.not_null + fields)

    def only_value(self, field: str, *values: str) -> FilterSpec:
        """Values of one field are alternatives, different fields must all match."""
        return replace(self, only=_grouped(self.only, field, values))

    def exclude_value(self, field: str, *values: str) -> FilterSpec:
        return replace(self, exclude=_grouped(self.exclude, field, values))

    def allow(self, field: str, values: Sequence[str] | DataFrame) -> FilterSpec:
        """A list of allowed values; a DataFrame (its first column) when the list may be large."""
        if isinstance(values, DataFrame):
            return replace(self, allowed_tables=self.allowed_tables + ((field, values),))
        cleaned = tuple(v for v in (str(v).strip() for v in values) if v)
        if not cleaned:
            raise ValueError(f"empty list of allowed values for {field!r}")
        return replace(self, allowed=_grouped(self.allowed, field, cleaned))

    def without_errors(self, errors: Sequence[ErrorDefinition] | None = None) -> FilterSpec:
        return replace(self, remove_errors=True, errors=self.errors if errors is None else tuple(errors))

    def once(self, scope: str = "global") -> FilterSpec:
        """Keep the first copy of identical readings, over all input or per ``source``."""
        return replace(self, unique=True, unique_scope=scope)

    def clean(self, errors: Sequence[ErrorDefinition] | None = None) -> FilterSpec:
        """The usual hygiene: a value, no known error, no nulls, no copies."""
        return self.require("value").without_errors(errors).forbid_null("value", "sensor_id").once()

    def rejects(self) -> FilterSpec:
        """Keep what would be dropped, and the other way round."""
        return replace(self, invert=not self.invert)

    @property
    def has_dates(self) -> bool:
        return self.min_date is not None or self.max_date is not None


def _grouped(groups, field: str, values: Sequence[str]):
    merged = {name: list(present) for name, present in groups}
    merged.setdefault(field, []).extend(str(v) for v in values)
    return tuple((name, tuple(dict.fromkeys(v))) for name, v in merged.items())


def conditions(r: Readings, spec: FilterSpec) -> list[tuple[str, Column]]:
    """The active conditions with the reason for failing each, cheapest first."""
    found: list[tuple[str, Column]] = []
    if spec.has_dates:
        low = date_bound(spec.min_date, r.tz, strict=r.strict)
        high = date_bound(spec.max_date, r.tz, end_of_day=True, strict=r.strict)
        if low > 0 or high > 0:
            found.append(("outside date range", r.timestamp_between(low, high)))
    for name in spec.not_empty:
        found.append((f"empty or missing: {name}", r.field(name) != ""))
    for name in spec.not_null:
        text = r.field(name)
        found.append((f"null value: {name}", text.isNull() | ((text != "null") & ~F.contains(text, F.lit(NUL)))))
    for name, values in spec.only:
        found.append((f"not the wanted value: {name}", r.equals_any(name, values)))
    for name, values in spec.exclude:
        found.append((f"excluded value: {name}", r.field(name).isNull() | ~r.equals_any(name, values)))
    for name, values in spec.allowed:
        found.append((f"not an allowed value: {name}", r.equals_any(name, values)))
    for i, (name, _) in enumerate(spec.allowed_tables):
        found.append((f"not an allowed value: {name}", F.col(f"_allowed{i}")))
    if spec.remove_errors:
        found.append(("error reading", F.col("_error").isNull()))
    return found


def _prepare(r: Readings, spec: FilterSpec) -> tuple[Readings, list[str]]:
    """Add the helper columns that some conditions look at."""
    helpers = []
    for i, (name, table) in enumerate(spec.allowed_tables):
        helper = f"_allowed{i}"
        r = r.with_df(flag_in(r.df, r.field(name), table, helper))
        helpers.append(helper)
    if spec.remove_errors:
        r = with_error(r, spec.errors)
        helpers.append("_error")
    return r, helpers


def apply_filter(r: Readings, spec: FilterSpec) -> Readings:
    """Readings that pass (or, inverted, fail) the conditions, then the first copies of these if asked for."""
    prepared, helpers = _prepare(r, spec)
    tests = [test for _, test in conditions(prepared, spec)]
    df = prepared.df
    if spec.invert:
        accepted = F.lit(True)
        for test in tests:
            accepted = accepted & test
        df = df.where(~F.coalesce(accepted, F.lit(False)))
    else:
        for test in tests:
            df = df.where(test)
    kept = r.with_df(df.drop(*helpers))
    return unique(kept, spec.unique_scope) if spec.unique else kept


def reject_reasons(r: Readings, spec: FilterSpec) -> Readings:
    """The rejected readings with ``reasons`` (every failed condition) and ``reason`` (the first of them)."""
    prepared, helpers = _prepare(r, spec)
    failed = [
        F.when(~F.coalesce(test, F.lit(False)), F.lit(reason)) for reason, test in conditions(prepared, spec)
    ]
    reasons = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    df = prepared.df.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    return r.with_df(df.withColumn("reason", F.get("reasons", F.lit(0))).drop(*helpers))
