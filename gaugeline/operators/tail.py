"""Last readings of each source."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Readings
from .filters import FilterSpec, apply_filter
from .ordered import first_n
from .unique import unique


def _source_key(r: Readings) -> list[str]:
    if r.is_raw:
        return ["source"]
    return [r.columns["source"]] if "source" in r.columns else []


def tail_rows(df: DataFrame, source: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows per source of any frame with an arrival order."""
    return first_n(df, source, [F.col(c).desc() for c in order], n)


def tail(r: Readings, n: int) -> Readings:
    """The last n readings of each source, before any filter."""
    return r.with_df(tail_rows(r.df, _source_key(r), list(r.order), n))


def tail_column_value(r: Readings, field: str, value: str, n: int, spec: FilterSpec | None = None) -> Readings:
    """The last n readings of each source whose ``field`` is ``value`` and which pass ``spec``.

    As the search runs backwards, uniqueness keeps the last copy.
    """
    spec = spec or FilterSpec()
    matching = r.with_df(r.df.where(r.equals_any(field, [value])))
    if spec.unique:
        matching = unique(apply_filter(matching, replace(spec, unique=False)), spec.unique_scope, keep="last")
    else:
        matching = apply_filter(matching, spec)
    kept = tail(matching, n)
    return kept.with_df(kept.df.orderBy(*r.order_columns()))
