"""From one map per reading to one column per field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Readings


def discover_columns(r: Readings) -> list[str]:
    """Sorted names of all fields found in the frame (an action on raw frames).

    They become columns of one table; name the wanted columns where there are too many for that.
    """
    if not r.is_raw:
        return sorted(r.columns)
    names = r.df.select(F.explode(F.map_keys("fields")).alias("name")).distinct().collect()
    return sorted(row["name"] for row in names)


def widen(r: Readings, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One text column per field, NULL where missing.

    ``columns`` declares the fields instead of discovering them, which saves a pass; other fields are dropped.
    """
    names = discover_columns(r) if columns is None else list(columns)
    return r.df.select(*keep, *[r.field(name).alias(name) for name in names])
