"""First (or last) copy of identical readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Readings

_FLAT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def content(r: Readings) -> list[Column]:
    """What makes two readings identical: all their fields, in whatever order these were written."""
    if r.is_raw:
        return [F.array_sort(F.map_entries("fields")).alias("_content")]
    return [r.native(name) for name in r.columns]


def unique(r: Readings, scope: str = "global", keep: str = "first") -> Readings:
    """One copy per distinct reading, chosen by arrival order.

    Written as a grouped minimum, so copies are folded before the shuffle and a reading that makes up a large
    part of the input costs one row per task.
    """
    if scope not in ("global", "source"):
        raise ValueError(f"unknown scope {scope!r}")
    pick = {"first": F.min, "last": F.max}[keep]
    keys = content(r)
    source = "source" if r.is_raw else (r.columns or {}).get("source")
    key_names = ["_content"] if r.is_raw else [r.columns[name] for name in r.columns]
    if scope == "source" and source and source not in key_names:
        keys.append(F.col(source))
        key_names.append(source)
    df = r.df.select("*", keys[0]) if r.is_raw else r.df
    derived = {"fields"} if r.is_raw else set()
    rest = [c for c in r.df.columns if c not in key_names and c not in derived]
    at = [c for c in r.order if c in rest]
    carried = at + [c for c in rest if c not in at]
    if len(carried) == 1 and isinstance(r.df.schema[carried[0]].dataType, _FLAT):
        grouped = df.groupBy(*key_names).agg(pick(carried[0]).alias(carried[0]))
    elif carried:
        grouped = df.groupBy(*key_names).agg(pick(F.struct(*carried)).alias("_at")).select(*key_names, "_at.*")
    else:
        grouped = df.select(*key_names).distinct()
    if r.is_raw:
        grouped = grouped.withColumn("fields", F.map_from_entries("_content"))
    return r.with_df(grouped.select(*r.df.columns))
