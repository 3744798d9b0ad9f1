"""Keeping groups small enough for one task.

A group of rows that one task must see in order (a window) or hold at once (an exact percentile) may not grow
with the data.  Groups above a limit are found by counting, which folds before the shuffle; there can be no
more than ``rows / limit`` of them, and only this list is broadcast.  Rows of such groups get additional,
order-preserving slice columns; all other rows get NULL there and stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows one task may be given as a single group.
GROUP_ROWS = 1_000_000


def large_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > limit).select(*keys)


def flag_large(df: DataFrame, keys: Sequence[str], limit: int = GROUP_ROWS, name: str = "_large") -> DataFrame:
    """Add BOOLEAN ``name``: the row's group has more than ``limit`` rows.  Without keys everything is large."""
    if not keys:
        return df.withColumn(name, F.lit(True))
    found = large_groups(df, keys, limit).withColumn(name, F.lit(True))
    return df.join(F.broadcast(found), list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def sliced(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Sequence[Column]], limit: int = GROUP_ROWS,
    always: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Cut large groups into slices; returns the frame and the names of the slice columns.

    Each level is a list of columns that do not decrease along the wanted order.  Level 0 cuts the groups that
    are too large, level 1 cuts slices that still are, and so on; the last level must be fine enough.
    ``always`` takes all groups for large at level 0 and saves counting them.
    """
    group = list(keys)
    slices: list[str] = []
    for i, level in enumerate(levels):
        df = flag_large(df, [] if always and i == 0 else group, limit)
        names = [f"_slice{i}_{j}" for j in range(len(level))]
        for name, column in zip(names, level):
            df = df.withColumn(name, F.when(F.col("_large"), column))
        df = df.drop("_large")
        slices += names
        group += names
    return df, slices
