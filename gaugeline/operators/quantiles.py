"""Exact quantiles per group, whatever the size of a group.

Equal values of a group are folded to one row with a count.  These rows are dealt out by ranges of (group, value), so a
range is a *piece* of one group or several whole groups, and one row per piece tells how many values lie before it.

* A group that lies in one piece is ranked where it is; it is no longer than a range.
* A group of several pieces crosses a border between ranges, so there are fewer such groups than ranges, and they are
  broadcast: of each only the pieces that hold a wanted rank are ranked, and the results go back to its rows the same way.

Nothing depends on how the ranges come out, and no task ranks more values than a range holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000


def folded(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by, value, _c``: each distinct value of a group and how often it occurs."""
    return df.select(*by, value).where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))


def _ranks(p: float, n: Column) -> tuple[Column, Column]:
    """The ranks (from 0) around a quantile."""
    position = F.lit(p) * (n - 1)
    return F.floor(position), F.ceil(position)


def _between(below: Column, above: Column, p: float, n: Column) -> Column:
    """Linear interpolation between the values at the ranks around a quantile."""
    position = F.lit(p) * (n - 1)
    return below + (above - below) * (position - F.floor(position))


def wanted_pieces(
    rows: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], ranges: int | None = None
) -> DataFrame:
    """Of groups of several pieces: their size, and the pieces with a wanted rank (``low, high, before``)."""
    keys = [F.col(c) for c in (*by, value)]
    dealt = rows.repartitionByRange(*keys) if ranges is None else rows.repartitionByRange(ranges, *keys)
    v = F.col(value)
    pieces = dealt.withColumn("_piece", F.spark_partition_id()).groupBy(*by, "_piece").agg(
        F.min(v).alias("low"), F.max(v).alias("high"), F.sum("_c").alias("n"))
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.select(
        *by, "low", "high", "n", (upto - F.col("n")).alias("before"), F.count(F.lit(1)).over(group).alias("pieces"),
        F.sum("n").over(group).alias("size"))
    ranks = [rank for p in probabilities for rank in _ranks(p, F.col("size"))]
    wanted = reduce(Column.__or__, [(F.col("before") <= r) & (r < F.col("before") + F.col("n")) for r in ranks])
    piece = F.when(wanted, F.struct("low", "high", "before"))
    return placed.where("pieces > 1").groupBy(*by).agg(F.max("size").alias("_size"), F.collect_list(piece).alias("_wanted"))


def ranked_pieces(rows: DataFrame, by: Sequence[str], value: str, pieces: DataFrame) -> DataFrame:
    """The values in wanted pieces, with the number of values up to each (``_upto``)."""
    near = rows.join(F.broadcast(pieces), list(by))
    within = F.filter("_wanted", lambda x: F.col(value).between(x["low"], x["high"]))
    near = near.where(F.size(within) > 0).select(*by, value, "_c", "_size", within[0].alias("_in"))
    near = near.select(*by, value, "_c", "_size", F.col("_in.low").alias("_low"), F.col("_in.before").alias("_before"))
    piece = Window.partitionBy(*by, "_low").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("_upto", F.col("_before") + F.sum("_c").over(piece))


def with_quantiles(
    rows: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], ranges: int | None = None
) -> DataFrame:
    """Add the size and the quantiles of its group (``_n, _q0, _q1, ...``) to each folded row."""
    ranked = ranked_pieces(rows, by, value, wanted_pieces(rows, by, value, probabilities, ranges))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col(value)))

    size = F.col("_size")
    ends = [(f"_{side}{i}", at(rank)) for i, p in enumerate(probabilities) for side, rank in zip("ba", _ranks(p, size))]
    picked = ranked.groupBy(*by, "_size").agg(*[end.alias(name) for name, end in ends])
    found = picked.select(
        *by, "_size", *[_between(F.col(f"_b{i}"), F.col(f"_a{i}"), p, size).alias(f"_wide{i}") for i, p in enumerate(probabilities)])

    # Rows of the groups that are done need no ranking, and a slice of their own keeps them apart.
    marked = rows.join(F.broadcast(found), list(by), "left")
    marked = marked.withColumn("_slice", F.when(F.col("_size").isNotNull(), F.xxhash64(value)))
    whole = Window.partitionBy(*by, "_slice")
    along = whole.orderBy(value)
    everything = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c, v = F.col("_c"), F.col(value)
    placed = marked.select(
        "*", F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum(c).over(everything).alias("_here"))

    def here(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - c <= rank), v)).over(everything)

    n = F.col("_here")
    quantile = [
        F.coalesce(F.col(f"_wide{i}"), _between(*[here(r) for r in _ranks(p, n)], p, n)).alias(f"_q{i}")
        for i, p in enumerate(probabilities)
    ]
    return placed.select(*by, value, "_c", F.coalesce("_size", "_here").alias("_n"), *quantile)


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], ranges: int | None = None,
    approximate: bool = False,
) -> DataFrame:
    """``by`` columns plus ``quantiles ARRAY<DOUBLE>``, by linear interpolation between closest ranks.

    ``ranges`` is the number of ranges, by default that of shuffle partitions.  ``approximate`` asks for one pass with
    a sketch instead.
    """
    if approximate:
        rows = df.select(*by, value).where(F.col(value).isNotNull())
        sketch = F.percentile_approx(value, list(probabilities), SKETCH_ACCURACY)
        return rows.groupBy(*by).agg(sketch.alias("quantiles"))
    placed = with_quantiles(folded(df, by, value), by, value, probabilities, ranges)
    names = [f"_q{i}" for i in range(len(probabilities))]
    return placed.groupBy(*by).agg(*[F.max(n).alias(n) for n in names]).select(*by, F.array(*names).alias("quantiles"))
