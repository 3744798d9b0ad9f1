"""Operators along an order: previous reading, consecutive changes, first and last n.

No window here covers a group that grows with the data: groups above a limit are cut into slices of consecutive
rows (see ``skew``), the work is done per slice, and what crosses slice borders is settled on one row per slice.
Slices are stretches of a number line, so where numbers are sparse (hashed ids) there may be a slice per row.  Hence
their summaries are merged as a tree: first within stretches of ``2 ** FAN_BITS`` slices, then these among each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import GROUP_ROWS, sliced

# So many slices at most are merged at once; of 64-bit numbers there are then few enough stretches for a group.
FAN_BITS = 22

# First and last n: rows of one key are cut down within groups of tasks, then within fewer groups, then overall.
# Spark trims a ranking inside of the tasks that produce the rows only up to FEW, so longer lists need more rounds.
FEW = 1000
ROUNDS = (64, 1)
LONG_ROUNDS = (4096, 64, 1)


def stretches(df: DataFrame, levels: Sequence[Sequence[Column]], slices: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add what tells the stretch of slices a row belongs to; the slice columns are those of ``sliced``."""
    *above, last = slices[:len(levels[0])]
    return df.withColumn("_stretch", F.shiftright(last, FAN_BITS)), [*above, "_stretch"]


def with_previous(
    df: DataFrame, by: Sequence[str], order: Sequence[str], levels: Sequence[Sequence[Column]],
    columns: Sequence[str], limit: int = GROUP_ROWS, name: str = "previous",
) -> DataFrame:
    """Add struct ``name`` with ``columns`` of the preceding row of the same ``by`` group, NULL for the first.

    ``order`` must be unique within a group.
    """
    rows, slices = sliced(df, by, levels, limit)
    rows, stretch = stretches(rows, levels, slices)
    rows = rows.withColumn("_tail", F.struct(*columns))
    drop = ["_first", "_last", "_tail", "_stretch", *slices]
    done = []
    # Of every slice the first row still lacks its predecessor, the last row of the slice before; then of every stretch.
    for group in ([*slices, *stretch], stretch, []):
        window = Window.partitionBy(*by, *dict.fromkeys(group)).orderBy(*order)
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = (
            rows.withColumn(name, F.lag("_tail").over(window)).withColumn("_first", F.row_number().over(window) == 1)
            .withColumn("_last", F.last("_tail").over(whole))
        )
        done.append((rows.where(~F.col("_first")) if group else rows).drop(*drop))
        rows = rows.where("_first").withColumn("_tail", F.col("_last"))
    return reduce(DataFrame.unionByName, done)


def change_summary(
    df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], levels: Sequence[Sequence[Column]],
    limit: int = GROUP_ROWS, always: bool = False,
) -> DataFrame:
    """Absolute changes between consecutive rows of a ``by`` group, summarised.

    Columns: ``n_changes, change_min, change_max, change_mean, volatility, jump_size, jump_from, jump_to``.
    Changes are folded to one row per slice where they arise; the changes across slice borders join in then.
    """
    rows, slices = sliced(df, by, levels, limit, always)
    rows, stretch = stretches(rows, levels, slices)
    group = list(dict.fromkeys([*by, *stretch, *slices]))
    window = Window.partitionBy(*group).orderBy(*order)
    rows = rows.select("*", F.lag(value).over(window).alias("_before"), F.lead(value).over(window).alias("_after"))
    rows = rows.withColumn("_change", F.abs(F.col(value) - F.col("_before")))

    def jump(change: Column, at: Sequence[Column], before: Column, after: Column) -> Column:
        """Ordered so that the minimum is the largest change, the earliest among equals."""
        ranked = F.struct((-change).alias("down"), *at, before.alias("before"), after.alias("after"))
        return F.when(change.isNotNull(), ranked)

    at = [F.col(c) for c in order]
    placed = F.struct(*order, F.col(value).alias("value"))
    per_slice = rows.groupBy(*group).agg(
        F.count("_change").alias("n"),
        F.min("_change").alias("low"),
        F.max("_change").alias("high"),
        F.avg("_change").alias("mean"),
        (F.var_pop("_change") * F.count("_change")).alias("spread"),
        F.min(jump(F.col("_change"), at, F.col("_before"), F.col(value))).alias("jump"),
        # Values are not NULL, so these pick the one row at either end of the slice.
        F.min(F.when(F.col("_before").isNull(), placed)).alias("head"),
        F.max(F.when(F.col("_after").isNull(), placed)).alias("tail"),
    )

    def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
        """One summary for all parts of a group, with the changes between neighbouring parts."""
        along = Window.partitionBy(*keys).orderBy("head")
        together = Window.partitionBy(*keys)
        border = F.col("border")
        joined = parts.withColumn("before", F.lag("tail").over(along)["value"])
        joined = joined.withColumn("border", F.abs(F.col("head.value") - F.col("before")))
        joined = joined.withColumn("total", F.sum(F.col("n") + border.isNotNull().cast("int")).over(together))
        sums = F.coalesce(F.col("n") * F.col("mean"), F.lit(0.0)) + F.coalesce(border, F.lit(0.0))
        joined = joined.withColumn("overall", F.sum(sums).over(together) / F.nullif(F.col("total"), F.lit(0)))
        border_jump = jump(border, [F.col(f"head.{c}").alias(c) for c in order], F.col("before"), F.col("head.value"))
        off = F.col("mean") - F.col("overall")
        border_off = border - F.col("overall")
        return joined.withColumn("jump", F.least("jump", border_jump)).groupBy(*keys).agg(
            F.max("total").alias("n"),
            F.min(F.least("low", "border")).alias("low"),
            F.max(F.greatest("high", "border")).alias("high"),
            F.max("overall").alias("mean"),
            F.sum(F.coalesce(F.col("spread") + F.col("n") * off * off, F.lit(0.0)) + F.coalesce(border_off * border_off, F.lit(0.0)))
            .alias("spread"),
            F.min("jump").alias("jump"),
            F.min("head").alias("head"),
            F.max("tail").alias("tail"),
        )

    found = merged(merged(per_slice, [*by, *stretch]), by)
    n, best = F.col("n"), F.col("jump")
    return found.select(
        *by, n.alias("n_changes"), F.col("low").alias("change_min"), F.col("high").alias("change_max"), F.col("mean").alias("change_mean"),
        F.when(n > 1, F.sqrt(F.col("spread") / (n - 1))).when(n == 1, F.lit(0.0)).alias("volatility"),
        (-best["down"]).alias("jump_size"), best["before"].alias("jump_from"), best["after"].alias("jump_to"),
    )


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each ``by`` group in the given order.

    Ranked in rounds: first among the rows from a few tasks, so that no task receives ``n`` rows from every task
    of the scan for a key that is everywhere, then among what is left.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    rows = df.withColumn("_task", F.spark_partition_id())
    for groups in ROUNDS if n <= FEW else LONG_ROUNDS:
        rows = rows.withColumn("_tasks", F.pmod("_task", F.lit(groups)))
        window = Window.partitionBy(*by, "_tasks") if groups > 1 else Window.partitionBy(*by)
        rows = rows.withColumn("_rank", F.row_number().over(window.orderBy(*order))).where(F.col("_rank") <= n)
    return rows.drop("_rank", "_task", "_tasks")
