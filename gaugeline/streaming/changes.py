"""Running changes per sensor: deltas, the largest jump, the time line and the sampling gaps so far.

Each micro-batch is summarised with the batch operators, which cut up sensors that have too much data for one
task, and the summaries are merged into a kept table with one row per sensor, of which a batch writes the rows of its own
sensors.  What these steps need of a batch is parsed once and stored while they run.  A row of batch n is computed from that of the batches before and the data of batch n alone and is written under
the number n, so repeating a batch after a failure gives the same table.

Within a batch readings are taken in the order of their timestamps or of their arrival; batches follow each other.  In arrival
order the result does not depend on how the files are dealt out to batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Readings
from ..operators import stats
from ..operators.ordered import change_summary
from ..session import written
from .running import read_latest
from .source import in_order
from .store import Kept

STATE = (
    "sensor_id", "count", "first_ts", "last_ts", "head", "tail", "n_changes", "change_min", "change_max", "change_mean",
    "spread", "jump_size", "jump_from", "jump_to",
)


Once = Callable[[DataFrame], DataFrame]


@contextmanager
def parsed_once(kept: Kept, batch_id: int) -> Iterator[Once]:
    """Gives a function that stores the rows of a batch beside the result; they go when the batch is done."""
    path = f"{kept.path}/_batch-{batch_id}"
    try:
        yield lambda rows: written(rows, path)
    finally:
        kept.remove(path)


def summarise(r: Readings, field: str = "value", by_time: bool = True, once: Once = lambda rows: rows) -> DataFrame:
    """One row per sensor of a batch, in the form that :func:`merge` combines.

    Readings are taken in the order of their timestamps, or else in that of their arrival.
    """
    df = r.df.withColumn("sensor_id", r.field("sensor_id")).withColumn("_v", r.number(field))
    df = df.withColumn("_ts", F.coalesce(r.timestamp(), F.lit(0).cast("bigint")))
    order = ["_ts", *r.order] if by_time else list(r.order)
    kept = list(dict.fromkeys([*order, "_ts"]))
    rows = once(df.where(F.col("sensor_id").isNotNull() & F.col("_v").isNotNull()).select("sensor_id", "_v", *kept))
    levels = r.arrival_levels()
    if by_time:
        levels = [[F.shiftright("_ts", stats.TIME_BITS)], *[[F.col("_ts"), *level] for level in levels]]
    changes = change_summary(rows, ["sensor_id"], "_v", order, levels)
    placed = F.struct(*order, F.col("_v").alias("v"))
    present = F.when(F.col("_ts") > 0, F.col("_ts"))
    ends = rows.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("count"), F.min(present).alias("first_ts"), F.max(present).alias("last_ts"),
        F.min(placed)["v"].alias("head"), F.max(placed)["v"].alias("tail"),
    )
    spread = F.coalesce(F.col("volatility") * F.col("volatility") * (F.col("n_changes") - 1), F.lit(0.0))
    return ends.join(changes, "sensor_id").withColumn("spread", spread).select(*STATE)


def merge(before: DataFrame, batch: DataFrame) -> DataFrame:
    """Append the summaries of a batch to those of everything before it."""
    a, b = before.alias("a"), batch.alias("b")

    def old(name: str) -> Column:
        return F.col(f"a.{name}")

    def new(name: str) -> Column:
        return F.col(f"b.{name}")

    def either(name: str) -> Column:
        return F.coalesce(old(name), new(name))

    def total(x: Column, y: Column) -> Column:
        zero = F.lit(0)
        return F.coalesce(x, zero) + F.coalesce(y, zero)

    # The change from the last old to the first new value is a summary of a single change.
    border = F.abs(new("head") - old("tail"))
    parts = [
        (F.coalesce(old("n_changes"), F.lit(0)), old("change_mean"), old("spread")),
        (F.when(border.isNotNull(), 1).otherwise(0), border, F.lit(0.0)),
        (F.coalesce(new("n_changes"), F.lit(0)), new("change_mean"), new("spread")),
    ]
    zero = F.lit(0.0)
    n = parts[0][0] + parts[1][0] + parts[2][0]
    mean = sum((F.coalesce(k * m, zero) for k, m, _ in parts), zero) / F.nullif(n, F.lit(0))
    spread = sum((F.coalesce(s, zero) + F.coalesce(k * (m - mean) * (m - mean), zero) for k, m, s in parts), zero)

    def jump(size: Column, start: Column, end: Column) -> Column:
        return F.when(size.isNotNull(), F.struct(size.alias("size"), start.alias("start"), end.alias("end")))

    jumps = [
        jump(old("jump_size"), old("jump_from"), old("jump_to")), jump(border, old("tail"), new("head")),
        jump(new("jump_size"), new("jump_from"), new("jump_to")),
    ]
    largest = F.array_max(F.transform(F.array_compact(F.array(*jumps)), lambda j: j["size"]))
    best = F.element_at(F.filter(F.array_compact(F.array(*jumps)), lambda j: j["size"] == largest), 1)
    has_jump = F.size(F.array_compact(F.array(*jumps))) > 0
    joined = a.join(b, old("sensor_id") == new("sensor_id"), "full").select(
        either("sensor_id").alias("sensor_id"), total(old("count"), new("count")).alias("count"),
        F.least(old("first_ts"), new("first_ts")).alias("first_ts"),
        F.greatest(old("last_ts"), new("last_ts")).alias("last_ts"), either("head").alias("head"),
        F.coalesce(new("tail"), old("tail")).alias("tail"), n.cast("bigint").alias("n_changes"),
        F.least(old("change_min"), border, new("change_min")).alias("change_min"),
        F.greatest(old("change_max"), border, new("change_max")).alias("change_max"), mean.alias("change_mean"),
        spread.alias("spread"), F.when(has_jump, best).alias("_jump"),
    )
    return joined.select(
        *[c for c in STATE if not c.startswith("jump_")], F.col("_jump.size").alias("jump_size"),
        F.col("_jump.start").alias("jump_from"), F.col("_jump.end").alias("jump_to"),
    )


def report(state: DataFrame) -> DataFrame:
    n = F.col("n_changes")
    volatility = F.when(n > 1, F.sqrt(F.col("spread") / (n - 1))).when(n == 1, F.lit(0.0))
    return state.withColumn("volatility", volatility).drop("head", "tail", "spread")


def write_changes(
    r: Readings, path: str, checkpoint: str, field: str = "value", trigger: dict | None = None, by_time: bool = True
):
    """Start the query; ``read_changes(spark, path)`` gives the result so far."""
    kept = Kept(r.df.sparkSession, path, ["sensor_id"])

    def update(batch: DataFrame, batch_id: int) -> None:
        if kept.finished(batch_id):
            return
        with parsed_once(kept, batch_id) as once:
            found = summarise(in_order(r, batch), field, by_time, once)
            before = kept.read(batch_id)
            if before is not None:
                # Only the sensors of this batch change.
                found = merge(before.join(found.select("sensor_id"), "sensor_id", "left_semi"), found)
            kept.write(found, batch_id)

    writer = r.df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_changes(spark, path: str) -> DataFrame:
    return report(read_latest(spark, path))


# -- sampling gaps ---------------------------------------------------------------------------------------------

GAP_KEYS = ("sensor_id", "seconds")


def batch_gaps(r: Readings, before: DataFrame | None, once: Once = lambda rows: rows) -> DataFrame:
    """``sensor_id, seconds, n, last_ts``: the time differences that a batch adds, with that to the batch before it.

    The last timestamp of a sensor so far is the row without ``seconds``.
    """
    sensor = r.field("sensor_id")
    named = once(r.df.where(sensor.isNotNull()).select(sensor.alias("sensor_id"), stats.moment(r).alias("moment"), r.timestamp().alias("ts")))
    nothing = F.lit(None).cast("bigint")
    moments = named.where("moment is not null").select("sensor_id", F.col("moment").alias("ts"))
    inside = stats.intervals_of(moments, ["sensor_id"]).select("sensor_id", "seconds", "n", nothing.alias("last_ts"))
    times = named.where("ts is not null").select("sensor_id", "ts")
    ends = times.groupBy("sensor_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    if before is None:
        return inside.union(ends.select("sensor_id", nothing, nothing, "last"))
    known = before.where("seconds is null").select("sensor_id", F.col("last_ts").alias("until"))
    ends = ends.join(known, "sensor_id", "left")
    # A batch that begins before the last one's end is late; its distance counts all the same.
    border = ends.where("until is not null").select(
        "sensor_id", F.abs(F.col("first") - F.col("until")).alias("seconds"), F.lit(1).cast("bigint").alias("n"), nothing.alias("last_ts"))
    last = ends.select("sensor_id", nothing.alias("seconds"), nothing.alias("n"), F.greatest("last", "until").alias("last_ts"))
    added = inside.union(border).groupBy("sensor_id", "seconds").agg(F.sum("n").alias("n"))
    old = before.where("seconds is not null").select("sensor_id", "seconds", F.col("n").alias("so_far"))
    counted = added.join(old, list(GAP_KEYS), "left").select(
        "sensor_id", "seconds", (F.col("n") + F.coalesce("so_far", F.lit(0))).alias("n"), nothing.alias("last_ts"))
    return counted.union(last)


def write_sampling(r: Readings, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that counts the differences between neighbouring timestamps of every sensor.

    Timestamps are sorted within a batch, and batches follow each other.  A batch writes the counts that it changed.
    """
    kept = Kept(r.df.sparkSession, path, GAP_KEYS)

    def update(batch: DataFrame, batch_id: int) -> None:
        if kept.finished(batch_id):
            return
        with parsed_once(kept, batch_id) as once:
            kept.write(batch_gaps(in_order(r, batch), kept.read(batch_id), once), batch_id)

    writer = r.df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_sampling(spark, path: str) -> DataFrame:
    """``sensor_id, typical_interval, gaps, max_gap`` so far."""
    return stats.sampling_of(read_latest(spark, path).where("seconds is not null").select("sensor_id", "seconds", "n"), ["sensor_id"])
