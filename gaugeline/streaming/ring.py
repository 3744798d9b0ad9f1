"""The last points of every sensor, kept while a stream runs.

A micro-batch is cut down to the newest points of each sensor first, in rounds over groups of tasks, so a sensor with a third
of all readings does not bring them to one task.  What is left, at most ``size`` points per sensor, is put behind the points
that were kept, and the oldest drop out.  A batch writes the sensors that got new points.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Readings
from ..operators.ordered import first_n
from ..operators.series import BUCKETS, series
from ..session import fresh_path
from .source import in_order
from .store import Kept

RING_SIZE = BUCKETS
PRELOADED = 200


def history(r: Readings, n: int = PRELOADED) -> DataFrame:
    """The last n points of each sensor of a batch frame: ``sensor_id, timestamps, readings``, oldest first."""
    rows = first_n(series(r, None, r.order), ["sensor_id"], [F.col(c).desc() for c in ("timestamp", *r.order)], n)
    points = F.array_sort(F.collect_list(F.struct("timestamp", *r.order, "value")))
    rings = rows.groupBy("sensor_id").agg(points.alias("p"))
    return rings.select(
        "sensor_id", F.transform("p", lambda x: x["timestamp"]).alias("timestamps"),
        F.transform("p", lambda x: x["value"]).alias("readings"),
    )


def _ring(size: int, timestamps, readings, historical) -> list:
    """The last ``size`` points; historical ones are the oldest, so they drop out first."""
    surplus = F.greatest(F.size(readings) - size, F.lit(0))
    return [
        F.slice(timestamps, surplus + 1, F.lit(size)).alias("timestamps"), F.slice(readings, surplus + 1, F.lit(size)).alias("readings"),
        F.greatest(historical - surplus, F.lit(0)).cast("int").alias("historical"),
    ]


def merged(before: DataFrame | None, recent: DataFrame, size: int) -> DataFrame:
    """The rings of the sensors in ``recent``, behind what was kept of them."""
    if before is None:
        found = recent.withColumn("historical", F.lit(0))
    else:
        old = before.select(
            "sensor_id", F.col("timestamps").alias("_timestamps"), F.col("readings").alias("_readings"), F.col("historical").alias("_historical"))
        joined = recent.join(old, "sensor_id", "left")
        found = joined.select(
            "sensor_id", F.concat(F.coalesce("_timestamps", F.array().cast("array<bigint>")), "timestamps").alias("timestamps"),
            F.concat(F.coalesce("_readings", F.array().cast("array<double>")), "readings").alias("readings"),
            F.coalesce("_historical", F.lit(0)).alias("historical"))
    return found.select("sensor_id", *_ring(size, F.col("timestamps"), F.col("readings"), F.col("historical")))


def described(rings: DataFrame) -> DataFrame:
    return rings.select(
        "sensor_id", F.size("readings").alias("points"), "historical", F.array_min("readings").alias("min_value"),
        F.array_max("readings").alias("max_value"), "timestamps", "readings")


def write_last_points(
    r: Readings, path: str, checkpoint: str, size: int = RING_SIZE, preloaded: DataFrame | None = None,
    trigger: dict | None = None,
):
    """Start the query; every micro-batch writes the rings that changed as one version.

    ``preloaded`` rings (``history``) count as historical until they drop out.
    """
    spark: SparkSession = r.df.sparkSession
    kept = Kept(spark, path, ["sensor_id"])
    start = None
    if preloaded is not None:
        # Written once, so that every batch that needs it reads the same.
        written = fresh_path(spark, "history")
        preloaded.write.parquet(written)
        first = spark.read.parquet(written).withColumn("historical", F.size("readings"))
        start = first.select("sensor_id", *_ring(size, F.col("timestamps"), F.col("readings"), F.col("historical")))

    def update(batch: DataFrame, batch_id: int) -> None:
        if kept.finished(batch_id):
            return
        recent = history(in_order(r, batch), size)
        before = kept.read(batch_id)
        if before is not None:
            before = before.select("sensor_id", "timestamps", "readings", "historical")
        if start is not None:
            before = start if before is None else before.union(
                start.join(before.select("sensor_id"), "sensor_id", "left_anti").select(*before.columns))
        kept.write(described(merged(before, recent, size)), batch_id)

    writer = r.df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_last_points(spark: SparkSession, path: str) -> DataFrame:
    """The newest ring of every sensor that got points."""
    found = Kept(spark, path).read()
    if found is None:
        raise FileNotFoundError(f"no finished version in {path}")
    return found
