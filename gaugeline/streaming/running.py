"""Running results on a stream.

Filters (without uniqueness), updates, counts, latest and error summaries are the batch operators themselves;
this module has what differs on a stream, and the way results are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Readings
from ..operators import counts, errors, stats
from ..operators.filters import FilterSpec, apply_filter
from ..operators.quantiles import SKETCH_ACCURACY, folded
from ..operators.unique import content, unique
from .source import in_order
from .store import Kept, version_path


def running_count(r: Readings) -> DataFrame:
    return counts.count(r)


def running_counts(r: Readings, *fields: str, period: str | None = None) -> DataFrame:
    return counts.count_by(r, *fields, period=period, ordered=False)


def running_latest(r: Readings) -> DataFrame:
    return counts.latest(r, ordered=False)


def running_errors(r: Readings, definitions: errors.Definitions = errors.BUILTIN, total: bool = False) -> DataFrame:
    """Readings per error description; ``total`` adds a row for all of them."""
    found = errors.with_error(r, definitions).df.where(F.col("_error").isNotNull())
    names = F.explode(F.array("_error", F.lit(errors.TOTAL))) if total else F.col("_error")
    return found.select(names.alias("description")).groupBy("description").agg(F.count(F.lit(1)).alias("count"))


def running_stats(
    r: Readings, columns: Sequence[str] | str = ("value",), by: Sequence[str] = (), exact: bool = False
) -> DataFrame:
    """``count, min, max, range, mean, stddev, q1, median, q3, iqr`` so far.

    Quartiles come from a sketch; ``exact`` keeps all distinct values of a group in its state.  ``write_stats`` is the way for
    exact ones that needs no state.
    """
    low, high = F.min("measure"), F.max("measure")
    if exact:
        quarts = F.percentile("measure", F.array(*[F.lit(p) for p in stats.QUARTILES]))
    else:
        quarts = F.percentile_approx("measure", list(stats.QUARTILES), SKETCH_ACCURACY)
    keys = [*by, "column"]
    found = stats.measurements(r, columns, by).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), low.alias("min"), high.alias("max"), (high - low).alias("range"),
        F.avg("measure").alias("mean"), F.coalesce(F.stddev_samp("measure"), F.lit(0.0)).alias("stddev"), quarts.alias("_q"),
    )
    q = F.col("_q")
    return found.select(
        *keys, "count", "min", "max", "range", "mean", "stddev", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
        (q[2] - q[0]).alias("iqr"),
    )


def running_unique(r: Readings, watermark: tuple[str, str] | None = None) -> Readings:
    """First copy of identical readings.

    With a ``watermark`` (an event time column and a delay) copies are told within the delay, and older readings leave the state.
    Without, all distinct readings stay in the state; ``write_unique`` is the exact way that needs none.
    """
    keys = content(r)
    if r.is_raw:
        df, names = r.df.withColumn("_content", keys[0]), ["_content"]
    else:
        df, names = r.df, list(r.columns.values())
    if watermark is None:
        df = df.dropDuplicates(names)
    else:
        df = df.withWatermark(*watermark).dropDuplicatesWithinWatermark(names)
    return r.with_df(df.drop("_content") if r.is_raw else df)


def running_filter(r: Readings, spec: FilterSpec, watermark: tuple[str, str] | None = None) -> Readings:
    """A filter on a stream; uniqueness is kept in the stream's state."""
    kept = apply_filter(r, replace(spec, unique=False))
    return running_unique(kept, watermark) if spec.unique else kept


# -- keeping results -------------------------------------------------------------------------------------------


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished state of a running result."""
    found = Kept(spark, path).read()
    if found is None:
        raise FileNotFoundError(f"no finished version in {path}")
    return found


def write_running(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, keys: Sequence[str] | None = None):
    """Start a query which keeps the result so far (``read_latest``).

    With the ``keys`` of the result, a micro-batch writes the rows that it changed; without, the whole result.  A repeated
    batch finds its version finished or writes it anew, so the result survives failures.
    """
    kept = Kept(df.sparkSession, path, keys or ())

    def write(batch: DataFrame, batch_id: int) -> None:
        kept.write(batch, batch_id)

    writer = df.writeStream.outputMode("update" if keys else "complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def write_stats(
    r: Readings, path: str, checkpoint: str, columns: Sequence[str] | str = ("value",), by: Sequence[str] = (), trigger: dict | None = None
):
    """Start a query for exact statistics (``read_stats``): it keeps how often each value occurred, on the store.

    The stream itself has no state, and a micro-batch writes the counts of its own values.
    """
    keys = [*by, "column"]
    kept = Kept(r.df.sparkSession, path, [*keys, "measure"])

    def update(batch: DataFrame, batch_id: int) -> None:
        if kept.finished(batch_id):
            return
        found = folded(stats.measurements(in_order(r, batch), columns, by), keys, "measure")
        before = kept.read(batch_id)
        if before is not None:
            old = before.withColumnRenamed("_c", "_old")
            found = found.join(old, [*keys, "measure"], "left").select(
                *keys, "measure", (F.col("_c") + F.coalesce("_old", F.lit(0))).alias("_c"))
        kept.write(found, batch_id)

    writer = r.df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """All value measures so far, exactly; quartiles are ranked by ranges like those of a batch."""
    counted = read_latest(spark, path)
    return stats.summary_of(counted, [c for c in counted.columns if c not in ("measure", "_c")])


def write_unique(r: Readings, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that keeps the first copy of each reading, exactly and without state: what was seen is on the store.

    Seen readings are known by 128 bits of their content.  ``read_unique`` gives the readings kept so far.
    """
    spark = r.df.sparkSession
    seen = Kept(spark, f"{path}/seen", ("h1", "h2"))

    def update(batch: DataFrame, batch_id: int) -> None:
        if seen.finished(batch_id):
            return
        found = unique(in_order(r, batch))
        parts = content(found)
        hashed = found.df.withColumns({"h1": F.xxhash64(F.lit(1), *parts), "h2": F.xxhash64(F.lit(2), *parts)})
        before = seen.read(batch_id)
        if before is not None:
            hashed = hashed.join(before.select("h1", "h2"), ["h1", "h2"], "left_anti")
        rows = version_path(f"{path}/rows", batch_id)
        hashed.write.mode("overwrite").parquet(rows)
        seen.write(spark.read.schema(hashed.schema).parquet(rows).select("h1", "h2", F.lit(batch_id).alias("since")), batch_id)

    writer = r.df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_unique(spark: SparkSession, path: str, like: Readings) -> Readings:
    """The readings that ``write_unique`` has kept in finished batches."""
    newest = Kept(spark, f"{path}/seen").newest()
    if newest is None:
        raise FileNotFoundError(f"no finished version in {path}")
    rows = spark.read.parquet(f"{path}/rows").where(F.col("version") <= newest.version)
    return replace(like, df=rows.drop("version", "h1", "h2"))


def write_rows(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query which appends the rows of a stream to Parquet files."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
