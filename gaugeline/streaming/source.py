"""Readings from files that keep arriving in a directory.

A file that is still growing is fed through a directory of segments.  Files arrive in the order of their modification times,
then by name; a micro-batch takes the oldest files first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import UTC
from ..model import RAW_ORDER, Readings
from ..sources.csv_files import configured, fields_map, parse_csv_lines
from ..sources.json_lines import parse_lines
from ..sources.lines import ROW_BITS

# Input of one micro-batch; limits what one sensor can bring at once.
MAX_BYTES_PER_TRIGGER = 4 << 30


# The arrival order on a stream: the time a file was written, the file, and the place in it.
STREAM_ORDER = ("arrived", *RAW_ORDER)


def _place() -> list:
    """The place of a split; the row in it is only known inside of a micro-batch (``in_order``)."""
    return [
        F.unix_micros("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"), F.lit(0).cast("bigint").alias("row"),
    ]


def in_order(r: Readings, batch: DataFrame) -> Readings:
    """The readings of one micro-batch with their rows, to be called in ``foreachBatch`` on a batch that was not shuffled.

    A task reads its splits one after the other, so its rows ascend within each split.
    """
    if "arrived" in r.order and "row" in batch.columns:
        batch = batch.withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    if "fields" not in batch.columns and "value" in batch.columns and r.is_raw:
        lines = batch.select(*STREAM_ORDER[:-1], "value")
        csv = F.lower("source").endswith(".csv")
        batch = parse_lines(lines.where(~csv)).unionByName(parse_csv_lines(lines.where(csv)))
    return replace(r, df=batch)


def stream_readings(
    spark: SparkSession, directory: str, format: str = "json", columns: Sequence[str] | None = None,
    recursive: bool = True, max_files: int | None = None, tz: str = UTC, strict: bool = False,
) -> Readings:
    """A streaming frame of raw readings; ``columns`` names the CSV columns.

    With ``auto``, CSV is what ends in ``.csv``, each file has its own header, and lines are parsed per micro-batch (``in_order``);
    so this is for the results that are kept per batch: changes, sampling, last points, exact statistics and unique readings.
    """
    reader = spark.readStream.option("recursiveFileLookup", str(recursive).lower())
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", MAX_BYTES_PER_TRIGGER)
    if format == "json":
        df = parse_lines(reader.text(directory).select(*_place(), "value"))
    elif format == "auto":
        df = reader.text(directory).select(*_place(), F.lit(0).alias("pos"), "value")
    elif format == "csv":
        if not columns:
            raise ValueError("a CSV stream needs the names of its columns")
        rows = configured(reader, list(columns), True).csv(directory).select("*", *_place())
        df = rows.select("arrived", "source", "block", "row", F.lit(0).alias("pos"), fields_map(list(columns)).alias("fields"))
    else:
        raise ValueError(f"unknown format {format!r}")
    return Readings(df, order=STREAM_ORDER, tz=tz, strict=strict)
