"""Text lines with their place in the input.

``source`` is the file, ``block`` the byte where the split with the line starts, ``row`` a number that grows
along the split.  ``source, block, row`` sort like the lines and cost nothing to compute; an actual line number
needs the number of lines of all earlier splits of the file and is only worked out where asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import FileSet

# monotonically_increasing_id counts the rows of a task in its lower 33 bits.
ROW_BITS = 33


def place() -> list:
    """Place columns, to be taken directly at a file scan."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return [
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        row.alias("row"),
    ]


def scan_lines(spark: SparkSession, files: FileSet, csv: bool | None = None) -> DataFrame:
    """``source, block, row, value``."""
    frames = files.scan(spark, lambda reader, paths: reader.text(paths), csv)
    frames = [f.select(*place(), "value") for f in frames]
    if not frames:
        return spark.createDataFrame([], "source string, block bigint, row bigint, value string")
    return reduce(DataFrame.unionByName, frames)


def block_offsets(lines: DataFrame) -> DataFrame:
    """One row per split: ``source, block, first_row, before`` (lines of the file before the split).

    The window is as long as a file has splits.
    """
    blocks = lines.groupBy("source", "block").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint"))
    return blocks.withColumn("before", before).drop("n")
