"""Error definitions from ``<sensor>.errors`` files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators.errors import BUILTIN, Definitions, ErrorDefinition
from .files import exists
from .lines import place

SUFFIX = ".errors"


def error_table(spark: SparkSession, directory: str) -> DataFrame:
    """Lines ``field:value:description``; ``#`` starts a comment line.  A table of any size, for ``with_error``."""
    files = spark.read.option("pathGlobFilter", f"*{SUFFIX}").text(directory)
    lines = files.select(F.col("_metadata.file_name").alias("file"), *place(), trim(F.col("value")).alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", ":", 3)
    rows = lines.where(F.size(parts) == 3).select(
        F.regexp_replace("file", r"\.errors$", "").alias("sensor"), trim(parts[0]).alias("field"),
        trim(parts[1]).alias("value"), trim(parts[2]).alias("description"), "source", "block", "row",
    )
    # A line that ends after the second colon has no description and does not count.
    whole = rows.where((F.col("field") != "") & (F.col("value") != "") & (F.col("description") != ""))
    # Only the order of lines with the same code matters.
    same = Window.partitionBy(F.lower("sensor"), "field", "value").orderBy("source", "block", "row")
    return whole.withColumn("rank", F.row_number().over(same).cast("bigint")).select("sensor", "field", "value", "description", "rank", "source", "block", "row")


def error_definitions(spark: SparkSession, directory: str | None) -> Definitions:
    """The definitions of a configuration directory as a table, whatever their number; the built-in ones when there are none."""
    if directory is None or not exists(spark, directory):
        return BUILTIN
    found = error_table(spark, directory)
    return BUILTIN if found.isEmpty() else found


def load_error_definitions(spark: SparkSession, directory: str | None) -> tuple[ErrorDefinition, ...]:
    """A few definitions as a list to look at or to change; ``error_definitions`` is for any number of them."""
    if directory is None or not exists(spark, directory):
        return BUILTIN
    found = error_table(spark, directory).orderBy("source", "block", "row").collect()
    return tuple(ErrorDefinition(x["sensor"], x["field"], x["value"], x["description"]) for x in found) or BUILTIN
