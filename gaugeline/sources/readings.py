"""Reading logs of readings, and keeping parsed ones."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import UTC, day_label
from ..model import Readings
from ..operators.errors import BUILTIN, Definitions
from ..operators.errors import list_errors as errors_of
from ..operators.lookup import cleaned_values, refusing_empty
from ..operators.tail import tail_rows
from .csv_files import read_csv
from .files import FileSet, collect_files, exists
from .json_lines import malformed_lines, parse_lines
from .lines import block_offsets, scan_lines

FORMATS = ("auto", "json", "csv")
EMPTY = "source string, block bigint, row bigint, pos int, fields map<string,string>"


# The partition column of staged tables.
DAY = "_day"


@dataclass(frozen=True)
class Log:
    """Files of readings: JSON lines, CSV, or (``auto``) CSV where the name ends in ``.csv`` and JSON elsewhere."""

    spark: SparkSession
    files: FileSet
    format: str = "auto"
    tz: str = UTC
    strict: bool = False

    def _csv_filter(self, csv: bool) -> bool | None:
        return csv if self.format == "auto" else None

    def json_lines(self) -> DataFrame:
        """Unparsed lines of the JSON files."""
        files = FileSet() if self.format == "csv" else self.files
        return scan_lines(self.spark, files, self._csv_filter(False))

    def _csv_rows(self) -> DataFrame | None:
        if self.format == "json" or self.files.is_empty:
            return None
        return read_csv(self.spark, self.files, self._csv_filter(True))

    def _frame(self, json: DataFrame | None, csv: DataFrame | None) -> Readings:
        frames = [f for f in (json, csv) if f is not None]
        df = reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], EMPTY)
        return Readings(df, tz=self.tz, strict=self.strict)

    def _parsed(self, lines: DataFrame) -> DataFrame | None:
        return None if self.format == "csv" or self.files.is_empty else parse_lines(lines)

    def readings(self) -> Readings:
        return self._frame(self._parsed(self.json_lines()), self._csv_rows())

    def tail(self, n: int) -> Readings:
        """Readings in the last n lines of each JSON file and in the last n records of each CSV file."""
        order = ["source", "block", "row"]
        lines = tail_rows(self.json_lines(), ["source"], order, n)
        csv = self._csv_rows()
        return self._frame(self._parsed(lines), None if csv is None else tail_rows(csv, ["source"], order, n))

    def malformed(self) -> DataFrame:
        """Lines that could not be read: ``source, block, row, value``."""
        return malformed_lines(self.json_lines())

    def numbered(self, df: DataFrame) -> DataFrame:
        """Add ``line_no`` (1-based, blank lines count; for CSV the number of the record, the header being 1)."""
        places = block_offsets(self.json_lines()).withColumn("_header", F.lit(0))
        csv = self._csv_rows()
        if csv is not None:
            places = places.unionByName(block_offsets(csv).withColumn("_header", F.lit(1)))
        number = F.col("before") + (F.col("row") - F.col("first_row")) + F.lit(1) + F.col("_header")
        joined = df.join(places, ["source", "block"])
        return joined.withColumn("line_no", number).drop("before", "first_row", "_header")


def list_errors(log: Log, definitions: Definitions = BUILTIN) -> DataFrame:
    """The error readings of a log with the numbers of their lines."""
    r = log.readings()
    return errors_of(r.with_df(log.numbered(r.df)), definitions)


def open_log(
    spark: SparkSession, paths: str | Sequence[str], format: str = "auto", recursive: bool = False,
    extension: str | None = None, max_depth: int | None = None, tz: str = UTC, strict: bool = False,
) -> Log:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}")
    return Log(spark, collect_files(spark, paths, recursive, extension, max_depth), format, tz, strict)


def read_readings(spark: SparkSession, paths: str | Sequence[str], **options) -> Readings:
    return open_log(spark, paths, **options).readings()


def stage(r: Readings, path: str, mode: str = "errorifexists") -> Readings:
    """Write parsed readings once as Parquet by day and return them from there.

    Saves parsing the text again in every query, and lets date filters skip whole days.
    """
    spark = r.df.sparkSession
    staged = r.df.withColumn("_epoch", r.timestamp())
    staged = staged.withColumn(DAY, day_label(F.col("_epoch"), r.tz)).drop("_epoch")
    # Rebalancing splits a day with much data over many tasks and puts small days together.
    staged.hint("rebalance", F.col(DAY)).write.mode(mode).partitionBy(DAY).parquet(path)
    return staged_readings(spark, path, r)


def staged_readings(spark: SparkSession, path: str, like: Readings) -> Readings:
    """``like``'s columns and the day of each partition, by which date filters skip whole days."""
    return replace(like, df=spark.read.parquet(path).select(*like.df.columns, DAY), day=DAY)


def allowed_values(spark: SparkSession, values: str) -> list[str] | DataFrame:
    """A comma separated list, or the name of a file with one value per line; neither may be empty."""
    try:
        if values and exists(spark, values):
            return refusing_empty(cleaned_values(spark.read.text(values)))
    except (IllegalArgumentException, Py4JJavaError) as e:
        # A list with a colon is no valid path, or seems to name a file system.  Any other failure is one.
        if not re.search("URISyntaxException|IllegalArgumentException|No FileSystem for scheme", str(e)):
            raise
    found = [v.strip() for v in values.split(",") if v.strip()]
    if not found:
        raise ValueError("empty list of allowed values")
    return found
