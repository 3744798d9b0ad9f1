"""Readings from CSV files, each with its own header."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import FileSet
from .lines import place, scan_lines

BAD = "_bad"
# Stands for NULL in the scan, so that an empty field is not taken for one.
NO_NULL = "\x01\x02"
FIELD = r'(?s)(?:^|,)(?:"(?:[^"]|"")*+"|[^,"]*+)'


def header_names(line: str) -> list[str]:
    line = line.rstrip("\r\n")
    return next(csv.reader(io.StringIO(line)), []) if line else []


def headers(spark: SparkSession, files: FileSet, csv_only: bool | None) -> list[tuple[str, bool, list[str]]]:
    """Header line, "a quoted field may contain a newline", and files, per distinct combination (an action).

    Looks at the lines once.  A file in which every line has an even number of quotes has no field that spans
    lines, so it can be split; only files that fail this test are read in one piece.
    """
    lines = scan_lines(spark, files, csv_only)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per_file = lines.groupBy("source").agg(
        F.min_by("value", F.struct("block", "row")).alias("header"), F.max(quotes % 2 == 1).alias("spans")
    )
    groups = per_file.groupBy("header", "spans").agg(F.collect_list("source").alias("files"))
    return [(g["header"], g["spans"], sorted(g["files"])) for g in groups.collect()]


def fields_map(names: list[str]) -> Column:
    """Map of the row; a short row lacks its last columns, and the first of equal names wins."""
    index = {}
    for i, name in enumerate(names):
        index.setdefault(name, i)
    carriage = F.lit("\r")

    def value(i: int) -> Column:
        return F.replace(F.coalesce(F.col(f"c{i}"), F.lit("")), carriage, F.lit(""))

    present = F.size(F.regexp_extract_all(F.col(BAD), F.lit(FIELD), F.lit(0)))
    keys = F.array(*[F.lit(n) for n in index])
    full = F.map_from_arrays(keys, F.array(*[value(i) for i in index.values()]))
    short = F.map_from_arrays(keys, F.array(*[F.when(present > i, value(i)) for i in index.values()]))
    return F.when(F.col(BAD).isNull(), full).otherwise(F.map_filter(short, lambda _, v: v.isNotNull()))


def _fields_of(line: Column) -> Column:
    """The fields of a line without the quotes around them; a doubled quote inside is one."""
    found = F.regexp_extract_all(F.regexp_replace(line, r"\r\z", ""), F.lit(FIELD), F.lit(0))

    def plain(field: Column, i: Column) -> Column:
        text = F.when((i > 0) | field.startswith(","), F.substring(field, 2, (1 << 31) - 1)).otherwise(field)
        inner = F.replace(F.regexp_replace(text, '(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
        return F.when(text.startswith('"'), inner).otherwise(text)

    return F.transform(found, plain)


def parse_csv_lines(lines: DataFrame) -> DataFrame:
    """Replace ``value`` by ``pos, fields``, the first line of each file being its header.

    For whole files read as text lines, in which no field spans lines.
    """
    places = [c for c in lines.columns if c != "value"]
    heads = lines.where("block = 0").groupBy("source").agg(F.min("row").alias("_first"))
    names = lines.join(heads, "source").where((F.col("block") == 0) & (F.col("row") == F.col("_first"))).select(
        "source", "_first", _fields_of(F.col("value")).alias("_names"))
    data = lines.join(names, "source").where(((F.col("block") > 0) | (F.col("row") > F.col("_first"))) & (F.col("value") != ""))
    cells = data.select(*places, "_names", _fields_of(F.col("value")).alias("_cells"))
    count = F.least(F.size("_names"), F.size("_cells"))
    keys = F.slice("_names", F.lit(1), count)
    entries = F.filter(F.arrays_zip(keys.alias("key"), F.slice("_cells", F.lit(1), count).alias("value")), lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return cells.where(F.size("_names") > 0).select(*places, F.lit(0).alias("pos"), F.map_from_entries(entries).alias("fields"))


def configured(reader, names: list[str], spans: bool):
    """Schema and options for rows under these names, on a batch or a stream reader."""
    columns = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    return (
        reader.schema(T.StructType([*columns, T.StructField(BAD, T.StringType())]))
        .option("header", True).option("enforceSchema", True).option("multiLine", spans)
        .option("quote", '"').option("escape", '"').option("nullValue", NO_NULL).option("emptyValue", "")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
        .option("maxColumns", max(20480, len(names) + 1)).option("ignoreMissingFiles", "true")
    )


def _read_group(spark: SparkSession, header: str, spans: bool, paths: list[str]) -> DataFrame | None:
    names = header_names(header)
    if not names:
        return None
    rows = configured(spark.read, names, spans).csv(paths).select("*", *place())
    return rows.select("source", "block", "row", F.lit(0).alias("pos"), fields_map(names).alias("fields"))


def read_csv(spark: SparkSession, files: FileSet, csv_only: bool | None = None) -> DataFrame | None:
    """``source, block, row, pos, fields``; None when there is no CSV file with a header."""
    groups = [_read_group(spark, *group) for group in headers(spark, files, csv_only)]
    groups = [g for g in groups if g is not None]
    return reduce(DataFrame.unionByName, groups) if groups else None
