"""Readings as JSON lines, CSV or Parquet.  A sink writes a directory, one file per task."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_scalar, json_string
from ..model import Readings
from ..operators.columns import widen


def json_line(r: Readings, compact: bool = False) -> Column:
    """``[ { "a": 1, "b": "x" } ]``: keys sorted, numbers, booleans and null bare, missing fields left out."""
    blank = "" if compact else " "
    if r.is_raw:

        def pair(entry: Column) -> Column:
            return F.concat(json_string(entry["key"]), F.lit(":" + blank), json_scalar(entry["value"]))

        body = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), pair), "," + blank)
    else:
        # NULL, for a missing field, is skipped by concat_ws.
        pairs = [
            F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":" + blank), _typed_scalar(r, name)) for name in sorted(r.columns)
        ]
        body = F.concat_ws("," + blank, *pairs)
    return F.concat(F.lit("[" + blank + "{" + blank), body, F.lit(blank + "}" + blank + "]"))


def _typed_scalar(r: Readings, name: str) -> Column:
    text = r.field(name)
    bare = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
    return text if isinstance(r.type_of(name), bare) else F.when(text.isNotNull(), json_scalar(text))


def rendered_json(r: Readings, compact: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    return r.df.select(*keep, json_line(r, compact).alias("line"))


def write_json(r: Readings, path: str, compact: bool = False, mode: str = "errorifexists") -> None:
    rendered_json(r, compact).withColumnRenamed("line", "value").write.mode(mode).text(path)


def write_csv(r: Readings, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header in every file; a missing field is blank."""
    write_result_csv(widen(r, columns), path, mode)


def write_parquet(r: Readings, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """Columnar export: all columns text, names sorted, missing as the empty string."""
    wide = widen(r, columns)
    wide.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in wide.columns]).write.mode(mode).parquet(path)


def write_result_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A result table (counts, distinct values, latest, ...) as CSV."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
    # Blanks around a value are part of it.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_result_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A result table as JSON lines."""
    df.write.mode(mode).json(path)
