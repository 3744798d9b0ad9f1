"""Membership of a text column in a table of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned_values(table: DataFrame) -> DataFrame:
    """Distinct trimmed non-blank values of the first column, as ``_value``."""
    value = F.trim(F.col(f"`{table.columns[0]}`").cast("string"), F.lit(" \t\r\n"))
    return table.select(value.alias("_value")).where(F.col("_value") != "").distinct()


def refusing_empty(values: DataFrame) -> DataFrame:
    """``_value`` as it is; running it fails when there are none, so that an empty file does not reject everything."""
    nothing = values.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 0)
    refused = F.raise_error(F.lit("empty list of allowed values")).cast("string")
    return values.union(nothing.select(F.when(F.col("_n") == 0, refused).alias("_value")))


def flag_in(df: DataFrame, key: Column, table: DataFrame, name: str) -> DataFrame:
    """Add the BOOLEAN column ``name``: is ``key`` among the values of ``table``?  None are in an empty table.

    A plain join: adaptive execution sends a small table to all tasks and splits a value that many readings share.
    """
    values = cleaned_values(table).withColumn(name, F.lit(True))
    joined = df.withColumn("_value", key).join(values, "_value", "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(False))).drop("_value")


def keep_in(df: DataFrame, key: Column, table: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among the values of ``table``."""
    return df.withColumn("_value", key).join(cleaned_values(table), "_value", "left_semi").drop("_value")
