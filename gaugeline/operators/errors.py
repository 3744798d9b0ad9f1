"""Known error codes: which readings are errors, and why.

A definition says that a sensor type (compared ignoring case) reporting a certain text in a certain field is
an error.  Definitions are an ordered list, or a table of any size; the first match wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Readings

TOTAL = "(total)"

TABLE = "sensor string, field string, value string, description string, rank bigint"


@dataclass(frozen=True)
class ErrorDefinition:
    sensor: str
    field: str
    value: str
    description: str


# The definitions used when none are given.
BUILTIN = (
    ErrorDefinition("ds18b20", "value", "85", "DS18B20 communication error (value=85)"),
    ErrorDefinition("ds18b20", "value", "-127", "DS18B20 disconnected or power-on reset (value=-127)"),
    ErrorDefinition("ds18b20", "temperature", "85", "DS18B20 communication error (temperature=85)"),
    ErrorDefinition("ds18b20", "temperature", "-127", "DS18B20 disconnected or power-on reset (temperature=-127)"),
)


def _folded(r: Readings, definitions: Sequence[ErrorDefinition]) -> Column:
    """CASE per sensor type around CASE per code.

    Codes of one sensor type keep their order, and no reading has two types, so the first match is kept.
    """
    by_sensor: dict[str, list[ErrorDefinition]] = {}
    for d in definitions:
        by_sensor.setdefault(d.sensor.lower(), []).append(d)
    sensor = F.lower(r.field("sensor"))
    result = None
    for name, codes in by_sensor.items():
        inner = None
        for d in codes:
            test = r.equals_any(d.field, [d.value])
            inner = F.when(test, F.lit(d.description)) if inner is None else inner.when(test, F.lit(d.description))
        result = F.when(sensor == name, inner) if result is None else result.when(sensor == name, inner)
    return result if result is not None else F.lit(None).cast("string")


Definitions = Sequence[ErrorDefinition] | DataFrame


def definition_table(spark: SparkSession, definitions: Sequence[ErrorDefinition]) -> DataFrame:
    """A list as a table; ``rank`` keeps its order."""
    return spark.createDataFrame([(d.sensor, d.field, d.value, d.description, i) for i, d in enumerate(definitions)], TABLE)


def with_error(r: Readings, definitions: Definitions = BUILTIN, name: str = "_error") -> Readings:
    """Add a column with the description of the reading's error, NULL for good readings.

    A list is folded into an expression.  A table of any size (``sensor, field, value, description, rank``) is joined, once for
    each field that it names; the names of these fields are read at once.
    """
    if not isinstance(definitions, DataFrame):
        return r.with_df(r.df.withColumn(name, _folded(r, list(definitions))))
    fields = sorted(x["field"] for x in definitions.select("field").distinct().collect())
    if not fields:
        return r.with_df(r.df.withColumn(name, F.lit(None).cast("string")))
    df, found = r.df, []
    for i, field_name in enumerate(fields):
        sensor, value, hit = f"_sensor{i}", f"_value{i}", f"_hit{i}"
        codes = definitions.where(F.col("field") == field_name).groupBy(F.lower("sensor").alias(sensor), F.col("value").alias(value)).agg(
            F.min(F.struct("rank", "description")).alias(hit))
        df = (
            df.withColumn(sensor, F.lower(r.field("sensor"))).withColumn(value, r.field(field_name))
            .join(codes, [sensor, value], "left").drop(sensor, value)
        )
        found.append(hit)
    first = F.least(*found) if len(found) > 1 else F.col(found[0])
    return r.with_df(df.withColumn(name, first["description"]).drop(*found))


LISTED_FIELDS = ("sensor", "sensor_id", "name", "value", "temperature")


def list_errors(r: Readings, definitions: Definitions = BUILTIN) -> DataFrame:
    """The error readings: their place, the fields that identify them and the description."""
    marked = with_error(r, definitions)
    place = [c for c in ("source", "line_no", *r.order) if c in r.df.columns]
    place = list(dict.fromkeys(place))
    fields = [r.field(c).alias(c) for c in LISTED_FIELDS]
    return marked.df.where(F.col("_error").isNotNull()).select(*place, *fields, F.col("_error").alias("description"))


def summarise_errors(r: Readings, definitions: Definitions = BUILTIN, total: bool = True) -> DataFrame:
    """Readings per error description, ascending, with a closing total row."""
    counts = (
        with_error(r, definitions).df.where(F.col("_error").isNotNull())
        .groupBy(F.col("_error").alias("description")).agg(F.count(F.lit(1)).alias("count"))
    )
    if not total:
        return counts.orderBy("description")
    rolled = counts.rollup("description").agg(F.sum("count").alias("count"), F.grouping("description").alias("_last"))
    described = F.when(F.col("_last") == 1, F.lit(TOTAL)).otherwise(F.col("description"))
    return (
        rolled.where(F.col("count").isNotNull()).orderBy("_last", "description")
        .select(described.alias("description"), "count")
    )
