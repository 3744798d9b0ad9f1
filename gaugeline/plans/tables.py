"""The given tables as frames of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Readings
from ..operators.errors import ErrorDefinition

# Error codes that occur in the events table.
EVENT_ERRORS = (
    ErrorDefinition("PURCHASE", "k", "85", "comm error"),
    ErrorDefinition("view", "k", "0", "reset"),
    ErrorDefinition("view", "k", "85", "view error"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, k=None) -> Readings:
    """Events as readings; ``k`` optionally rewrites the code taken from ``props``."""
    code = F.regexp_extract("props", r'"k": ([0-9]+)', 1)
    df = table(spark, sf_dir, "events").withColumn("k", code if k is None else k(code))
    mapping = {"sensor_id": "user_id", "sensor": "event_type", "value": "value", "timestamp": "ts", "k": "k"}
    return Readings.typed(df, mapping, ["event_id"])


def orders(spark: SparkSession, sf_dir: str) -> Readings:
    mapping = {
        "sensor_id": "o_custkey", "sensor": "o_orderstatus", "value": "o_totalprice", "timestamp": "o_orderdate",
        "priority": "o_orderpriority",
    }
    return Readings.typed(table(spark, sf_dir, "orders"), mapping, ["o_orderkey"])


def lineitem(spark: SparkSession, sf_dir: str) -> Readings:
    mapping = {
        "sensor_id": "l_partkey", "sensor": "l_returnflag", "quantity": "l_quantity", "price": "l_extendedprice",
        "discount": "l_discount", "tax": "l_tax", "timestamp": "l_shipdate",
    }
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # An order has a handful of lines.
    return Readings.typed(table(spark, sf_dir, "lineitem"), mapping, order, order_depth=1)


def event_rows(r: Readings, *more: str) -> DataFrame:
    """The columns in which event queries are compared."""
    return r.df.select(
        "event_id", r.field("sensor_id").alias("sensor_id"), r.field("sensor").alias("sensor"),
        r.number("value").alias("value"), r.timestamp().alias("timestamp"), r.field("k").alias("k"), *more,
    )
