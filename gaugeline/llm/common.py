"""What the operators share: tables, columns, shipping code to executors, scratch tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

_SHIPPED = "_gaugeline_shipped"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows here are whole texts, so an Arrow batch has at most so many, and ends once it has so many bytes.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context; Spark's own file server distributes it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    # Plans run after the operator has returned them, so the bound has to stay in the session.
    given = spark.conf.get(_BATCH_BYTES)
    if not given.rstrip("b").isdigit() or not 0 < int(given.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.join(top, "gaugeline")
    archive = os.path.join(tempfile.mkdtemp(prefix="code-"), "gaugeline_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, top))
    context.addPyFile(archive)
    setattr(context, _SHIPPED, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, so that further columns of any name cannot clash; a null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(x) for x in more],
    )


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files of steps that are done
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_at = path
    return found


def discard(df: DataFrame) -> None:
    """Remove a table made by ``saved`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """Fewer rows per Arrow batch while actions run inside, for rows that carry whole texts."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
