"""What the plans of the registered queries must not contain, and that they can all be planned."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from gaugeline.plans import catalogue

EAGER = ("read_", "staged_", "parquet_", "stream_", "results_", "declared_")
BATCH = sorted(n for n in catalogue.QUERIES if not n.startswith(EAGER))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_cross_joins(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    for word in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(catalogue.QUERIES) <= set(driver.queries()) and set(catalogue.ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns[:3] == ["sensor", "column", "count"] and df.count() == 5


@pytest.mark.parametrize("name,columns", [
    ("count_by_column", "event_type:string"), ("latest", "ts:timestamp_ntz,user_id:bigint"),
    ("stats_basic_by_sensor", "user_id:bigint,value:double"), ("stats_deltas", "event_id:bigint,value:double"),
])
def test_scans_read_only_what_is_needed(spark, sf_dir, name, columns):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"ReadSchema: struct<{columns}>" in text


def test_rows_are_never_ordered_in_one_task(spark, sf_dir):
    """Overall changes: the window over readings is partitioned, only slices meet in one task."""
    text = plan(catalogue.QUERIES["stats_deltas"](spark, sf_dir))
    lines = text.splitlines()
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    for i in single:
        assert any("Aggregate" in line for line in lines[i + 1 : i + 6]), "rows reach a single task before they are folded"
    assert any("Window" in line and "_slice0_0" in line for line in lines)
