from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugeline import ErrorDefinition, FilterSpec, Query, Readings, Update
from gaugeline.operators import tail
from gaugeline.operators.errors import definition_table, list_errors, summarise_errors, with_error
from gaugeline.operators.filters import apply_filter, reject_reasons
from gaugeline.operators.unique import unique
from gaugeline.operators.updates import apply_updates

from .helpers import fields, raw, values

ROWS = [
    {"id": 1, "sensor": "ds18b20", "value": "22.5", "sensor_id": "s1", "timestamp": "2024-05-01"},
    {"id": 2, "sensor": "DS18B20", "value": "85", "sensor_id": "null", "timestamp": "2024-06-01T12:00:00"},
    {"id": 3, "sensor": "dht22", "value": "", "sensor_id": "s3", "timestamp": "1719792000"},
    {"id": 4, "sensor": "dht22", "sensor_id": "s\x00", "timestamp": ""},
    {"id": 5, "sensor": "x", "value": "null"},
]
IDS = {"1", "2", "3", "4", "5"}
SPECS = {
    "dates": (FilterSpec().dates("2024-05-01", "2024-06-01"), {"1", "2"}),
    "from": (FilterSpec().dates(low=1717243200), {"2", "3"}),
    "no bound": (FilterSpec().dates(0, 0), IDS),
    "not empty": (FilterSpec().require("value"), {"1", "2", "5"}),
    "not null": (FilterSpec().forbid_null("sensor_id", "value"), {"1", "3"}),
    "only": (FilterSpec().only_value("sensor", "dht22", "x").only_value("sensor_id", "s3"), {"3"}),
    "exclude": (FilterSpec().exclude_value("value", "85", "").exclude_value("sensor", "x"), {"1", "4"}),
    "allowed": (FilterSpec().allow("sensor_id", [" s1", "s3 ", ""]).only_value("sensor", "dht22"), {"3"}),
    "errors": (FilterSpec().without_errors(), {"1", "3", "4", "5"}),
    "clean": (FilterSpec().clean(), {"1"}),
    "none": (FilterSpec(), IDS),
}


@pytest.mark.parametrize("name", SPECS)
def test_kept_and_rejected_are_complements(spark, name):
    spec, wanted = SPECS[name]
    r = raw(spark, ROWS)
    assert {f["id"] for f in fields(apply_filter(r, spec))} == wanted
    assert {f["id"] for f in fields(apply_filter(r, spec.rejects()))} == IDS - wanted
    assert {x["fields"]["id"] for x in reject_reasons(r, spec).df.collect()} == IDS - wanted


def test_first_reason_is_the_first_failed_filter(spark):
    spec = FilterSpec().require("value").exclude_value("sensor", "dht22").without_errors()
    found = {x["fields"]["id"]: (x["reason"], len(x["reasons"])) for x in reject_reasons(raw(spark, ROWS), spec).df.collect()}
    assert found == {"2": ("error reading", 1), "3": ("empty or missing: value", 2), "4": ("empty or missing: value", 2)}


def test_tables_of_allowed_values(spark):
    r = raw(spark, ROWS)
    table = spark.createDataFrame([("s1",), (" s3 ",), ("s1",), ("",)], "v string")
    spec = FilterSpec().allow("sensor_id", table)
    assert {f["id"] for f in fields(apply_filter(r, spec))} == {"1", "3"}
    assert {f["id"] for f in fields(apply_filter(r, spec.rejects()))} == {"2", "4", "5"}
    assert fields(apply_filter(r, FilterSpec().allow("sensor_id", table.where("v = ''")))) == []
    with pytest.raises(ValueError):
        FilterSpec().allow("sensor_id", [" ", ""])


def test_unique_keeps_the_first_copy_whatever_the_key_order(spark):
    r = raw(spark, [{"a": 1, "b": 2}, {"b": 1}, {"b": 2, "a": 1}, {"a": 3}])
    assert fields(unique(r)) == [{"a": "1", "b": "2"}, {"b": "1"}, {"a": "3"}]
    assert [x["row"] for x in unique(r, keep="last").df.orderBy("row").collect()] == [1, 2, 3]


def test_unique_per_source(spark):
    one, two = raw(spark, [{"a": 1}, {"a": 1}], "one"), raw(spark, [{"a": 1}], "two")
    both = one.with_df(one.df.unionByName(two.df))
    assert unique(both).df.count() == 1
    assert unique(both, "source").df.count() == 2
    with pytest.raises(ValueError):
        unique(both, "file")


def test_unique_looks_before_updates_and_rejects_hide_copies(spark):
    r = raw(spark, values([1, 2, 1]) + values([85, 85]))
    q = Query(r).where(FilterSpec().without_errors().once()).update(Update("value", "2", "value", "1"))
    assert [f["value"] for f in fields(q.result())] == ["1", "1"]
    assert [f["value"] for f in fields(q.rejected())] == ["85"]


def test_updates(spark):
    r = raw(spark, [{"sensor": "ds18b20"}, {"sensor": "dht22", "unit": ""}, {"sensor": "ds18b20", "unit": "F"}])
    q = Query(r).update(Update("sensor", "ds18b20", "unit", "C"))
    assert [f.get("unit") for f in fields(q.result())] == ["C", "", "C"]
    empty = Query(r).update(
        Update("sensor", "ds18b20", "unit", "C", only_when_empty=True), Update("sensor", "dht22", "unit", "%", True),
        Update("unit", "C", "seen", "yes"),
    )
    assert fields(empty.result()) == [
        {"sensor": "ds18b20", "unit": "C", "seen": "yes"}, {"sensor": "dht22", "unit": "%"}, {"sensor": "ds18b20", "unit": "F"},
    ]


def test_updates_see_typed_columns(spark):
    df = spark.createDataFrame([(1, 85, "a"), (2, 7, "b")], "n bigint, value int, sensor string")
    r = Readings.typed(df, ["value", "sensor"], ["n"])
    found = Query(r).update(Update("value", "85", "value", ""), Update("value", "", "note", "gone")).transform()
    assert sorted(map(tuple, found.select("value", "sensor", "note").collect())) == [("", "a", "gone"), ("7", "b", None)]


def test_error_matching(spark):
    rows = values(["85", "85.0", "-127", "22"]) + [
        {"sensor": "DS18B20", "temperature": "85"}, {"type": "ds18b20", "value": "85"}, {"sensor": "other", "value": "85"},
    ]
    r = raw(spark, rows)
    found = [x["_error"] for x in with_error(r).df.orderBy("row").collect()]
    assert [bool(x) for x in found] == [True, False, True, False, True, False, False]
    listed = list_errors(r).orderBy("row").collect()
    assert [(x["row"], x["value"], x["temperature"]) for x in listed] == [(0, "85", None), (2, "-127", None), (4, None, "85")]
    assert listed[0]["description"] == "DS18B20 communication error (value=85)"


def test_the_first_definition_wins_in_both_forms(spark):
    definitions = [
        ErrorDefinition("a", "value", "1", "first"), ErrorDefinition("A", "value", "1", "second"),
        ErrorDefinition("a", "code", "9", "code"), ErrorDefinition("b", "code", "9", "b code"), ErrorDefinition("b", "value", "1", "b value"),
    ]
    r = raw(spark, [{"sensor": "A", "value": 1, "code": 9}, {"sensor": "b", "value": 1, "code": 9}, {"sensor": "a", "code": 9}, {"value": 1}])
    wanted = ["first", "b code", "code", None]
    assert [x["_error"] for x in with_error(r, definitions).df.orderBy("row").collect()] == wanted
    table = definition_table(spark, definitions)
    assert [x["_error"] for x in with_error(r, table).df.orderBy("row").collect()] == wanted
    assert with_error(r, table.where("false")).df.where("_error is not null").count() == 0


def test_updates_leave_other_columns_alone(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, s string, t string")
    r = Readings.typed(df, {"sensor": "s", "source": "s"}, ["id"])
    out = apply_updates(r, [Update("sensor", "a", "id", "9"), Update("sensor", "a", "sensor", "new")])
    got = out.df.select("id", out.field("sensor"), out.field("source"), out.field("id")).orderBy("id").collect()
    assert [tuple(x) for x in got] == [(1, "new", "a", "9"), (2, "b", "b", None)]


@pytest.mark.parametrize("bound", ["2024-13-01", "garbage", "2024-01-01 25:99:99", "9" * 30])
def test_unreadable_bounds_are_refused(spark, bound):
    with pytest.raises(ValueError):
        apply_filter(raw(spark, ROWS), FilterSpec().dates(bound, None))


def test_error_summary(spark):
    r = raw(spark, values(["85", "85", "-127", "20", "85", "-127", "21"]))
    assert [tuple(x) for x in summarise_errors(r).collect()] == [
        ("DS18B20 communication error (value=85)", 3), ("DS18B20 disconnected or power-on reset (value=-127)", 2), ("(total)", 5),
    ]
    assert summarise_errors(raw(spark, values(["1"]))).count() == 0


def test_last_matching_readings(spark):
    rows = values(["20", "21", "22", "23", "24"]) + [{"sensor": "dht22", "value": v} for v in ("50", "55", "60")]
    r = raw(spark, rows)

    def last(sensor, n, spec=None):
        return [f["value"] for f in fields(tail.tail_column_value(r, "sensor", sensor, n, spec))]

    assert last("ds18b20", 2) == ["23", "24"]
    assert last("dht22", 1) == ["60"]
    assert last("ds18b20", 99) == ["20", "21", "22", "23", "24"]
    assert last("none", 3) == []
    bad = raw(spark, values(["20", "85", "22", "23"]))
    found = tail.tail_column_value(bad, "sensor", "ds18b20", 3, FilterSpec().without_errors())
    assert [f["value"] for f in fields(found)] == ["20", "22", "23"]
    copies = raw(spark, values(["1", "2", "1", "3"]))
    found = tail.tail_column_value(copies, "sensor", "ds18b20", 2, FilterSpec().once())
    assert [x["row"] for x in found.df.orderBy("row").collect()] == [2, 3]


def test_date_filters_reach_the_file_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    r = Readings.typed(df, {"sensor_id": "user_id", "timestamp": "ts", "value": "value"}, ["event_id"])
    plan = apply_filter(r, FilterSpec().dates("2024-01-05", "2024-01-06").only_value("sensor_id", "7")).df
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = plan.select("value")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text and "EqualTo(user_id" in text
    assert "props" not in text
    low, high = F.to_timestamp_ntz(F.lit("2024-01-05")), F.to_timestamp_ntz(F.lit("2024-01-07"))
    assert plan.count() == df.where((F.col("ts") >= low) & (F.col("ts") < high) & (F.col("user_id") == 7)).count()
