from __future__ import annotations

import pytest

from gaugeline import FilterSpec, Query
from gaugeline.operators import counts

from .helpers import pairs, raw

LOCATED = [
    {"sensor_id": s, "type": t, "location": loc}
    for s, t, loc in [
        ("sensor1", "temperature", "room1"), ("sensor1", "humidity", "room1"), ("sensor1", "temperature", "room2"),
        ("sensor2", "temperature", "room2"), ("sensor2", "humidity", "room2"), ("sensor3", "temperature", "room1"),
        ("sensor4", "temperature", "room1"), ("sensor5", "humidity", "room3"),
    ]
]


def stamps(*values):
    return [{"timestamp": v} for v in values]


def test_counts_by_field(spark):
    r = raw(spark, LOCATED)
    assert Query(r).count().first()[0] == 8
    by_type = Query(r).where(FilterSpec().allow("sensor_id", ["sensor1", "sensor2", "sensor3"])).count_by("type")
    assert [tuple(x) for x in by_type.collect()] == [("temperature", 4), ("humidity", 2)]
    by_id = Query(r).where(FilterSpec().allow("location", ["room1", "room2"])).count_by("sensor_id")
    assert [tuple(x) for x in by_id.collect()] == [("sensor1", 3), ("sensor2", 2), ("sensor3", 1), ("sensor4", 1)]
    assert Query(r).count_by("sensor_id", "location").count() == 6


def test_missing_and_empty_are_groups(spark):
    r = raw(spark, [{"a": "x"}, {"a": ""}, {"b": 1}, {"a": ""}])
    assert [tuple(x) for x in Query(r).count_by("a").collect()] == [("", 2), ("(missing)", 1), ("x", 1)]
    with pytest.raises(ValueError):
        Query(r).count_by()


@pytest.mark.parametrize("period,values,wanted", [
    ("month", (1704067200, 1704153600, 1706745600), [("2024-01", 2), ("2024-02", 1)]),
    ("day", (1704067200, 1704067260, 1704153600), [("2024-01-01", 2), ("2024-01-02", 1)]),
    ("year", (1704067200, 1704153600, 1672531200), [("2023", 1), ("2024", 2)]),
    ("week", (1704067200, 1704153600, 1704672000), [("2024-W01", 2), ("2024-W02", 1)]),
    ("day", (1704067200, 0, "never", ""), [("(no-date)", 3), ("2024-01-01", 1)]),
])
def test_counts_by_period(spark, period, values, wanted):
    found = counts.count_by_period(raw(spark, stamps(*values)), period)
    assert [tuple(x) for x in found.collect()] == wanted


def test_distinct(spark):
    r = raw(spark, [{"s": v} for v in ("temp1", "temp2", "temp1", "humidity", "")] + [{"t": 1}])
    assert [x[0] for x in Query(r).distinct("s").collect()] == ["humidity", "temp1", "temp2"]
    assert [tuple(x) for x in Query(r).distinct_counts("s").collect()] == [("temp1", 2), ("humidity", 1), ("temp2", 1)]
    dated = raw(spark, [{"s": f"temp{i}", "timestamp": f"2024-0{3 + 2 * i}-15T10:00:00"} for i in range(3)])
    assert [x[0] for x in Query(dated).where(FilterSpec().dates("2024-05-01", "2024-06-01")).distinct("s").collect()] == ["temp1"]


def test_latest(spark):
    rows = [
        {"sensor_id": "sensor1", "timestamp": 1737315600}, {"sensor_id": "sensor2", "timestamp": 1737315650},
        {"sensor_id": "sensor1", "timestamp": 1737315700}, {"sensor_id": "", "timestamp": 5}, {"timestamp": 9},
        {"sensor_id": "old", "timestamp": -3}, {"sensor_id": "sensor3", "timestamp": "2025-01-20"},
    ]
    r = raw(spark, rows)
    assert [tuple(x) for x in Query(r).latest().collect()] == [
        ("sensor1", 1737315700, "2025-01-19 19:41:40"), ("sensor2", 1737315650, "2025-01-19 19:40:50"),
        ("sensor3", 1737331200, "2025-01-20 00:00:00"),
    ]
    assert [x[0] for x in Query(r).latest(1).collect()] == ["sensor1"]
    assert [x[0] for x in Query(r).latest(-2).collect()] == ["sensor2", "sensor3"]
    assert [x[0] for x in Query(r).latest(-9).collect()] == ["sensor1", "sensor2", "sensor3"]


def test_kept_and_rejected_add_up(spark):
    q = Query(raw(spark, LOCATED)).where(FilterSpec().only_value("type", "humidity"))
    assert q.result().df.count() + q.rejected().df.count() == 8
    assert sum(pairs(Query(raw(spark, LOCATED)).count_by("location")).values()) == 8
