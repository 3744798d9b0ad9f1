from __future__ import annotations

from gaugeline import Query
from gaugeline.operators.columns import discover_columns, widen
from gaugeline.sinks import text
from gaugeline.sources.readings import read_readings

from .helpers import fields, raw

ROWS = [
    {"sensor": "a", "value": "22.50", "note": 'x, "y"\nz'}, {"value": "null", "ok": "true", "empty": ""}, {"name": "01", "value": "-1e5"},
]


def test_json_lines(spark):
    lines = [x["line"] for x in text.rendered_json(raw(spark, ROWS)).collect()]
    assert lines == [
        '[ { "note": "x, \\"y\\"\\nz", "sensor": "a", "value": 22.50 } ]', '[ { "empty": null, "ok": true, "value": null } ]',
        '[ { "name": "01", "value": -1e5 } ]',
    ]
    compact = [x["line"] for x in text.rendered_json(raw(spark, ROWS), compact=True).collect()]
    assert compact[2] == '[{"name":"01","value":-1e5}]'


def test_json_round_trip(spark, tmp_path):
    r = raw(spark, ROWS)
    text.write_json(r, str(tmp_path / "out"))
    found = fields(read_readings(spark, str(tmp_path / "out"), format="json"))
    wanted = [dict(x) for x in ROWS]
    wanted[1]["empty"] = "null"
    assert sorted(found, key=lambda f: f["value"]) == sorted(wanted, key=lambda f: f["value"])


def test_csv_round_trip(spark, tmp_path):
    r = raw(spark, ROWS)
    text.write_csv(r, str(tmp_path / "out"))
    found = fields(read_readings(spark, str(tmp_path / "out"), format="csv"))
    names = discover_columns(r)
    assert names == ["empty", "name", "note", "ok", "sensor", "value"]
    wanted = [{n: row.get(n, "") for n in names} for row in ROWS]
    assert sorted(found, key=lambda f: f["value"]) == sorted(wanted, key=lambda f: f["value"])


def test_parquet_export(spark, tmp_path):
    text.write_parquet(raw(spark, ROWS), str(tmp_path / "out"))
    df = spark.read.parquet(str(tmp_path / "out"))
    assert df.columns == ["empty", "name", "note", "ok", "sensor", "value"]
    assert {t for _, t in df.dtypes} == {"string"}
    assert df.where("name = ''").count() == 2


def test_declared_columns(spark):
    wide = widen(raw(spark, ROWS), ["value", "unit"])
    assert [tuple(x) for x in wide.collect()] == [("22.50", None), ("null", None), ("-1e5", None)]


def test_result_tables(spark, tmp_path):
    counts = Query(raw(spark, ROWS)).count_by("sensor")
    text.write_result_csv(counts, str(tmp_path / "csv"))
    text.write_result_json(counts, str(tmp_path / "json"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == [("(missing)", "2"), ("a", "1")]
    assert sorted((x["sensor"], x["count"]) for x in spark.read.json(str(tmp_path / "json")).collect()) == [("(missing)", 2), ("a", 1)]
