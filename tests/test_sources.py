from __future__ import annotations

import warnings
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugeline import FilterSpec, Query
from gaugeline.operators import counts
from gaugeline.plans import catalogue_files
from gaugeline.sources.error_definitions import load_error_definitions
from gaugeline.sources.json_lines import parse_lines
from gaugeline.sources.readings import allowed_values, open_log, read_readings, stage
from gaugeline.operators.errors import BUILTIN

from .helpers import raw, fields, write


def test_objects_arrays_and_several_objects_per_line(spark, tmp_path):
    path = write(tmp_path / "a.out", '{"a":1}\n[{"a":2},{"a":3}]\n\n{"a":4},{"a":5}\n{"a":6}{"a":7}\njunk {"a":8} junk\n')
    assert [f["a"] for f in fields(read_readings(spark, path))] == ["1", "2", "3", "4", "5", "6", "7", "8"]


def test_empty_objects_and_lists_give_nothing(spark, tmp_path):
    path = write(tmp_path / "a.out", '[{}]\n[]\n{}\n[ ]\n{"sensor":"a"}\n')
    log = open_log(spark, path)
    assert counts.count(log.readings()).first()[0] == 1
    assert log.malformed().count() == 0


def test_missing_empty_and_null_stay_apart(spark, tmp_path):
    path = write(tmp_path / "a.out", '{"a":null,"b":"","c":"null","d":true,"e":"x"}\n')
    assert fields(read_readings(spark, path)) == [{"a": "null", "b": "", "c": "null", "d": "true", "e": "x"}]


def test_number_text_is_kept(spark, tmp_path):
    texts = ["22.50", "1.50e3", "85.0", "85", "-127", "12345678901234567890", "12345678.25", "0.0001", "-0", "007", "1E5"]
    path = write(tmp_path / "a.out", "".join(f'{{"v": {t}, "s": "a: 1.50, \\"b\\" 2e5"}}\n' for t in texts))
    found = fields(read_readings(spark, path))
    assert [f["v"] for f in found] == texts
    assert {f["s"] for f in found} == {'a: 1.50, "b" 2e5'}


def test_nested_values_are_text(spark, tmp_path):
    path = write(tmp_path / "a.out", '{"o":{"k":1},"l":[1,[2]],"v":"{not}"}\n{"v":"a}{b"}\n')
    assert fields(read_readings(spark, path)) == [{"o": '{"k":1}', "l": "[1,[2]]", "v": "{not}"}, {"v": "a}{b"}]


def test_first_of_equal_keys_wins(spark, tmp_path):
    path = write(tmp_path / "a.out", '{"a":1,"a":2,"b":3}\n')
    assert fields(read_readings(spark, path)) == [{"a": "1", "b": "3"}]
    path = write(tmp_path / "a.csv", "a,a,b\n1,2,3\n")
    assert fields(read_readings(spark, path)) == [{"a": "1", "b": "3"}]


def test_escapes_are_decoded(spark, tmp_path):
    path = write(tmp_path / "a.out", r'{"name":"say \"hi\"","t":"a\tb","u":"é"}' + "\n")
    assert fields(read_readings(spark, path)) == [{"name": 'say "hi"', "t": "a\tb", "u": "é"}]


def test_malformed_lines_are_reported(spark, tmp_path):
    path = write(tmp_path / "a.out", '{"a":1}\n\n{\'a\':tru}\nplain text\n{"a":2}\n[]\n')
    log = open_log(spark, path)
    assert [f["a"] for f in fields(log.readings())] == ["1", "2"]
    bad = log.numbered(log.malformed()).orderBy("line_no").select("line_no", "value").collect()
    assert [tuple(b) for b in bad] == [(3, "{'a':tru}"), (4, "plain text")]


@pytest.mark.parametrize("line, readings", [
    ('{"sensor":"a","value":nan}', [{"sensor": "a", "value": "nan"}]),
    ('{"b":1,}', [{"b": "1"}]),
    ('{"value":-}', [{"value": "-"}]),
    ('{"value":+5}', [{"value": "+5"}]),
    ('{"sensor":"f" "value":2}', [{"sensor": "f", "value": "2"}]),
    (r'{"s":"x\q"}', [{"s": r"x\q"}]),
    ('junk {"g":1} more {"h":2}', [{"g": "1"}, {"h": "2"}]),
    ('[{"good":1},{"value":abc}]', [{"good": "1"}, {"value": "abc"}]),
    ("{'sensor':'q'}", []),
    ('{"a":tru}', [{"a": "tru"}]),
    ('{"a":}', [{"a": ""}]),
    ('{"t":12:30:00,"u":  x y  , ,"n":null}', [{"t": "12:30:00", "u": "x y", "n": "null"}]),
    ('{"v": 007 ,"w":1.50,"a":1,"a":2}', [{"v": "007", "w": "1.50", "a": "1"}]),
    ('{"o":{"k": 1.50, "x":[{"}":2}]},"l":[1, [2]],"b":"[{"}', [{"o": '{"k": 1.50, "x":[{"}":2}]}', "l": "[1, [2]]", "b": "[{"}]),
    ('[[{"n":1}],{"m":2}]', [{"n": "1"}]),
    ('it"s {"a":1}', [{"a": "1"}]),
    ('{oops "a":1} {"b" x : "2"}', [{"a": "1"}, {"b": "2"}]),
    ('{"a":1] "b":2}', [{"a": "1", "b": "2"}]),
    ('{"a":"never ends} {"b":1}', [{"a": "never ends} {"}]),
    (r'{"k\"q":"t\tz\u00e9", x}', [{'k"q': "t\tzé"}]),
    ('{{"a":1}}', [{"a": "1"}]),
])
def test_loose_json(spark, tmp_path, line, readings):
    log = open_log(spark, write(tmp_path / "a.out", line + "\n"))
    assert fields(log.readings()) == readings
    assert log.malformed().count() == (0 if readings else 1)


def test_many_loose_objects_in_a_line(spark, tmp_path):
    line = "[" + ",".join(f'{{"a":nan,"b":{i}}}' for i in range(1000)) + "]"
    assert [f["b"] for f in fields(read_readings(spark, write(tmp_path / "a.out", line)))] == [str(i) for i in range(1000)]


def test_a_cut_off_object_keeps_its_whole_pairs(spark, tmp_path):
    text = '{"a":1.50,"b":"x, \\"y","c":\n[{"a":1},{"a":2,"b":"unfini\n{"a":22.\n{"a":\n'
    log = open_log(spark, write(tmp_path / "a.out", text))
    assert fields(log.readings()) == [{"a": "1.50", "b": 'x, "y'}, {"a": "1"}, {"a": "2"}, {"a": "22."}]


def test_csv_quoting(spark, tmp_path):
    text = 'a,b,c\r\n1,"x,y",2\r\n2,"say ""hi""",3\r\n3,"two\nlines",4\r\n,leading,\r\n'
    found = fields(read_readings(spark, write(tmp_path / "a.csv", text)))
    assert found == [
        {"a": "1", "b": "x,y", "c": "2"}, {"a": "2", "b": 'say "hi"', "c": "3"}, {"a": "3", "b": "two\nlines", "c": "4"},
        {"a": "", "b": "leading", "c": ""},
    ]


def test_csv_short_and_long_rows(spark, tmp_path):
    found = fields(read_readings(spark, write(tmp_path / "a.CSV", 'a,b,c\n1\n1,,\n1,\n1,2,3,4\n"",b,"c"\n')))
    assert found == [
        {"a": "1"}, {"a": "1", "b": "", "c": ""}, {"a": "1", "b": ""}, {"a": "1", "b": "2", "c": "3"},
        {"a": "", "b": "b", "c": "c"},
    ]


def test_each_csv_file_has_its_own_header(spark, tmp_path):
    write(tmp_path / "in" / "1.csv", "sensor,value\na,1\n")
    write(tmp_path / "in" / "2.csv", "value,unit\n2,C\n")
    write(tmp_path / "in" / "3.out", '{"value":3}\n')
    write(tmp_path / "in" / "4.csv", "")
    found = fields(read_readings(spark, str(tmp_path / "in")))
    assert found == [{"sensor": "a", "value": "1"}, {"value": "2", "unit": "C"}, {"value": "3"}]


def test_format_is_chosen_by_name_or_said(spark, tmp_path):
    path = write(tmp_path / "data.txt", "value\n5\n")
    assert fields(read_readings(spark, path)) == []
    assert fields(read_readings(spark, path, format="csv")) == [{"value": "5"}]
    with pytest.raises(ValueError):
        open_log(spark, path, format="xml")


def test_discovery(spark, tmp_path):
    root = tmp_path / "tree"
    for name, v in (("a.out", 1), ("b.txt", 2), ("sub/c.out", 3), ("sub/deep/d.out", 4)):
        write(root / name, f'{{"v":{v}}}\n')

    def found(**options):
        return sorted(f["v"] for f in fields(read_readings(spark, str(root), **options)))

    assert found() == ["1", "2"]
    assert found(extension="out") == ["1"]
    assert found(recursive=True) == ["1", "2", "3", "4"]
    assert found(recursive=True, extension=".out") == ["1", "3", "4"]
    assert found(recursive=True, max_depth=0) == ["1", "2"]
    assert found(recursive=True, max_depth=1) == ["1", "2", "3"]
    named = read_readings(spark, [str(root / "b.txt"), str(root / "sub")], extension=".out")
    assert sorted(f["v"] for f in fields(named)) == ["2", "3"]


def test_missing_files_are_skipped_with_a_warning(spark, tmp_path):
    path = write(tmp_path / "a.out", '{"v":1}\n')
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert fields(read_readings(spark, [path, str(tmp_path / "none.out")])) == [{"v": "1"}]
    assert any("none.out" in str(w.message) for w in caught)


def test_line_numbers_hold_on_split_files(spark, tmp_path):
    lines = ["" if i % 7 == 3 else f'{{"n":{i + 1}}}' for i in range(3000)]
    path = write(tmp_path / "big.out", "\n".join(lines) + "\n")
    write(tmp_path / "big2.out", "\n".join(lines[:100]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        log = open_log(spark, [path, str(tmp_path / "big2.out")])
        r = log.readings()
        assert r.df.select("block").distinct().count() > 5
        found = log.numbered(r.df).select("line_no", F.col("fields")["n"].cast("bigint").alias("n")).collect()
        ordered = r.df.where(F.col("source").endswith("big.out")).orderBy(*r.order).select(F.col("fields")["n"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == sum(1 for x in lines if x) + sum(1 for x in lines[:100] if x)
    assert all(x["line_no"] == x["n"] for x in found)
    numbers = [int(x[0]) for x in ordered]
    assert numbers == sorted(numbers)


def test_csv_record_numbers_count_the_header(spark, tmp_path):
    log = open_log(spark, write(tmp_path / "a.csv", "value\n5\n6\n"))
    found = log.numbered(log.readings().df).select("line_no", F.col("fields")["value"]).orderBy("line_no").collect()
    assert [tuple(x) for x in found] == [(2, "5"), (3, "6")]


def test_tail_counts_lines_of_each_file_before_filters(spark, tmp_path):
    one = write(tmp_path / "1.out", "".join(f'{{"sensor":"ds18b20","value":{v}}}\n' for v in (20, 85, 22, 23)))
    two = write(tmp_path / "2.csv", "sensor,value\nx,1\nx,2\n")
    log = open_log(spark, [one, two])
    assert [f["value"] for f in fields(log.tail(3))] == ["85", "22", "23", "1", "2"]
    assert [f["value"] for f in fields(Query(log.tail(2)).where(FilterSpec().exclude_value("value", "22")).result())] == [
        "23", "1", "2",
    ]
    with pytest.raises(ValueError):
        log.tail(0)


def test_error_definitions(spark, tmp_path):
    write(tmp_path / "e" / "ds18b20.errors", "# comment\n\nvalue:85:comm: error\n value : -127 : gone \nvalue:1\nvalue:2:\n")
    write(tmp_path / "e" / "DHT22.errors", "humidity:255:bad\n")
    write(tmp_path / "e" / "note.txt", "value:3:no\n")
    found = {(d.sensor, d.field, d.value, d.description) for d in load_error_definitions(spark, str(tmp_path / "e"))}
    assert found == {
        ("ds18b20", "value", "85", "comm: error"), ("ds18b20", "value", "-127", "gone"), ("DHT22", "humidity", "255", "bad"),
    }
    (tmp_path / "empty").mkdir()
    assert load_error_definitions(spark, str(tmp_path / "empty")) == BUILTIN
    assert load_error_definitions(spark, str(tmp_path / "nowhere")) == BUILTIN


def test_allowed_list_from_text_or_file(spark, tmp_path):
    assert allowed_values(spark, " a, b ,,c") == ["a", "b", "c"]
    table = allowed_values(spark, write(tmp_path / "list.txt", "a\n\n b \n"))
    path = write(tmp_path / "a.out", '{"s":"a"}\n{"s":"b"}\n{"s":"c"}\n{}\n{"t":1}\n')
    r = read_readings(spark, path)
    assert [f["s"] for f in fields(Query(r).where(FilterSpec().allow("s", table)).result())] == ["a", "b"]
    assert fields(Query(r).where(FilterSpec().allow("s", table)).rejected()) == [{"s": "c"}, {"t": "1"}]
    with pytest.raises(ValueError):
        allowed_values(spark, " , ")
    # A file without values is refused when the query runs, and a file that cannot be looked at is no list.
    nothing = allowed_values(spark, write(tmp_path / "empty.txt", " \n\t\n"))
    with pytest.raises(Exception, match="empty list of allowed values"):
        Query(r).where(FilterSpec().allow("s", nothing)).result().df.collect()
    with pytest.raises(Exception, match="nowhere.invalid|Connection|UnknownHost"):
        allowed_values(spark, "hdfs://nowhere.invalid:1/list.txt")


def test_staged_readings_are_the_same(spark, tmp_path):
    path = write(tmp_path / "a.out", "".join(f'{{"v":{i},"timestamp":{1704067200 + 43200 * i}}}\n' for i in range(9)))
    r = read_readings(spark, path)
    again = stage(r, str(tmp_path / "staged"))
    assert fields(again) == fields(r)
    assert counts.count_by_period(again, "day").collect() == counts.count_by_period(r, "day").collect()


@pytest.mark.parametrize("path, root, levels", [
    ("file:///a/b/f", "/a/b", 0), ("hdfs://nn:8020/a/b/f", "/a/b", 0), ("hdfs://nn:8020/a/b/c/f", "/a/b", 1),
    ("s3a://bucket/a/x/y/f.csv", "/a", 2), ("viewfs://store/a/f", "/", 1), ("/a/b/f", "/a", 1),
])
def test_levels_below(spark, path, root, levels):
    from gaugeline.sources.files import levels_below

    assert spark.range(1).select(levels_below(F.lit(path), root)).first()[0] == levels


@pytest.mark.parametrize("text, values", [("12:30,13:00", ["12:30", "13:00"]), ("a:b", ["a:b"])])
def test_lists_that_are_no_paths(spark, text, values):
    assert allowed_values(spark, text) == values


def test_staged_days_are_pruned(spark, tmp_path):
    import contextlib
    import io

    from gaugeline import FilterSpec
    from gaugeline.operators.filters import apply_filter
    from gaugeline.sources.readings import stage

    rows = [{"sensor": "a", "value": i, "timestamp": f"2024-01-{i:02d} 12:00:00"} for i in range(1, 29)] + [{"sensor": "b", "value": 1}]
    staged = stage(raw(spark, rows), str(tmp_path / "staged"))
    kept = apply_filter(staged, FilterSpec().dates("2024-01-05", "2024-01-07")).df
    assert kept.count() == 3 and staged.df.count() == 29
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        kept.explain("formatted")
    assert "_day" in out.getvalue().split("PartitionFilters: [")[1].split("]")[0]


def test_lines_are_parsed_once(spark):
    """No filter over the parsed objects below their explode: it would parse every line a second time."""
    lines = spark.createDataFrame([('{"a": 1}',)], "value string")
    plan = parse_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "from_json" in x]


def test_logs_of_discovery_are_written_side_by_side(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 5).alias("user_id"), F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("event_type"),
        F.col("id").cast("double").alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    files = list(Path(catalogue_files.log_by_sensor(spark, str(tmp_path), one_file=False)).glob("kind=view/*.txt"))
    assert len(files) > 1
    found = {(x["how"], x["sensor"]): x["count"] for x in catalogue_files.read_discovery(spark, str(tmp_path)).collect()}
    assert found == {(how, s): 200 for how, s in [("deep", "view"), ("deep", "click"), ("txt", "view"), ("txt", "click"), ("one", "view")]}
