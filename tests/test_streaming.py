from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugeline import FilterSpec, Readings, Update, apply_updates
from gaugeline.operators import counts, stats
from gaugeline.operators.errors import summarise_errors
from gaugeline.plans import catalogue_streams
from gaugeline.session import fresh_path
from gaugeline.sources.readings import read_readings
from gaugeline.streaming import changes, ring, running, store
from gaugeline.streaming.source import stream_readings

from .helpers import fields, json_lines, write

T0 = 1704067200


def rows_of(n, start=0):
    return [
        {"sensor_id": f"s{i % 3}", "sensor": "ds18b20", "value": 85 if i % 10 == 9 else i % 7 * 1.5, "timestamp": T0 + 60 * i}
        for i in range(start, start + n)
    ]


@pytest.fixture
def log(tmp_path):
    for i in range(3):
        write(tmp_path / "in" / f"{i}.out", json_lines(rows_of(20, 20 * i)))
    return str(tmp_path / "in")


def complete(spark, df):
    path = fresh_path(spark, "result")
    running.write_running(df, path, fresh_path(spark, "state")).awaitTermination()
    return sorted(running.read_latest(spark, path).collect())


def test_running_results_equal_batch_results(spark, log):
    batch, stream = read_readings(spark, log), stream_readings(spark, log, max_files=1)
    assert complete(spark, running.running_count(stream)) == counts.count(batch).collect()
    assert complete(spark, running.running_counts(stream, "sensor_id", period="day")) == sorted(
        counts.count_by(batch, "sensor_id", period="day").collect()
    )
    assert complete(spark, running.running_latest(stream)) == sorted(counts.latest(batch).collect())
    assert complete(spark, running.running_errors(stream)) == sorted(summarise_errors(batch, total=False).collect())


def test_changed_rows_give_the_same_as_whole_results(spark, log):
    batch, stream = read_readings(spark, log), stream_readings(spark, log, max_files=1)
    for df, keys, wanted in (
        (running.running_latest(stream), ["sensor_id"], counts.latest(batch)),
        (running.running_counts(stream, "sensor_id", period="day"), ["sensor_id", "day"], counts.count_by(batch, "sensor_id", period="day")),
        (running.running_errors(stream, total=True), ["description"], summarise_errors(batch)),
    ):
        path = fresh_path(spark, "result")
        running.write_running(df, path, fresh_path(spark, "state"), keys=keys).awaitTermination()
        assert sorted(running.read_latest(spark, path).collect()) == sorted(wanted.collect())


def files_in(path):
    import os

    return [os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:")) for f in names]


def test_a_kept_result_stays_small(spark):
    path = fresh_path(spark, "kept")
    kept = store.Kept(spark, path, ["k"])
    sizes = []
    for version in range(50):
        rows = [(None if i == 0 else f"k{i}", version) for i in range(20) if (i + version) % 3 == 0]
        kept.write(spark.createDataFrame(rows, "k string, n int").coalesce(1), version)
        sizes.append(len(files_in(path)))
        assert len(kept.manifests()) <= 2
    # Two versions: their deltas, and the manifests; two files per folder, each with a checksum.
    assert max(sizes[25:]) <= 4 * (2 * store.DELTAS + 2) and max(sizes[25:]) == max(sizes[10:25])
    wanted = {(None if i == 0 else f"k{i}"): max(v for v in range(50) if (i + v) % 3 == 0) for i in range(20)}
    assert {r["k"]: r["n"] for r in store.Kept(spark, path).read().collect()} == wanted
    assert {r["n"] for r in kept.read(49).collect()} <= set(range(49))


def test_unfinished_versions_are_not_read(spark):
    path = fresh_path(spark, "kept")
    kept = store.Kept(spark, path, ["k"])
    assert kept.read() is None
    with pytest.raises(FileNotFoundError):
        running.read_latest(spark, path)
    kept.write(spark.createDataFrame([("a", 1)], "k string, n int"), 0)
    # A folder without a manifest: the batch failed before it was done.
    spark.createDataFrame([("a", 99)], "k string, n int").write.parquet(store.version_path(path, 1))
    assert [tuple(r) for r in kept.read().collect()] == [("a", 1)]
    kept.write(spark.createDataFrame([("a", 2)], "k string, n int"), 1)
    assert [tuple(r) for r in kept.read().collect()] == [("a", 2)]
    # A batch that is repeated although it was finished changes nothing.
    kept.write(spark.createDataFrame([("a", 3)], "k string, n int"), 1)
    assert [tuple(r) for r in kept.read().collect()] == [("a", 2)]


@pytest.mark.parametrize("files", [1, 2, 6])
def test_arrival_order_of_text_without_times(spark, tmp_path, files):
    """Names and timestamps say nothing of the order, only when the files were written and the places in them."""
    import os

    wanted = []
    for i, name in enumerate("fbdaec"):
        rows = [{"sensor_id": "s", "value": (i * 37 + j * j * 11) % 101, "timestamp": 5} for j in range(30)]
        wanted += [r["value"] for r in rows]
        path = write(tmp_path / "in" / f"{name}.out", json_lines(rows[:15]) + "[" + ",".join(json.dumps(r) for r in rows[15:]) + "]\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    path = fresh_path(spark, "changes")
    stream = stream_readings(spark, str(tmp_path / "in"), max_files=files)
    changes.write_changes(stream, path, fresh_path(spark, "state"), by_time=False).awaitTermination()
    steps = [abs(b - a) for a, b in zip(wanted, wanted[1:])]
    found = changes.read_changes(spark, path).first()
    at = steps.index(max(steps))
    assert (found["n_changes"], found["change_max"], found["jump_from"], found["jump_to"]) == (179, max(steps), wanted[at], wanted[at + 1])
    assert found["change_mean"] == pytest.approx(sum(steps) / len(steps))


@pytest.mark.parametrize("files", [1, 4])
def test_sampling_gaps(spark, tmp_path, files):
    times = {"a": [T0 + 60 * i + (i > 50) * 900 + (i > 51) * 5000 for i in range(100)], "b": [T0 + 7 * (i // 2) for i in range(60)], "c": [T0]}
    for i in range(4):
        rows = [{"sensor_id": s, "value": 1, "timestamp": t} for s, ts in times.items() for t in ts[i * 25:(i + 1) * 25]]
        write(tmp_path / "in" / f"{i}.out", json_lines(rows + [{"sensor_id": "d", "value": 1}]))
    path = fresh_path(spark, "gaps")
    changes.write_sampling(stream_readings(spark, str(tmp_path / "in"), max_files=files), path, fresh_path(spark, "state")).awaitTermination()
    found = {x["sensor_id"]: tuple(x)[1:] for x in changes.read_sampling(spark, path).collect()}
    batch = stats.sampling(read_readings(spark, str(tmp_path / "in")), by=["sensor_id"])
    assert found == {x["sensor_id"]: tuple(x)[1:] for x in batch.collect()}
    assert found["a"] == (60, 2, 5060)


def test_running_stats(spark, log):
    batch, stream = read_readings(spark, log), stream_readings(spark, log, max_files=1)
    found = complete(spark, running.running_stats(stream, by=["sensor_id"], exact=True))
    wanted = stats.basic(batch, by=["sensor_id"]).join(stats.quartiles(batch, by=["sensor_id"]), ["sensor_id", "column"])
    wanted = sorted(wanted.select(*running.running_stats(batch, by=["sensor_id"]).columns).collect())
    assert [tuple(x)[:2] for x in found] == [tuple(x)[:2] for x in wanted]
    for a, b in zip(found, wanted):
        assert list(a)[2:] == pytest.approx(list(b)[2:])


def test_filters_updates_and_unique_on_a_stream(spark, tmp_path):
    write(tmp_path / "in" / "1.out", '{"a":1,"b":2}\n{"b":2,"a":1}\n{"a":2}\n')
    write(tmp_path / "in" / "2.out", '{"a":1,"b":2}\n{"a":3}\n')
    stream = stream_readings(spark, str(tmp_path / "in"), max_files=1)
    kept = running.running_filter(stream, FilterSpec().exclude_value("a", "3").once())
    kept = apply_updates(kept, [Update("a", "2", "note", "two")])
    path = fresh_path(spark, "rows")
    running.write_rows(kept.df, path, fresh_path(spark, "state")).awaitTermination()
    found = spark.read.parquet(path).select(F.to_json("fields")).collect()
    assert sorted(json.dumps(json.loads(x[0]), sort_keys=True) for x in found) == ['{"a": "1", "b": "2"}', '{"a": "2", "note": "two"}']


def test_csv_stream(spark, tmp_path):
    write(tmp_path / "in" / "1.csv", "sensor,value\na,1\nb\n")
    stream = stream_readings(spark, str(tmp_path / "in"), format="csv", columns=["sensor", "value"])
    path = fresh_path(spark, "rows")
    running.write_rows(stream.df, path, fresh_path(spark, "state")).awaitTermination()
    assert sorted(fields(Readings(spark.read.parquet(path))), key=lambda f: f["sensor"]) == [{"sensor": "a", "value": "1"}, {"sensor": "b"}]


def test_running_changes_survive_a_restart(spark, tmp_path):
    source, path, state = str(tmp_path / "in"), fresh_path(spark, "changes"), fresh_path(spark, "state")
    for i in range(3):
        write(tmp_path / "in" / f"{i}.out", json_lines(rows_of(20, 20 * i)))
        # A new query on the same checkpoint each time.
        changes.write_changes(stream_readings(spark, source), path, state).awaitTermination()
    found = sorted(changes.read_changes(spark, path).collect())
    batch = stats.changes(read_readings(spark, source), by=["sensor_id"], order="timestamp")
    wanted = sorted(batch.collect())
    assert [x["sensor_id"] for x in found] == [x["sensor_id"] for x in wanted]
    for a, b in zip(found, wanted):
        for name in ("n_changes", "change_min", "change_max", "change_mean", "volatility", "jump_size", "jump_from", "jump_to"):
            assert a[name] == pytest.approx(b[name]), name
        assert a["count"] == 20


def test_last_points(spark, tmp_path):
    source, path = str(tmp_path / "in"), fresh_path(spark, "ring")
    old = read_readings(spark, write(tmp_path / "old.out", json_lines(
        [{"sensor_id": "s0", "value": v, "timestamp": 100 + v} for v in range(10)]
    )))
    for i in range(2):
        write(tmp_path / "in" / f"{i}.out", json_lines(
            [{"sensor_id": s, "value": 10 * i + j, "timestamp": 200 + 10 * i + j} for s in ("s0", "s1") for j in range(3)]
        ))
    query = ring.write_last_points(
        stream_readings(spark, source, max_files=1), path, fresh_path(spark, "state"), size=6, preloaded=ring.history(old, 4)
    )
    query.awaitTermination()
    found = {x["sensor_id"]: x for x in ring.read_last_points(spark, path).collect()}
    assert list(found["s0"]["readings"]) == [0, 1, 2, 10, 11, 12]
    assert found["s0"]["historical"] == 0 and (found["s0"]["min_value"], found["s0"]["max_value"]) == (0, 12)
    assert list(found["s1"]["timestamps"]) == [200, 201, 202, 210, 211, 212]
    first = {x["sensor_id"]: x for x in spark.read.parquet(path).where("version = 0").collect()}
    assert list(first["s0"]["readings"]) == [7, 8, 9, 0, 1, 2] and first["s0"]["historical"] == 3


def test_exact_statistics_without_state(spark, log):
    batch, stream = read_readings(spark, log), stream_readings(spark, log, max_files=1)
    path = fresh_path(spark, "stats")
    query = running.write_stats(stream, path, fresh_path(spark, "state"), ["value", "timestamp"], ["sensor_id"])
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress) and len(query.recentProgress) == 3
    found = sorted(running.read_stats(spark, path).collect())
    wanted = sorted(stats.value_summary(batch, ["value", "timestamp"], ["sensor_id"]).select(*running.read_stats(spark, path).columns).collect())
    assert [tuple(x)[:2] for x in found] == [tuple(x)[:2] for x in wanted]
    for a, b in zip(found, wanted):
        assert list(a)[2:] == pytest.approx(list(b)[2:])


def test_unique_without_state(spark, tmp_path):
    for i, rows in enumerate(([{"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2}], [{"a": 1, "b": 2}, {"a": 3}], [{"a": 3}, {"a": 2}, {"a": 4}])):
        write(tmp_path / "in" / f"{i}.out", json_lines(rows))
    stream = stream_readings(spark, str(tmp_path / "in"), max_files=1)
    path = fresh_path(spark, "unique")
    query = running.write_unique(stream, path, fresh_path(spark, "state"))
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    found = [x[0] for x in running.read_unique(spark, path, stream).df.select(F.to_json("fields")).collect()]
    assert sorted(json.dumps(json.loads(x), sort_keys=True) for x in found) == ['{"a": "1", "b": "2"}', '{"a": "2"}', '{"a": "3"}', '{"a": "4"}']
    # A batch that failed before it was finished is not read.
    spark.read.parquet(f"{path}/rows/version=0").write.parquet(f"{path}/rows/version=7")
    assert running.read_unique(spark, path, stream).df.count() == 4


def test_watermark_bounds_the_state(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("k string, at timestamp")
    for i in range(4):
        rows = spark.range(100).selectExpr(f"concat('k', id + {100 * i}) k", f"timestamp_seconds({T0} + 86400 * {i} + id) at")
        rows.union(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    r = running.running_unique(Readings(df, {"k": "k"}, ("at",)), ("at", "1 hour"))
    path = fresh_path(spark, "rows")
    query = running.write_rows(r.df, path, fresh_path(spark, "state"))
    query.awaitTermination()
    assert spark.read.parquet(path).count() == 400
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 200


@pytest.mark.parametrize("files", [1, 3])
def test_formats_and_headers_by_file(spark, tmp_path, files):
    write(tmp_path / "in" / "1.csv", 'sensor,value,note\r\na,1,"x, ""y"""\r\n"b",2\r\n\r\n')
    write(tmp_path / "in" / "2.CSV", "value,sensor,value\n3,a,9\n")
    write(tmp_path / "in" / "3.out", '{"sensor":"a","value":4}\n')
    path = fresh_path(spark, "unique")
    stream = stream_readings(spark, str(tmp_path / "in"), format="auto", max_files=files)
    running.write_unique(stream, path, fresh_path(spark, "state")).awaitTermination()
    found = [x[0] for x in running.read_unique(spark, path, stream).df.select("fields").collect()]
    wanted = [{"sensor": "a", "value": "1", "note": 'x, "y"'}, {"sensor": "b", "value": "2"}, {"value": "3", "sensor": "a"}, {"value": "4", "sensor": "a"}]
    assert sorted(json.dumps(x, sort_keys=True) for x in found) == sorted(json.dumps(x, sort_keys=True) for x in wanted)


@pytest.mark.parametrize("kind", ["changes", "sampling"])
def test_a_batch_is_worked_out_once(spark, tmp_path, kind):
    """However many steps there are over a batch, each of its rows is read and parsed once."""
    rows = [(i, f"s{i % 3}", float(i % 7), 1704067200 + 60 * i) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, sensor_id string, value double, timestamp long").write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    df = spark.readStream.schema("event_id long, sensor_id string, value double, timestamp long").parquet(str(tmp_path / "in"))
    df = df.withColumn("sensor_id", F.udf(counted, "string")("sensor_id"))
    r = Readings.typed(df, ["sensor_id", "value", "timestamp"], ["event_id"])
    write = changes.write_changes if kind == "changes" else changes.write_sampling
    path = fresh_path(spark, kind)
    write(r, path, fresh_path(spark, "state")).awaitTermination()
    assert seen.value == 30
    found = changes.read_changes(spark, path) if kind == "changes" else changes.read_sampling(spark, path)
    assert found.count() == 3
    assert not [n for n in store.Kept(spark, path)._names() if n.startswith("_batch")]


def test_parts_arrive_in_the_order_of_their_rows(spark, tmp_path):
    """Several files in a part: the modification times and names of all files are in the order of the ids."""
    rows = spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        *_, source = catalogue_streams._arriving(spark, str(tmp_path), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = sorted((x for x in Path(source).iterdir() if x.suffix == ".txt"), key=lambda x: (x.stat().st_mtime_ns, x.name))
    ids = [json.loads(line)["event_id"] for x in files for line in x.read_text().splitlines()]
    assert len(files) > 2 and ids == list(range(3000))
