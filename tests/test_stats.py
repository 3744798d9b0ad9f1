from __future__ import annotations

import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline import FilterSpec, Query, Readings
from gaugeline.operators import stats
from gaugeline.operators.ordered import first_n, stretches, with_previous
from gaugeline.operators.quantiles import folded, quantiles, ranked_pieces, wanted_pieces, with_quantiles
from gaugeline.operators.skew import sliced
from gaugeline.sources.readings import read_readings

from .helpers import raw, values


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_basic_and_quartiles(spark):
    found = one(stats.stats(raw(spark, values([10, 20, 30, 40, 50]))))
    assert (found["count"], found["min"], found["max"], found["range"], found["mean"]) == (5, 10, 50, 40, 30)
    assert found["stddev"] == pytest.approx(statistics.stdev([10, 20, 30, 40, 50]))
    assert (found["q1"], found["median"], found["q3"], found["iqr"]) == (20, 30, 40, 20)
    assert one(stats.quartiles(raw(spark, values([1, 2, 3, 4]))))["median"] == 2.5


def test_single_value(spark):
    found = one(stats.stats(raw(spark, values([7]))))
    assert (found["count"], found["stddev"], found["outliers"], found["n_changes"]) == (1, 0, 0, 0)
    assert found["jump_size"] is None and found["volatility"] is None


def test_outliers(spark):
    found = one(stats.outliers(raw(spark, values([20, 21, 22, 23, 24, 85]))))
    assert found["outliers"] == 1 and found["outlier_percent"] == pytest.approx(100 / 6)


def test_changes(spark):
    found = one(stats.changes(raw(spark, values([10, 15, 25, 30]))))
    assert (found["change_min"], found["change_max"], found["n_changes"]) == (5, 10, 3)
    assert found["change_mean"] == pytest.approx(20 / 3)
    assert one(stats.changes(raw(spark, values([20, 21, 22, 23]))))["volatility"] == 0
    jump = one(stats.changes(raw(spark, values(["20.0", "20.5", "25.0", "25.5"]))))
    assert (jump["jump_size"], jump["jump_from"], jump["jump_to"]) == (4.5, 20.5, 25.0)
    first = one(stats.changes(raw(spark, values([0, 5, 5, 0, 5]))))
    assert (first["jump_from"], first["jump_to"]) == (0, 5)


def test_time_range_and_sampling(spark):
    r = raw(spark, [{"value": 1, "timestamp": 1700000000 + 3600 * i} for i in range(4)])
    found = one(stats.time_range(r))
    assert (found["first"], found["duration"], found["n_timestamps"], found["duration_text"]) == (1700000000, 10800, 4, "3h 0m 0s")
    assert found["per_hour"] == pytest.approx(4 / 3) and found["per_day"] == pytest.approx(32)
    gaps = raw(spark, [{"value": 1, "timestamp": 1700000000 + d} for d in (0, 60, 120, 10000)])
    assert one(stats.sampling(gaps)) == {"typical_interval": 60, "gaps": 1, "max_gap": 9880}
    single = raw(spark, [{"value": 1, "timestamp": 5}])
    assert one(stats.time_range(single))["per_hour"] is None
    assert stats.sampling(single).count() == 0
    assert stats.time_range(raw(spark, values([1]))).count() == 0


def test_iso_times_count_unless_strict(spark):
    r = raw(spark, [{"value": 1, "timestamp": "2024-01-01"}, {"value": 2, "timestamp": "2024-01-02"}])
    assert one(stats.time_range(r))["duration"] == 86400
    assert stats.time_range(Readings(r.df, strict=True)).count() == 0


def test_cleaned_stats(spark):
    r = raw(spark, values(["22.5", "", "85", "23.0", "-127"]))
    assert one(Query(r).where(FilterSpec().clean()).stats())["count"] == 2
    assert stats.stats(raw(spark, values(["x", ""]))).count() == 0


def test_column_choice(spark):
    r = raw(spark, [{"a": 1, "b": "x", "timestamp": 5}, {"a": 2, "b": "3", "timestamp": 6}, {"a": "", "c": "1e2"}])
    found = {x["column"]: x["count"] for x in stats.stats(r, "all").collect()}
    assert found == {"a": 2, "b": 1, "timestamp": 2, "c": 1}
    assert one(stats.basic(r, ["c"]))["max"] == 100
    assert {x["column"] for x in stats.basic(r, ["a", "b"]).collect()} == {"a", "b"}


def brute(values_):
    changes = [abs(b - a) for a, b in zip(values_, values_[1:])]
    at = changes.index(max(changes))
    return {
        "n_changes": len(changes), "change_min": min(changes), "change_max": max(changes), "change_mean": statistics.mean(changes),
        "volatility": statistics.stdev(changes), "jump_size": max(changes), "jump_from": values_[at], "jump_to": values_[at + 1],
    }


def skewed(spark):
    """One sensor with most rows, one second with a third of all rows, and a few small sensors."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        sensor = "hot" if rng.random() < 0.8 else f"s{rng.randrange(5)}"
        ts = 1_000_000 if rng.random() < 0.33 else rng.randrange(5_000_000)
        rows.append((i, sensor, ts, float(rng.choice([1, 2, 2, 2, rng.randrange(1000)]))))
    df = spark.createDataFrame(rows, "id bigint, sensor string, ts bigint, value double").repartition(5)
    return rows, Readings.typed(df, {"sensor": "sensor", "timestamp": "ts", "value": "value"}, ["id"])


@pytest.mark.parametrize("order", ["arrival", "timestamp"])
@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_changes_of_large_groups_equal_brute_force(spark, monkeypatch, order, limit):
    monkeypatch.setattr("gaugeline.model.SLICE_BITS", 5)
    rows, r = skewed(spark)
    rows = sorted(rows, key=(lambda x: x[0]) if order == "arrival" else (lambda x: (x[2], x[0])))
    found = {x["sensor"]: x for x in stats.changes(r, by=["sensor"], order=order, limit=limit).collect()}
    for sensor in {x[1] for x in rows}:
        for name, wanted in brute([x[3] for x in rows if x[1] == sensor]).items():
            assert found[sensor][name] == pytest.approx(wanted), (sensor, name)
    overall = one(stats.changes(r, order=order, limit=limit))
    for name, wanted in brute([x[3] for x in rows]).items():
        assert overall[name] == pytest.approx(wanted), name


@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_sampling_of_large_groups_equals_brute_force(spark, limit):
    rows, r = skewed(spark)
    found = {x["sensor"]: x for x in stats.sampling(r, by=["sensor"], limit=limit).collect()}
    for sensor in {x[1] for x in rows}:
        times = sorted(x[2] for x in rows if x[1] == sensor and x[2])
        steps = sorted(b - a for a, b in zip(times, times[1:]))
        typical = steps[len(steps) // 2]
        gaps = [s for s in steps if s > 3 * typical]
        got = found[sensor]
        assert (got["typical_interval"], got["gaps"], got["max_gap"]) == (typical, len(gaps), max(gaps) if gaps else None)


@pytest.mark.parametrize("ranges", [None, 1, 9, 60])
def test_quantiles_equal_numpy(spark, ranges):
    rows, r = skewed(spark)
    found = {x["sensor"]: x["quantiles"] for x in quantiles(r.df, ["sensor"], "value", (0.0, 0.25, 0.5, 0.9, 1.0), ranges).collect()}
    for sensor in {x[1] for x in rows}:
        wanted = np.percentile([x[3] for x in rows if x[1] == sensor], [0, 25, 50, 90, 100])
        assert found[sensor] == pytest.approx(list(wanted)), sensor
    assert one(quantiles(spark.range(1, 11).selectExpr("double(id) x", "1 k"), ["k"], "x", (0.9,)))["quantiles"] == pytest.approx([9.1])


@pytest.mark.parametrize("ranges", [None, 9, 60])
def test_summary_of_large_groups(spark, ranges):
    rows, r = skewed(spark)
    found = {x["sensor"]: x for x in stats.value_summary(r, by=["sensor"], ranges=ranges).collect()}
    for sensor in {x[1] for x in rows}:
        mine, got = np.array([x[3] for x in rows if x[1] == sensor]), found[sensor]
        q1, q2, q3 = np.percentile(mine, [25, 50, 75])
        assert got["outliers"] == int(((mine < q1 - 1.5 * (q3 - q1)) | (mine > q3 + 1.5 * (q3 - q1))).sum())
        assert got["outlier_percent"] == pytest.approx(100 * got["outliers"] / len(mine))
        assert [got[c] for c in ("count", "min", "max", "mean", "stddev", "q1", "median", "q3")] == pytest.approx(
            [len(mine), mine.min(), mine.max(), mine.mean(), mine.std(ddof=1), q1, q2, q3])


def test_extreme_values(spark):
    wanted = [-1.7e308, -5e-324, 0.0, -0.0, 5e-324, 1e-300, 1.0, 1.0, 1.0000000000000002, 1.7e308]
    df = spark.createDataFrame([("k", v) for v in wanted] + [("k", None), ("one", 3.5), (None, None)], "k string, v double")
    for ranges in (None, 5):
        found = {x["k"]: x["quantiles"] for x in quantiles(df, ["k"], "v", (0.0, 4 / 9, 5 / 9, 8 / 9, 1.0), ranges).collect()}
        assert found == {"k": [-1.7e308, 5e-324, 1e-300, 1.0000000000000002, 1.7e308], "one": [3.5] * 5}


@pytest.mark.parametrize("size, ranges", [(4000, 10), (40_000, 100)])
def test_no_task_ranks_more_than_a_range(spark, size, ranges):
    """Ten times the values and ten times the ranges: the longest run of values that is put in order stays as it was."""
    rows = spark.range(size).selectExpr("if(id % 5 = 0, concat('s', id % 50), 'hot') k", "double(hash(id)) v")
    kept = folded(rows, ["k"], "v")
    wanted = wanted_pieces(kept, ["k"], "v", (0.25, 0.5, 0.75), ranges)
    assert [x["k"] for x in wanted.collect()].count("hot") == 1
    ranked = ranked_pieces(kept, ["k"], "v", wanted).groupBy("k", "_low").count().agg(F.max("count")).first()[0]
    alone = with_quantiles(kept, ["k"], "v", (0.25, 0.5, 0.75), ranges)
    few = kept.join(wanted, "k", "left_anti").groupBy("k").count().agg(F.max("count")).first()[0]
    assert ranked <= 2 * 400 and (few or 0) <= 2 * 400 and alone.count() == kept.count()


def test_previous_reading(spark):
    rows, r = skewed(spark)
    levels = [[F.shiftright("ts", 17)], [F.col("ts"), F.shiftright("id", 4)]]
    found = with_previous(r.df, ["sensor"], ["ts", "id"], levels, ["value"], limit=20).collect()
    wanted, before = {}, {}
    for i, sensor, ts, value in sorted(rows, key=lambda x: (x[2], x[0])):
        wanted[i] = before.get(sensor)
        before[sensor] = value
    assert {x["id"]: x["previous"]["value"] if x["previous"] else None for x in found} == wanted


def test_sparse_ids_are_merged_as_a_tree(spark, monkeypatch):
    """With a slice per row, slices meet within stretches, and stretches among each other."""
    monkeypatch.setattr("gaugeline.operators.ordered.FAN_BITS", 40)
    rng = random.Random(5)
    rows = [(rng.getrandbits(62), f"s{rng.randrange(3)}", float(rng.randrange(100))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, sensor string, value double").repartition(7)
    r = Readings.typed(df, ["sensor", "value"], ["id"])
    kept, slices = sliced(df, ["sensor"], r.arrival_levels(), 20)
    wide, stretch = stretches(kept, r.arrival_levels(), slices)
    assert kept.select("sensor", *slices).distinct().count() == 2000  # hashed ids leave every row a slice of its own
    assert 3 < wide.select("sensor", *stretch).distinct().count() <= 3 * 2 ** (62 - 18 - 40)
    rows.sort()
    for by in ([], ["sensor"]):
        found = stats.changes(r, by=by, limit=20).collect()
        for x in found:
            for name, wanted in brute([v for _, s, v in rows if not by or s == x["sensor"]]).items():
                assert x[name] == pytest.approx(wanted), name
    wanted, before = {}, {}
    for i, s, v in rows:
        wanted[i] = before.get(s)
        before[s] = v
    found = with_previous(df, ["sensor"], ["id"], r.arrival_levels(), ["value"], limit=20).collect()
    assert {x["id"]: x["previous"]["value"] if x["previous"] else None for x in found} == wanted


def test_first_n(spark):
    rows, r = skewed(spark)
    for n, sensor in [(n, s) for n in (7, 1500) for s in ("hot", "s1")]:
        found = first_n(r.df, ["sensor"], [F.col("ts").desc(), F.col("id").desc()], n).collect()
        wanted = sorted(((x[2], x[0]) for x in rows if x[1] == sensor), reverse=True)[:n]
        assert sorted(((x["ts"], x["id"]) for x in found if x["sensor"] == sensor), reverse=True) == wanted


def test_results_do_not_depend_on_partitioning(spark):
    _, r = skewed(spark)
    again = r.with_df(r.df.repartition(13, "value"))
    assert sorted(map(str, stats.changes(r, by=["sensor"], limit=50).collect())) == sorted(
        map(str, stats.changes(again, by=["sensor"], limit=50).collect())
    )


def test_a_summary_of_text_parses_it_once(spark, tmp_path):
    rows = [{"a": i % 5, "b": i * 0.5, "c": "x"} for i in range(40)]
    (tmp_path / "log.out").write_text("".join(json.dumps(x) + "\n" for x in rows))
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return True

    r = read_readings(spark, str(tmp_path / "log.out"), format="json")
    found = stats.value_summary(r.with_df(r.df.where(F.udf(counted, "boolean")("source"))), stats.ALL).collect()
    assert seen.value == 40
    assert {x["column"]: (x["count"], x["mean"], x["median"], x["outliers"]) for x in found} == {"a": (40, 2.0, 2.0, 0), "b": (40, 9.75, 9.75, 0)}
    assert {x["column"]: round(x["stddev"], 9) for x in found} == {k: round(statistics.stdev([x[k] for x in rows]), 9) for k in "ab"}
