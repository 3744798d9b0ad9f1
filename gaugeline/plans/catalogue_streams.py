"""Queries that run the events through a stream to its end."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Readings
from ..operators.filters import FilterSpec
from ..operators.updates import Update, apply_updates
from ..session import fresh_path
from ..sinks import text
from ..streaming import changes, ring, running
from ..streaming.source import stream_readings
from .catalogue import EV, ERR, LATEST, LATEST_COLUMNS, QUARTS, _changes_sql, _sampling_sql, register, rounded
from .tables import EVENT_ERRORS, event_rows, events, table


def event_stream(spark, sf) -> Readings:
    """The events table, arriving as a stream."""
    r = events(spark, sf)
    schema = table(spark, sf, "events").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return replace(r, df=df.withColumn("k", F.regexp_extract("props", r'"k": ([0-9]+)', 1)))


def _complete(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, "running")
    running.write_running(df, path, fresh_path(spark, "state"), keys=keys).awaitTermination()
    return running.read_latest(spark, path)


def _rows(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, "rows")
    running.write_rows(df, path, fresh_path(spark, "state")).awaitTermination()
    return spark.read.parquet(path)


def _in_parts(spark, sf, parts: int = 3) -> Readings:
    """The events table as a stream of so many batches."""
    r = events(spark, sf)
    source = fresh_path(spark, "parts")
    rows = table(spark, sf, "events")
    for part in range(parts):
        rows.where(F.col("event_id") % parts == part).coalesce(1).write.mode("append").parquet(source)
    df = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return replace(r, df=df.withColumn("k", F.regexp_extract("props", r'"k": ([0-9]+)', 1)))


@register("stream_count", "SELECT count(*) AS count FROM events")
def stream_count(spark, sf):
    return _complete(running.running_count(event_stream(spark, sf)))


@register(
    "stream_counts",
    f"""{EV} SELECT sensor, strftime(make_timestamp(timestamp * 1000000), '%G-W%V') AS week, count(*) AS count
      FROM ev GROUP BY 1, 2""",
)
def stream_counts(spark, sf):
    return _complete(running.running_counts(event_stream(spark, sf), "sensor", period="week"), ["sensor", "week"])


@register(
    "stream_stats",
    f"""{EV}, q AS (SELECT sensor, count(*) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean,
        stddev_samp(value) AS stddev, {QUARTS} FROM ev GROUP BY sensor)
      SELECT sensor, 'value' AS "column", count, round(min, 6) AS min, round(max, 6) AS max, round(max - min, 6) AS range,
        round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
        round(q3 - q1, 6) AS iqr FROM q""",
)
def stream_stats(spark, sf):
    """Exact statistics of events that arrive in three parts."""
    path = fresh_path(spark, "stats")
    running.write_stats(_in_parts(spark, sf), path, fresh_path(spark, "state"), by=["sensor"]).awaitTermination()
    return rounded(running.read_stats(spark, path).drop("outliers", "outlier_percent"))


@register("stream_latest", f"{LATEST} SELECT {LATEST_COLUMNS} FROM l")
def stream_latest(spark, sf):
    return _complete(running.running_latest(event_stream(spark, sf)), ["sensor_id"])


@register(
    "stream_errors",
    f"""{EV}, e AS (SELECT ({ERR}) AS description FROM ev)
      SELECT description, count(*) AS count FROM e WHERE description IS NOT NULL GROUP BY description
      UNION ALL SELECT '(total)', count(*) FROM e WHERE description IS NOT NULL""",
)
def stream_errors(spark, sf):
    return _complete(running.running_errors(event_stream(spark, sf), EVENT_ERRORS, total=True), ["description"])


@register(
    "stream_filter_update",
    f"""{EV} SELECT event_id, sensor_id, sensor, value, timestamp, CASE WHEN sensor = 'click' THEN 'tap' ELSE k END AS k
      FROM ev WHERE timestamp BETWEEN 1704412800 AND 1705276799 AND ({ERR}) IS NULL""",
)
def stream_filter_update(spark, sf):
    spec = FilterSpec().dates("2024-01-05", "2024-01-14").without_errors(EVENT_ERRORS)
    kept = running.running_filter(event_stream(spark, sf), spec)
    return _rows(event_rows(apply_updates(kept, [Update("sensor", "click", "k", "tap")])))


@register("stream_unique", f"{EV} SELECT DISTINCT sensor, k FROM ev")
def stream_unique(spark, sf):
    r = event_stream(spark, sf)
    df = r.df.select(r.field("sensor").alias("sensor"), "k", "event_id")
    few = Readings.typed(df, ["sensor", "k"], ["event_id"])
    return _rows(running.running_unique(few).df.select("sensor", "k"))


@register(
    "stream_auto",
    f"""{EV} SELECT sensor, 'value' AS "column", count(*) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max,
      round(median(value), 6) AS median FROM ev GROUP BY sensor""",
)
def stream_auto(spark, sf):
    """Events that arrive as JSON lines and as CSV, the columns of each file in an order of its own."""
    ev = event_rows(events(spark, sf)).withColumn("value", F.col("value").cast("string"))
    source = fresh_path(spark, "mixed")
    for part, names in enumerate((["sensor", "value", "event_id"], ["event_id", "sensor", "value"])):
        text.write_csv(Readings.typed(ev.where(F.col("event_id") % 3 == part), names, ["event_id"]), source, names, mode="append")
    text.write_json(Readings.typed(ev.where(F.col("event_id") % 3 == 2), ["event_id", "sensor", "value"], ["event_id"]), source, mode="append")
    path = fresh_path(spark, "stats")
    running.write_stats(stream_readings(spark, source, format="auto"), path, fresh_path(spark, "state"), by=["sensor"]).awaitTermination()
    return rounded(running.read_stats(spark, path).select("sensor", "column", "count", "min", "max", "median"))


@register("stream_unique_exact", f"{EV} SELECT sensor, k, min(event_id % 3) AS part FROM ev GROUP BY sensor, k")
def stream_unique_exact(spark, sf):
    """First copies of events in three parts, and the part each came with."""
    r = _in_parts(spark, sf)
    df = r.df.select(r.field("sensor").alias("sensor"), "k", "event_id")
    few = Readings.typed(df, ["sensor", "k"], ["event_id"])
    path = fresh_path(spark, "unique")
    running.write_unique(few, path, fresh_path(spark, "state")).awaitTermination()
    return running.read_unique(spark, path, few).df.select("sensor", "k", (F.col("event_id") % 3).alias("part"))


@register("stream_unique_watermark", f"{EV} SELECT DISTINCT sensor, k FROM ev")
def stream_unique_watermark(spark, sf):
    """First copies within a delay that covers all events."""
    r = event_stream(spark, sf)
    df = r.df.select(r.field("sensor").alias("sensor"), "k", F.timestamp_seconds(r.timestamp()).alias("at"), "event_id")
    few = Readings.typed(df, ["sensor", "k"], ["event_id"])
    return _rows(running.running_unique(few, ("at", "400 days")).df.select("sensor", "k"))


@register(
    "stream_changes",
    _changes_sql(EV, "sensor_id", "timestamp, event_id", "ev")
    + """, n AS (SELECT sensor_id, count(*) AS count, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM ev GROUP BY sensor_id)
      SELECT n.*, n_changes, round(change_min, 9) AS change_min, round(change_max, 9) AS change_max,
      round(change_mean, 9) AS change_mean, round(volatility, 9) AS volatility, round(jump_size, 9) AS jump_size,
      round(jump_from, 9) AS jump_from, round(jump_to, 9) AS jump_to
      FROM n JOIN g USING (sensor_id) LEFT JOIN j ON j.k = 1 AND j.sensor_id = n.sensor_id""",
)
def stream_changes(spark, sf):
    """Events arrive in three parts; the query is stopped and started again between them."""
    rows = table(spark, sf, "events")
    source, path, state = (fresh_path(spark, n) for n in ("segments", "changes", "state"))
    r = events(spark, sf)
    ends = rows.agg(F.max("event_id")).first()[0]
    for part in range(3):
        low, high = part * (ends + 1) // 3, (part + 1) * (ends + 1) // 3
        rows.where((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(source)
        df = spark.readStream.schema(rows.schema).parquet(source)
        stream = replace(r, df=df.withColumn("k", F.regexp_extract("props", r'"k": ([0-9]+)', 1)))
        changes.write_changes(stream, path, state).awaitTermination()
    # Nine places, because means of a few dozen short decimals can end exactly between two numbers of six places.
    return rounded(changes.read_changes(spark, path), 9)


SPLIT = 1705536000  # 2024-01-18
KEPT, PRELOADED = 20, 12


@register(
    "stream_last_n",
    f"""{EV}, o AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp DESC, event_id DESC) AS rn FROM ev WHERE timestamp < {SPLIT}),
      a AS (SELECT sensor_id, timestamp, event_id, value, 0 AS fresh FROM o WHERE rn <= {PRELOADED}
        UNION ALL SELECT sensor_id, timestamp, event_id, value, 1 FROM ev WHERE timestamp >= {SPLIT}),
      k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp DESC, event_id DESC) AS rn,
        max(fresh) OVER (PARTITION BY sensor_id) AS live FROM a)
      SELECT sensor_id, timestamp, value, CAST(KEEP - rn AS INTEGER) AS pos, fresh = 0 AS historical, min(value) OVER s AS min_value,
        max(value) OVER s AS max_value
      FROM (SELECT *, count(*) OVER (PARTITION BY sensor_id) AS KEEP FROM k WHERE rn <= {KEPT} AND live = 1)
      WINDOW s AS (PARTITION BY sensor_id)""",
)
def stream_last_n(spark, sf):
    past, live = events(spark, sf), event_stream(spark, sf)
    past = past.with_df(past.df.where(past.timestamp() < SPLIT))
    live = live.with_df(live.df.where(live.timestamp() >= SPLIT))
    path = fresh_path(spark, "rings")
    query = ring.write_last_points(live, path, fresh_path(spark, "state"), KEPT, ring.history(past, PRELOADED))
    query.awaitTermination()
    rings = ring.read_last_points(spark, path)
    points = F.arrays_zip("timestamps", "readings")
    each = rings.select("sensor_id", "historical", "min_value", "max_value", F.posexplode(points).alias("pos", "p"))
    return each.select(
        "sensor_id", F.col("p.timestamps").alias("timestamp"), F.col("p.readings").alias("value"), "pos",
        (F.col("pos") < F.col("historical")).alias("historical"), "min_value", "max_value")


def _side_by_side(spark, folder: str, known: set[str], at: int) -> None:
    """One time of writing for all new files of a folder: tasks end in any order, the names of their files are in the order of the rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(where):
        name = status.getPath().getName()
        if name not in known:
            known.add(name)
            system.setTimes(status.getPath(), at, -1)


def _arriving(spark, sf, parts: int, stamped: bool = True) -> Iterator[str]:
    """A folder with the events as JSON lines, after each of so many parts; the parts and the files in them are in the order of the ids."""
    source, known, at = fresh_path(spark, "text"), set(), 0
    ev = event_rows(events(spark, sf))
    ends = ev.agg(F.max("event_id")).first()[0] + 1
    names = ["event_id", "sensor_id", "sensor", "value", *(["timestamp"] if stamped else [])]
    for part in range(parts):
        low, high = part * ends // parts, (part + 1) * ends // parts
        rows = ev.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        line = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), F.col(n).cast("string")) if n in ("event_id", "value", "timestamp")
                                                        else F.concat(F.lit(f'"{n}": "'), F.col(n), F.lit('"')) for n in names]), F.lit("}"))
        rows.orderBy("event_id").select(line.alias("value")).write.mode("append").text(source)
        at = max(at + 1000, time.time_ns() // 1_000_000)
        _side_by_side(spark, source, known, at)
        yield source


@register(
    "stream_text_changes",
    _changes_sql(EV, "sensor_id", "event_id", "ev")
    + """SELECT g.sensor_id, part, n_changes, round(change_min, 9) AS change_min, round(change_max, 9) AS change_max,
      round(change_mean, 9) AS change_mean, round(volatility, 9) AS volatility, round(jump_size, 9) AS jump_size,
      round(jump_from, 9) AS jump_from, round(jump_to, 9) AS jump_to
      FROM g LEFT JOIN j ON j.k = 1 AND j.sensor_id = g.sensor_id, (VALUES (1), (7)) AS p(part)""",
)
def stream_text_changes(spark, sf):
    """Changes in the order of arrival of text without timestamps, in one batch and in seven: the same."""
    parts, state, whole = (fresh_path(spark, n) for n in ("changes", "state", "changes"))
    for source in _arriving(spark, sf, 7, stamped=False):
        changes.write_changes(stream_readings(spark, source), parts, state, by_time=False).awaitTermination()
    changes.write_changes(stream_readings(spark, source), whole, fresh_path(spark, "state"), by_time=False).awaitTermination()
    found = None
    for batches, path in ((1, whole), (7, parts)):
        one = rounded(changes.read_changes(spark, path), 9).drop("count", "first_ts", "last_ts").withColumn("part", F.lit(batches))
        found = one if found is None else found.unionByName(one)
    return found


@register("stream_sampling", _sampling_sql("sensor_id"))
def stream_sampling(spark, sf):
    """Sampling gaps of events that arrive as text in five parts."""
    path, state = (fresh_path(spark, n) for n in ("gaps", "state"))
    for source in _arriving(spark, sf, 5):
        changes.write_sampling(stream_readings(spark, source), path, state).awaitTermination()
    return changes.read_sampling(spark, path)
