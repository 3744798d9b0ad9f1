"""Queries that write the events as text or Parquet and read them back through the sources."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import json_scalar
from ..model import Readings
from ..operators import counts, errors, stats
from ..operators.columns import widen
from ..operators.filters import FilterSpec, apply_filter
from ..operators.unique import unique
from ..session import fresh_path
from ..sinks import text
from ..sources.error_definitions import error_definitions
from ..sources.readings import allowed_values, list_errors, open_log, read_readings, stage
from .catalogue import BASIC, EV, ERR, QUARTS, LATEST, LATEST_COLUMNS, register, rounded
from .tables import EVENT_ERRORS, event_rows, events

FIELDS = ("sensor_id", "sensor", "value", "timestamp", "k")


def _plain(spark, sf) -> Readings:
    """Events with the plain fields that a log would have."""
    df = event_rows(events(spark, sf))
    return Readings.typed(df, ["event_id", *FIELDS], ["event_id"])


def json_log(spark, sf) -> str:
    path = fresh_path(spark, "events-json")
    text.write_json(_plain(spark, sf), path)
    return path


def csv_log(spark, sf) -> str:
    path = fresh_path(spark, "events-csv")
    text.write_csv(_plain(spark, sf), path)
    return path


def array_log(spark, sf) -> str:
    """Three readings per line, as an array."""
    path = fresh_path(spark, "events-arrays")
    r = _plain(spark, sf)
    pairs = [F.concat(F.lit(f'"{n}": '), json_scalar(r.field(n))) for n in ("event_id", *FIELDS)]
    one = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    lines = r.df.groupBy(F.floor(F.col("event_id") / 3)).agg(F.concat_ws(",", F.collect_list(one)).alias("x"))
    lines.select(F.concat(F.lit("["), "x", F.lit("]")).alias("value")).write.text(path)
    return path


def _values(r: Readings):
    """The columns of ``event_rows`` from a raw frame."""
    return r.df.select(
        r.field("event_id").cast("bigint").alias("event_id"), r.field("sensor_id").alias("sensor_id"),
        r.field("sensor").alias("sensor"), r.number("value").alias("value"), r.timestamp().alias("timestamp"),
        r.field("k").alias("k"),
    )


ALL_ROWS = f"{EV} SELECT event_id, sensor_id, sensor, value, timestamp, k FROM ev"


@register("read_json_lines", ALL_ROWS)
def read_json_lines(spark, sf):
    return _values(read_readings(spark, json_log(spark, sf), format="json"))


@register("read_json_arrays", ALL_ROWS)
def read_json_arrays(spark, sf):
    return _values(read_readings(spark, array_log(spark, sf), format="json"))


LOOSE = [  # lines as loggers leave them, by event_id modulo 8; {0} is the id and {1} the sensor
    '{{"event_id":{0},"value":nan,"sensor":"{1}"}}', '{{"event_id":{0},"sensor":"{1}",}}', '{{"sensor":"{1}" "event_id":{0}}}',
    'boot {{"event_id":{0},"sensor":"{1}"}} ok {{"event_id":-}}', '[{{"event_id":{0},"sensor":"{1}"}},{{"event_id":{0}x,"sensor":abc}}]',
    "{{'event_id':{0}}}", '{{"event_id":{0},"sensor":"{1}","k":"cut', '{{"event_id":+{0},"sensor":"x\\q{1}","o":{{"a":[1,{{"b":2}}]}}}}',
]


@register(
    "read_malformed",
    f"""{EV} SELECT CAST(event_id AS VARCHAR) AS event_id, sensor, CASE WHEN event_id % 8 = 0 THEN 'nan' END AS value, NULL AS o FROM ev
      WHERE event_id % 8 NOT IN (5, 7)
      UNION ALL SELECT '+' || event_id, 'x\\q' || sensor, NULL, '{{"a":[1,{{"b":2}}]}}' FROM ev WHERE event_id % 8 = 7
      UNION ALL SELECT '-', NULL, NULL, NULL FROM ev WHERE event_id % 8 = 3
      UNION ALL SELECT event_id || 'x', 'abc', NULL, NULL FROM ev WHERE event_id % 8 = 4
      UNION ALL SELECT '(unread)', CAST(count(*) AS VARCHAR), NULL, NULL FROM ev WHERE event_id % 8 = 5""",
)
def read_malformed(spark, sf):
    """Readings out of lines that are no proper JSON, and the number of lines without any."""
    ev = event_rows(events(spark, sf))
    lines = [F.format_string(x.replace("%", "%%").format("%1$s", "%2$s"), F.col("event_id").cast("string"), "sensor") for x in LOOSE]
    path = fresh_path(spark, "events-loose")
    ev.select(F.element_at(F.array(*lines), (F.col("event_id") % 8 + 1).cast("int")).alias("value")).write.text(path)
    log = open_log(spark, path, format="json")
    r = log.readings()
    found = r.df.select(*[r.field(c).alias(c) for c in ("event_id", "sensor", "value", "o")])
    nothing = F.lit(None).cast("string")
    unread = log.malformed().agg(F.count(F.lit(1)).cast("string").alias("n"))
    return found.union(unread.select(F.lit("(unread)"), "n", nothing, nothing))


@register("read_csv", ALL_ROWS)
def read_csv(spark, sf):
    return _values(read_readings(spark, csv_log(spark, sf)))


@register(
    "read_line_numbers",
    f"""{EV} SELECT count(*) AS readings, count(*) AS lines, count(*) AS last_lines FROM ev""",
)
def read_line_numbers(spark, sf):
    """Every line of every file has a number of its own, and the largest ones add up to the number of lines."""
    log = open_log(spark, json_log(spark, sf), format="json")
    per_file = log.numbered(log.readings().df).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("line_no").alias("d"), F.max("line_no").alias("last")
    )
    return per_file.agg(F.sum("n").alias("readings"), F.sum("d").alias("lines"), F.sum("last").alias("last_lines"))


@register(
    "read_filtered",
    f"""{EV} SELECT event_id, sensor_id, sensor, value, timestamp, k FROM ev
      WHERE timestamp BETWEEN 1704412800 AND 1705276799 AND sensor <> 'view' AND k <> '' AND ({ERR}) IS NULL""",
)
def read_filtered(spark, sf):
    spec = FilterSpec().dates("05/01/2024", "2024-01-14").exclude_value("sensor", "view").require("k").without_errors(EVENT_ERRORS)
    return _values(apply_filter(read_readings(spark, json_log(spark, sf), format="json"), spec))


@register(
    "read_unique",
    f"""{EV} SELECT count(*) AS readings FROM (SELECT DISTINCT sensor_id, sensor, k FROM ev)""",
)
def read_unique(spark, sf):
    path = fresh_path(spark, "events-json")
    r = _plain(spark, sf)
    text.write_json(Readings.typed(r.df, ["sensor_id", "sensor", "k"], ["event_id"]), path)
    return unique(read_readings(spark, path, format="json")).df.agg(F.count(F.lit(1)).alias("readings"))


@register(
    "read_count_by_day",
    f"""{EV} SELECT sensor, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS day, count(*) AS count
      FROM ev GROUP BY 1, 2""",
)
def read_count_by_day(spark, sf):
    return counts.count_by(read_readings(spark, csv_log(spark, sf)), "sensor", period="day")


@register("read_latest", f"{LATEST} SELECT {LATEST_COLUMNS} FROM l")
def read_latest(spark, sf):
    return counts.latest(read_readings(spark, csv_log(spark, sf)))


@register(
    "read_summarise_errors",
    f"""{EV}, e AS (SELECT ({ERR}) AS description FROM ev)
      SELECT description, count(*) AS count FROM e WHERE description IS NOT NULL GROUP BY description
      UNION ALL SELECT '(total)', count(*) FROM e WHERE description IS NOT NULL""",
)
def read_summarise_errors(spark, sf):
    return errors.summarise_errors(read_readings(spark, json_log(spark, sf), format="json"), EVENT_ERRORS)


@register(
    "read_stats_all",
    f"""{EV}, it AS (SELECT 'value' AS "column", value FROM ev UNION ALL SELECT 'k', CAST(k AS DOUBLE) FROM ev
      UNION ALL SELECT 'sensor_id', CAST(sensor_id AS DOUBLE) FROM ev UNION ALL SELECT 'event_id', event_id FROM ev
      UNION ALL SELECT 'timestamp', timestamp FROM ev)
      , q AS (SELECT "column", {QUARTS} FROM it GROUP BY "column"), b AS (SELECT "column", {BASIC} FROM it GROUP BY "column"),
      o AS (SELECT "column", count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM it JOIN q USING ("column") GROUP BY "column")
      SELECT b.* REPLACE (round(stddev, 4) AS stddev), round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, outliers,
        round(100.0 * outliers / b.count, 6) AS outlier_percent FROM b JOIN q USING ("column") JOIN o USING ("column")""",
)
def read_stats_all(spark, sf):
    """All measures of every field; the deviation of times, some 1e6 around 1e9, to four decimals."""
    found = rounded(stats.value_summary(read_readings(spark, json_log(spark, sf), format="json"), stats.ALL))
    return found.withColumn("stddev", F.round("stddev", 4))


@register(
    "staged_count_by_day",
    f"""{EV} SELECT strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS day, count(*) AS count FROM ev GROUP BY 1""",
)
def staged_count_by_day(spark, sf):
    r = read_readings(spark, json_log(spark, sf), format="json")
    return counts.count_by_period(stage(r, fresh_path(spark, "staged")), "day")


@register(
    "staged_filtered",
    f"""{EV} SELECT event_id, sensor_id, sensor, value, timestamp, k FROM ev WHERE timestamp BETWEEN 1704412800 AND 1705276799""",
)
def staged_filtered(spark, sf):
    staged = stage(read_readings(spark, json_log(spark, sf), format="json"), fresh_path(spark, "staged"))
    return _values(apply_filter(staged, FilterSpec().dates("2024-01-05", "2024-01-14")))


@register("csv_blanks", f"{EV} SELECT event_id, concat(' ', sensor, '  ') AS sensor, concat(k, ' ') AS k FROM ev")
def csv_blanks(spark, sf):
    """Blanks around values survive writing and reading."""
    df = event_rows(events(spark, sf)).select(
        "event_id", F.concat(F.lit(" "), "sensor", F.lit("  ")).alias("sensor"), F.concat("k", F.lit(" ")).alias("k"))
    path = fresh_path(spark, "blanks")
    text.write_csv(Readings.typed(df, ["event_id", "sensor", "k"], ["event_id"]), path)
    r = read_readings(spark, path)
    return r.df.select(r.field("event_id").cast("bigint").alias("event_id"), r.field("sensor").alias("sensor"), r.field("k").alias("k"))


@register(
    "parquet_export",
    f"""{EV} SELECT CAST(event_id AS VARCHAR) AS event_id, k, sensor, sensor_id, CAST(timestamp AS VARCHAR) AS timestamp,
      value FROM ev""",
)
def parquet_export(spark, sf):
    path = fresh_path(spark, "export")
    text.write_parquet(_plain(spark, sf), path)
    return spark.read.parquet(path).withColumn("value", F.col("value").cast("double"))


# -- discovery, configuration files, line numbers --------------------------------------------------------------


def log_by_sensor(spark, sf, one_file: bool = True) -> str:
    """A directory per sensor with one JSON log in the order of events, or with logs that the tasks write side by side."""
    path = fresh_path(spark, "events-by-sensor")
    r = _plain(spark, sf)
    lines = text.rendered_json(r, keep=["event_id"]).withColumnRenamed("line", "value")
    lines = lines.withColumn("kind", F.regexp_extract("value", '"sensor": "([a-z]+)"', 1))
    dealt = lines.repartition("kind") if one_file else lines
    dealt.sortWithinPartitions("kind", "event_id").select("value", "kind").write.partitionBy("kind").text(path)
    return path


@register(
    "read_discovery",
    f"""{EV}, n AS (SELECT sensor, count(*) AS n FROM ev GROUP BY sensor)
      SELECT 'deep' AS how, sensor, n AS count FROM n UNION ALL SELECT 'txt', sensor, n FROM n
      UNION ALL SELECT 'one', sensor, n FROM n WHERE sensor = 'view'""",
)
def read_discovery(spark, sf):
    """What a directory of directories gives: all of it, nothing without going down, nothing of another extension, one directory."""
    path, found = log_by_sensor(spark, sf, one_file=False), None
    ways = {
        "deep": (path, {"recursive": True}), "txt": (path, {"recursive": True, "extension": "txt", "max_depth": 1}), "flat": (path, {}),
        "top": (path, {"recursive": True, "max_depth": 0}), "log": (path, {"recursive": True, "extension": ".log"}), "one": (f"{path}/kind=view", {}),
    }
    for how, (where, options) in ways.items():
        r = read_readings(spark, where, format="json", **options)
        one = counts.count_by(r, "sensor", ordered=False).withColumn("how", F.lit(how))
        found = one if found is None else found.unionByName(one)
    return found


@register(
    "read_list_errors",
    f"""{EV}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY event_id) AS line_no, ({ERR}) AS description FROM ev)
      SELECT sensor, line_no, sensor_id, round(value, 6) AS value, description FROM n WHERE description IS NOT NULL""",
)
def read_list_errors(spark, sf):
    """Error readings with the numbers of their lines."""
    log = open_log(spark, log_by_sensor(spark, sf), format="json", recursive=True)
    found = list_errors(log, EVENT_ERRORS)
    return rounded(found.select("sensor", "line_no", "sensor_id", F.col("value").cast("double").alias("value"), "description"))


def _config(spark, name: str, files: dict[str, list[str]]) -> str:
    """A configuration directory with a few small files."""
    path = fresh_path(spark, name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for file, lines in files.items():
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(path, file), True)
        out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
        out.close()
    return path


@register(
    "read_error_definitions",
    f"""{EV}, e AS (SELECT CASE WHEN sensor = 'view' AND k = '5' THEN 'five: seen' WHEN sensor = 'view' AND k = '7' THEN 'seven'
        WHEN sensor = 'click' AND k = '7' THEN 'clicked' END AS description FROM ev)
      SELECT description, count(*) AS count FROM e WHERE description IS NOT NULL GROUP BY description
      UNION ALL SELECT '(total)', count(*) FROM e WHERE description IS NOT NULL""",
)
def read_error_definitions(spark, sf):
    path = _config(spark, "definitions", {
        "VIEW.errors": ["# codes of views", " k : 5 : five: seen ", "k:7:seven", "k:7:not the first", "k:8:", "k:9", ""], "click.errors": ["k:7:clicked"],
        "notes.txt": ["k:1:no definition"]})
    return errors.summarise_errors(events(spark, sf), error_definitions(spark, path))


@register(
    "read_allowed_file",
    f"""{EV} SELECT event_id, sensor_id, sensor, value, timestamp, k FROM ev WHERE CAST(sensor_id AS INTEGER) % 3 = 0""",
)
def read_allowed_file(spark, sf):
    """Readings of the sensors that a file names, one per line, with blanks around them and empty lines between."""
    r = events(spark, sf)
    path = fresh_path(spark, "allowed")
    named = r.df.select(r.field("sensor_id").alias("id")).where(F.col("id").cast("int") % 3 == 0).distinct()
    named.select(F.explode(F.array(F.concat(F.lit("  "), "id", F.lit("\t")), F.lit(" "))).alias("value")).write.text(path)
    return event_rows(apply_filter(r, FilterSpec().allow("sensor_id", allowed_values(spark, path))))


@register(
    "declared_columns",
    f"""{EV} SELECT CAST(event_id AS VARCHAR) AS event_id, sensor, NULL AS unit FROM ev""",
)
def declared_columns(spark, sf):
    """Columns that were declared: others are dropped, and one that no reading has is there."""
    return widen(read_readings(spark, json_log(spark, sf), format="json"), ["event_id", "sensor", "unit"])


@register(
    "stats_without_numbers",
    f"""{EV} SELECT 'numbers' AS what, count(*) AS count FROM (SELECT 1 FROM ev WHERE sensor SIMILAR TO '[0-9.]+' GROUP BY sensor)
      UNION ALL SELECT 'times', count(*) FROM (SELECT 1 FROM ev HAVING count(*) > 0)""",
)
def stats_without_numbers(spark, sf):
    """A field without numbers gives no row of statistics, though there are times."""
    r = events(spark, sf)
    one = F.count(F.lit(1)).alias("count")
    numbers = stats.stats(r, "sensor").agg(one).withColumn("what", F.lit("numbers"))
    return numbers.unionByName(stats.time_range(r).agg(one).withColumn("what", F.lit("times")))


DATES = {  # layouts of a date by event_id modulo 8, and what is read: D the day, T the time, N nothing
    "%d/%m/%Y": "D", "%Y-%m-%d": "D", "%Y-%m-%dT%H:%M:%S": "T", "31/02/%Y": "N", "%Y-13-01": "N", "1969-12-%d": "N", "2101-01-%d": "N", "%Y-%m-%dT25:00:00": "N",
}


@register(
    "parse_dates",
    f"""{EV}, d AS (SELECT event_id, timestamp AS ts, event_id % {len(DATES)} AS m FROM ev)
      SELECT event_id, CASE WHEN m IN (0, 1) THEN ts - ts % 86400 WHEN m = 2 THEN ts END AS epoch FROM d""",
)
def parse_dates(spark, sf):
    """Dates in all layouts, and what is none: no such day or month, years out of range, no such hour."""
    ev = event_rows(events(spark, sf))
    at = F.timestamp_seconds("timestamp")
    codes = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%H": "HH", "%M": "mm", "%S": "ss"}
    texts = [
        F.concat(*[F.date_format(at, codes[p]) if p in codes else F.lit(p) for p in re.split("(%.)", layout) if p]) for layout in DATES
    ]
    text_ = F.element_at(F.array(*texts), (F.col("event_id") % len(DATES) + 1).cast("int"))
    parsed = F.nullif(dates.parse_date(text_, strict=True), F.lit(0).cast("bigint"))
    return ev.select("event_id", parsed.alias("epoch"))


@register(
    "json_compact",
    f"""{EV} SELECT event_id, concat('[{{"event_id":', event_id, ',"k":', k, ',"sensor":"', sensor, '"}}]') AS line FROM ev""",
)
def json_compact(spark, sf):
    r = events(spark, sf)
    df = r.df.select("event_id", r.field("sensor").alias("sensor"), "k")
    return text.rendered_json(Readings.typed(df, ["event_id", "sensor", "k"], ["event_id"]), compact=True, keep=["event_id"])


@register(
    "results_as_text",
    f"""{EV}, n AS (SELECT sensor, count(*) AS count FROM ev GROUP BY sensor)
      SELECT 'csv' AS form, sensor, count FROM n UNION ALL SELECT 'json', sensor, count FROM n""",
)
def results_as_text(spark, sf):
    """A result table as CSV and as JSON lines, read back."""
    found = counts.count_by(events(spark, sf), "sensor")
    csv, json = fresh_path(spark, "result-csv"), fresh_path(spark, "result-json")
    text.write_result_csv(found, csv)
    text.write_result_json(found, json)
    schema = "sensor string, count bigint"
    return (
        spark.read.schema(schema).option("header", True).csv(csv).withColumn("form", F.lit("csv"))
        .unionByName(spark.read.schema(schema).json(json).withColumn("form", F.lit("json")))
    )
