"""Queries over the given tables, each with the SQL that must give the same rows.

Every query reads its whole tables.  Doubles that are computed are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SLICE_BITS, Readings
from ..operators import columns, counts, errors, series, stats, tail
from ..operators.filters import FilterSpec, apply_filter, reject_reasons
from ..operators.ordered import with_previous
from ..operators.unique import unique
from ..operators.updates import Update, apply_updates
from ..sinks.text import rendered_json
from .tables import EVENT_ERRORS, event_rows, events, lineitem, orders, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.round(c, places).alias(c) if c in doubles else F.col(c) for c in df.columns])


def _events_sql(k: str = "{k}") -> str:
    code = k.replace("{k}", """regexp_extract(props, '"k": ([0-9]+)', 1)""")
    return f"""SELECT event_id, CAST(user_id AS VARCHAR) AS sensor_id, event_type AS sensor, value,
        CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, {code} AS k FROM events"""


EV = f"WITH ev AS ({_events_sql()})"
ROWS = "event_id, sensor_id, sensor, value, timestamp, k"
ORD = """WITH ord AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS sensor_id, o_orderstatus AS sensor,
    o_totalprice AS value, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS timestamp, o_orderdate FROM orders)"""
ERR = """CASE WHEN sensor = 'purchase' AND k = '85' THEN 'comm error' WHEN sensor = 'view' AND k = '0' THEN 'reset'
    WHEN sensor = 'view' AND k = '85' THEN 'view error' END"""

LOW, HIGH = 1704412800, 1705276799  # 2024-01-05 00:00:00 and 2024-01-14 23:59:59


def _empty_zero(k):
    return F.when(k == "0", F.lit("")).otherwise(k)


def _null_zero(k):
    return F.when(k == "0", F.lit("null")).when(k == "1", F.lit(None)).otherwise(k)


# -- filters ---------------------------------------------------------------------------------------------------


def _filtered(spec: FilterSpec, k=None) -> Query:
    return lambda spark, sf: event_rows(apply_filter(events(spark, sf, k), spec))


register("filter_date_range", f"{EV} SELECT {ROWS} FROM ev WHERE timestamp BETWEEN {LOW} AND {HIGH}")(
    _filtered(FilterSpec().dates("2024-01-05", "2024-01-14"))
)
register("filter_only_value", f"{EV} SELECT {ROWS} FROM ev WHERE sensor IN ('click', 'view') AND k IN ('1', '2', '3')")(
    _filtered(FilterSpec().only_value("sensor", "click", "view").only_value("k", "1", "2", "3"))
)
register("filter_exclude_value", f"{EV} SELECT {ROWS} FROM ev WHERE sensor NOT IN ('click', 'error')")(
    _filtered(FilterSpec().exclude_value("sensor", "click", "error"))
)
register("filter_allowed_values", f"{EV} SELECT {ROWS} FROM ev WHERE sensor_id IN ('7', '8', '9', '46') AND sensor = 'view'")(
    _filtered(FilterSpec().allow("sensor_id", ["7", " 8 ", "9", "46", ""]).only_value("sensor", "view"))
)
register(
    "filter_not_empty",
    f"WITH ev AS ({_events_sql('''CASE WHEN {k} = '0' THEN '' ELSE {k} END''')}) SELECT {ROWS} FROM ev WHERE k <> ''",
)(_filtered(FilterSpec().require("k"), _empty_zero))
NULLED = f"WITH ev AS ({_events_sql('''CASE WHEN {k} = '0' THEN 'null' WHEN {k} = '1' THEN NULL ELSE {k} END''')})"
register("filter_not_null", f"{NULLED} SELECT {ROWS} FROM ev WHERE k IS NULL OR k <> 'null'")(
    _filtered(FilterSpec().forbid_null("k"), _null_zero)
)


@register(
    "allowed_values_semi",
    f"{EV} SELECT {ROWS} FROM ev WHERE sensor_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)",
)
def allowed_values_semi(spark, sf):
    wanted = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    return event_rows(apply_filter(events(spark, sf), FilterSpec().allow("sensor_id", wanted)))


@register(
    "allowed_values_rejects",
    f"{EV} SELECT {ROWS} FROM ev WHERE NOT (sensor_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0))",
)
def allowed_values_rejects(spark, sf):
    wanted = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    return event_rows(apply_filter(events(spark, sf), FilterSpec().allow("sensor_id", wanted).rejects()))


register("remove_errors", f"{EV} SELECT {ROWS} FROM ev WHERE ({ERR}) IS NULL")(
    _filtered(FilterSpec().without_errors(EVENT_ERRORS))
)


def _few_columns(r: Readings) -> Readings:
    """Events without their times and values, so that there are copies."""
    df = r.df.select("event_id", r.field("sensor_id").alias("sensor_id"), r.field("sensor").alias("sensor"), "k")
    return Readings.typed(df, ["sensor_id", "sensor", "k"], ["event_id"])


@register("unique_rows", f"{EV} SELECT min(event_id) AS event_id, sensor_id, sensor, k FROM ev GROUP BY sensor_id, sensor, k")
def unique_rows(spark, sf):
    return unique(_few_columns(events(spark, sf))).df


CLEAN = FilterSpec().clean(EVENT_ERRORS)


@register(
    "clean",
    f"""{EV} SELECT min(event_id) AS event_id, sensor_id, sensor, value FROM (
      SELECT event_id, sensor_id, sensor, k AS value, ({ERR}) AS e FROM ev) WHERE e IS NULL AND value <> ''
      AND value <> 'null' GROUP BY sensor_id, sensor, value""",
)
def clean(spark, sf):
    r = _few_columns(events(spark, sf))
    r = Readings.typed(r.df.withColumnRenamed("k", "value"), ["sensor_id", "sensor", "value"], ["event_id"])
    definitions = [errors.ErrorDefinition(d.sensor, "value", d.value, d.description) for d in EVENT_ERRORS]
    return apply_filter(r, FilterSpec().clean(definitions)).df


REJECTING = FilterSpec().dates("2024-01-05", "2024-01-14").require("k").exclude_value("sensor", "signup").without_errors(EVENT_ERRORS)
EMPTIED = f"WITH ev AS ({_events_sql('''CASE WHEN {k} = '3' THEN NULL WHEN {k} = '4' THEN '' ELSE {k} END''')})"


def _some_missing(k):
    return F.when(k == "3", F.lit(None)).when(k == "4", F.lit("")).otherwise(k)


register(
    "list_rejects",
    f"""{EMPTIED} SELECT {ROWS} FROM ev WHERE NOT (timestamp BETWEEN {LOW} AND {HIGH} AND coalesce(k, '') <> ''
      AND sensor <> 'signup' AND ({ERR}) IS NULL)""",
)(_filtered(REJECTING.rejects(), _some_missing))


@register(
    "reject_reasons",
    f"""{EMPTIED} SELECT * FROM (SELECT event_id, CASE WHEN NOT timestamp BETWEEN {LOW} AND {HIGH} THEN 'outside date range'
      WHEN coalesce(k, '') = '' THEN 'empty or missing: k' WHEN sensor = 'signup' THEN 'excluded value: sensor'
      WHEN ({ERR}) IS NOT NULL THEN 'error reading' END AS reason,
      CAST((NOT timestamp BETWEEN {LOW} AND {HIGH}) AS INTEGER) + CAST((coalesce(k, '') = '') AS INTEGER)
      + CAST((sensor = 'signup') AS INTEGER) + CAST((({ERR}) IS NOT NULL) AS INTEGER) AS n_reasons FROM ev)
      WHERE reason IS NOT NULL""",
)
def list_reject_reasons(spark, sf):
    found = reject_reasons(events(spark, sf, _some_missing), REJECTING).df
    return found.select("event_id", "reason", F.size("reasons").alias("n_reasons"))


# -- updates ---------------------------------------------------------------------------------------------------


@register(
    "update_value",
    f"{EV} SELECT {ROWS}, CASE WHEN sensor = 'click' THEN 'C' END AS unit FROM ev",
)
def update_value(spark, sf):
    r = apply_updates(events(spark, sf), [Update("sensor", "click", "unit", "C")])
    return event_rows(r, "unit")


@register(
    "update_where_empty",
    f"""{EMPTIED} SELECT event_id, sensor_id, sensor, value, timestamp,
      CASE WHEN sensor = 'view' AND coalesce(k, '') = '' THEN 'none' ELSE k END AS k FROM ev""",
)
def update_where_empty(spark, sf):
    rule = Update("sensor", "view", "k", "none", only_when_empty=True)
    return event_rows(apply_updates(events(spark, sf, _some_missing), [rule]))


@register(
    "update_chain",
    f"""{EV}, a AS (SELECT * REPLACE (CASE WHEN sensor = 'click' THEN 'tap' ELSE sensor END AS sensor) FROM ev),
      b AS (SELECT * REPLACE (CASE WHEN sensor = 'tap' THEN '1000' ELSE k END AS k) FROM a)
      SELECT {ROWS}, CASE WHEN k = '1000' THEN 'patched' WHEN sensor = 'view' THEN 'seen' END AS note FROM b""",
)
def update_chain(spark, sf):
    rules = [
        Update("sensor", "click", "sensor", "tap"), Update("sensor", "tap", "k", "1000"),
        Update("k", "1000", "note", "patched"), Update("sensor", "view", "note", "seen", only_when_empty=True),
    ]
    r = apply_updates(events(spark, sf), rules)
    return event_rows(r, "note")


# -- counts ----------------------------------------------------------------------------------------------------


@register("count_all", "SELECT count(*) AS count FROM events")
def count_all(spark, sf):
    return counts.count(events(spark, sf))


@register("count_by_column", f"{EV} SELECT sensor, count(*) AS count FROM ev GROUP BY sensor")
def count_by_column(spark, sf):
    return counts.count_by(events(spark, sf), "sensor")


@register("count_by_missing", f"{EMPTIED} SELECT coalesce(k, '(missing)') AS k, count(*) AS count FROM ev GROUP BY 1")
def count_by_missing(spark, sf):
    return counts.count_by(events(spark, sf, _some_missing), "k")


@register(
    "count_by_column_and_day",
    f"""{EV} SELECT sensor, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS day, count(*) AS count
      FROM ev GROUP BY 1, 2""",
)
def count_by_column_and_day(spark, sf):
    return counts.count_by(events(spark, sf), "sensor", period="day")


for _period, _format in (("day", "%Y-%m-%d"), ("week", "%G-W%V"), ("month", "%Y-%m"), ("year", "%Y")):
    register(
        f"count_by_{_period}", f"SELECT strftime(o_orderdate, '{_format}') AS {_period}, count(*) AS count FROM orders GROUP BY 1"
    )(lambda spark, sf, _period=_period: counts.count_by_period(orders(spark, sf), _period))


@register("distinct_values", f"{EV} SELECT DISTINCT k FROM ev WHERE k <> ''")
def distinct_values(spark, sf):
    return counts.distinct(events(spark, sf), "k")


@register("distinct_counts", f"{EV} SELECT k, count(*) AS count FROM ev WHERE k <> '' GROUP BY k")
def distinct_counts(spark, sf):
    return counts.distinct_counts(events(spark, sf), "k")


LATEST = f"{EV}, l AS (SELECT sensor_id, max(timestamp) AS timestamp FROM ev WHERE timestamp > 0 GROUP BY sensor_id)"
LATEST_COLUMNS = "sensor_id, timestamp, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS iso_date"


@register("latest", f"{LATEST} SELECT {LATEST_COLUMNS} FROM l")
def latest(spark, sf):
    return counts.latest(events(spark, sf))


@register("latest_first_n", f"{LATEST} SELECT {LATEST_COLUMNS} FROM l ORDER BY sensor_id LIMIT 5")
def latest_first_n(spark, sf):
    return counts.latest(events(spark, sf), 5)


@register("latest_last_n", f"{LATEST} SELECT {LATEST_COLUMNS} FROM l ORDER BY sensor_id DESC LIMIT 5")
def latest_last_n(spark, sf):
    return counts.latest(events(spark, sf), -5)


# -- errors ----------------------------------------------------------------------------------------------------


@register(
    "list_errors",
    f"""{EV} SELECT event_id, sensor, sensor_id, CAST(NULL AS VARCHAR) AS name, round(value, 6) AS value,
      CAST(NULL AS VARCHAR) AS temperature, ({ERR}) AS description FROM ev WHERE ({ERR}) IS NOT NULL""",
)
def list_errors(spark, sf):
    found = errors.list_errors(events(spark, sf), EVENT_ERRORS)
    return found.withColumn("value", F.round(F.col("value").cast("double"), 6))


@register(
    "summarise_errors",
    f"""{EV}, e AS (SELECT ({ERR}) AS description FROM ev)
      SELECT description, count(*) AS count FROM e WHERE description IS NOT NULL GROUP BY description
      UNION ALL SELECT '(total)', count(*) FROM e WHERE description IS NOT NULL""",
)
def summarise_errors(spark, sf):
    return errors.summarise_errors(events(spark, sf), EVENT_ERRORS)


# -- statistics ------------------------------------------------------------------------------------------------

BASIC = """count(*) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max,
    round(max(value) - min(value), 6) AS range, round(avg(value), 6) AS mean,
    round(coalesce(stddev_samp(value), 0), 6) AS stddev"""
QUARTS = """quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3"""
LONG_ITEMS = """WITH it AS (SELECT 'quantity' AS "column", l_quantity AS value, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    UNION ALL SELECT 'price', l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    UNION ALL SELECT 'discount', l_discount, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    UNION ALL SELECT 'tax', l_tax, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
ITEM_COLUMNS = ("quantity", "price", "discount", "tax")


@register("stats_basic", f"""{EV} SELECT 'value' AS "column", {BASIC} FROM ev""")
def stats_basic(spark, sf):
    return rounded(stats.basic(events(spark, sf)))


@register("stats_basic_by_sensor", f"""{EV} SELECT sensor_id, 'value' AS "column", {BASIC} FROM ev GROUP BY sensor_id""")
def stats_basic_by_sensor(spark, sf):
    return rounded(stats.basic(events(spark, sf), by=["sensor_id"]))


@register(
    "stats_quartiles",
    f"""{EV}, q AS (SELECT {QUARTS} FROM ev) SELECT 'value' AS "column", round(q1, 6) AS q1, round(median, 6) AS median,
      round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr FROM q""",
)
def stats_quartiles(spark, sf):
    return rounded(stats.quartiles(events(spark, sf)))


@register(
    "stats_quartiles_by_sensor",
    f"""{EV}, q AS (SELECT sensor_id, {QUARTS} FROM ev GROUP BY sensor_id) SELECT sensor_id, 'value' AS "column",
      round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr FROM q""",
)
def stats_quartiles_by_sensor(spark, sf):
    return rounded(stats.quartiles(events(spark, sf), by=["sensor_id"]))


@register(
    "stats_quartiles_large_groups",
    f"""{EV}, q AS (SELECT sensor, {QUARTS} FROM ev GROUP BY sensor) SELECT sensor, 'value' AS "column",
      round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr FROM q""",
)
def stats_quartiles_large_groups(spark, sf):
    return rounded(stats.quartiles(events(spark, sf), by=["sensor"]))


@register(
    "stats_outliers",
    f"""{EV}, q AS (SELECT {QUARTS} FROM ev), o AS (SELECT count(*) AS n, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1)
      OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM ev, q)
      SELECT 'value' AS "column", outliers, round(100.0 * outliers / n, 6) AS outlier_percent FROM o""",
)
def stats_outliers(spark, sf):
    return rounded(stats.outliers(events(spark, sf)))


@register(
    "stats_outliers_by_sensor",
    f"""{EV}, q AS (SELECT sensor_id, {QUARTS} FROM ev GROUP BY sensor_id), o AS (SELECT sensor_id, count(*) AS n,
      count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
      FROM ev JOIN q USING (sensor_id) GROUP BY sensor_id)
      SELECT sensor_id, 'value' AS "column", outliers, round(100.0 * outliers / n, 6) AS outlier_percent FROM o""",
)
def stats_outliers_by_sensor(spark, sf):
    return rounded(stats.outliers(events(spark, sf), by=["sensor_id"]))


def _changes_sql(source: str, by: str, order: str, group: str) -> str:
    over = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {order})"
    keys = f"{by}, " if by else ""
    return f"""{source}, d AS (SELECT {keys}value, lag(value) {over} AS before, row_number() {over} AS rn FROM {group}),
      c AS (SELECT *, abs(value - before) AS change FROM d),
      g AS (SELECT {keys}count(change) AS n_changes, min(change) AS change_min, max(change) AS change_max,
        avg(change) AS change_mean, coalesce(stddev_samp(change), CASE WHEN count(change) = 1 THEN 0 END) AS volatility,
        max(change) AS jump_size FROM c {f'GROUP BY {by}' if by else ''}),
      j AS (SELECT {keys}before AS jump_from, value AS jump_to, row_number() OVER (
        {f'PARTITION BY {by} ' if by else ''}ORDER BY change DESC NULLS LAST, rn) AS k FROM c WHERE change IS NOT NULL)"""


def _changes_select(by: str, column: str) -> str:
    join = f"LEFT JOIN j ON j.k = 1 {' '.join(f'AND g.{b} = j.{b}' for b in by.split(', ') if b)}"
    keys = "".join(f"g.{b}, " for b in by.split(", ") if b)
    return f"""SELECT {keys}{column}n_changes, round(change_min, 6) AS change_min, round(change_max, 6) AS change_max,
      round(change_mean, 6) AS change_mean, round(volatility, 6) AS volatility, round(jump_size, 6) AS jump_size,
      round(jump_from, 6) AS jump_from, round(jump_to, 6) AS jump_to FROM g {join}"""


VALUE_COLUMN = """'value' AS "column", """


@register("stats_deltas", _changes_sql(EV, "", "event_id", "ev") + _changes_select("", VALUE_COLUMN))
def stats_deltas(spark, sf):
    return rounded(stats.changes(events(spark, sf)))


@register("stats_deltas_by_sensor", _changes_sql(EV, "sensor_id", "event_id", "ev") + _changes_select("sensor_id", VALUE_COLUMN))
def stats_deltas_by_sensor(spark, sf):
    return rounded(stats.changes(events(spark, sf), by=["sensor_id"]))


@register(
    "stats_deltas_large_groups",
    _changes_sql(EV, "sensor", "timestamp, event_id", "ev") + _changes_select("sensor", VALUE_COLUMN),
)
def stats_deltas_large_groups(spark, sf):
    return rounded(stats.changes(events(spark, sf), by=["sensor"], order="timestamp"))


@register(
    "stats_deltas_sparse_ids",
    f"""{EV}, h AS (SELECT value, (event_id * 2971215073 + 1134903170) % 4611686018427387847 * 911 % 4611686018427387847 AS id FROM (
        SELECT value, CAST(event_id AS HUGEINT) AS event_id FROM ev)), """
    + _changes_sql("", "", "id", "h").lstrip(", ") + _changes_select("", VALUE_COLUMN),
)
def stats_deltas_sparse_ids(spark, sf):
    """Changes in the order of ids that are spread over 62 bits."""
    r = events(spark, sf)
    prime = F.lit("4611686018427387847").cast("decimal(38,0)")
    first = (F.col("event_id").cast("decimal(19,0)") * F.lit("2971215073").cast("decimal(10,0)") + F.lit(1134903170).cast("decimal(10,0)")) % prime
    spread = (first.cast("decimal(19,0)") * F.lit(911).cast("decimal(3,0)") % prime).cast("bigint")
    return rounded(stats.changes(Readings.typed(r.df.withColumn("id", spread), r.columns, ["id"])))


@register(
    "stats_max_jump",
    _changes_sql(EV, "sensor", "event_id", "ev")
    + "SELECT g.sensor, round(jump_size, 6) AS jump_size, round(jump_from, 6) AS jump_from, round(jump_to, 6) AS jump_to"
    + " FROM g JOIN j ON j.k = 1 AND g.sensor = j.sensor",
)
def stats_max_jump(spark, sf):
    found = stats.changes(events(spark, sf), by=["sensor"])
    return rounded(found.select("sensor", "jump_size", "jump_from", "jump_to"))


@register(
    "previous_reading",
    f"""{EV} SELECT event_id, sensor, round(value, 6) AS value, round(lag(value) OVER w, 6) AS previous_value,
      lag(timestamp) OVER w AS previous_timestamp FROM ev WINDOW w AS (PARTITION BY sensor ORDER BY timestamp, event_id)""",
)
def previous_reading(spark, sf):
    rows = event_rows(events(spark, sf))
    levels = [[F.shiftright("timestamp", stats.TIME_BITS)], [F.col("timestamp"), F.shiftright("event_id", 20)]]
    found = with_previous(rows, ["sensor"], ["timestamp", "event_id"], levels, ["value", "timestamp"])
    return rounded(found.select(
        "event_id", "sensor", "value", F.col("previous.value").alias("previous_value"),
        F.col("previous.timestamp").alias("previous_timestamp"),
    ))


@register(
    "previous_reading_overall",
    f"""{EV} SELECT event_id, round(value, 6) AS value, round(lag(value) OVER (ORDER BY event_id), 6) AS previous_value FROM ev""",
)
def previous_reading_overall(spark, sf):
    rows = event_rows(events(spark, sf))
    found = with_previous(rows, [], ["event_id"], [[F.shiftright("event_id", SLICE_BITS)]], ["value"])
    return rounded(found.select("event_id", "value", F.col("previous.value").alias("previous_value")))


def _range_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    text = "%Y-%m-%d %H:%M:%S"
    return f"""{EV}, t AS (SELECT {keys}min(timestamp) AS first, max(timestamp) AS last, count(*) AS n_timestamps,
        max(timestamp) - min(timestamp) AS duration FROM ev {f'GROUP BY {by}' if by else ''})
      SELECT {keys}first, last, strftime(make_timestamp(first * 1000000), '{text}') AS first_text,
        strftime(make_timestamp(last * 1000000), '{text}') AS last_text, duration, n_timestamps,
        CASE WHEN duration > 0 THEN round(n_timestamps / (duration / 3600.0::DOUBLE), 6) END AS per_hour,
        CASE WHEN duration > 0 THEN round(n_timestamps / (duration / 86400.0::DOUBLE), 6) END AS per_day,
        concat(CASE WHEN duration >= 86400 THEN concat(duration // 86400, 'd ') ELSE '' END,
          CASE WHEN duration >= 3600 THEN concat((duration % 86400) // 3600, 'h ') ELSE '' END,
          CASE WHEN duration >= 60 THEN concat((duration % 3600) // 60, 'm ') ELSE '' END, duration % 60, 's') AS duration_text
      FROM t"""


@register("stats_time_range", _range_sql(""))
def stats_time_range(spark, sf):
    return rounded(stats.time_range(events(spark, sf)))


@register("stats_time_range_by_sensor", _range_sql("sensor_id"))
def stats_time_range_by_sensor(spark, sf):
    return rounded(stats.time_range(events(spark, sf), by=["sensor_id"]))


def _sampling_sql(by: str) -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    over = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY timestamp, event_id)"
    return f"""{EV}, d AS (SELECT {keys}timestamp - lag(timestamp) {over} AS d FROM ev),
      m AS (SELECT {keys}percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC) AS typical_interval FROM d WHERE d IS NOT NULL {group})
      SELECT {keys}typical_interval, count(*) FILTER (WHERE d > 3 * typical_interval) AS gaps,
        max(d) FILTER (WHERE d > 3 * typical_interval) AS max_gap
      FROM d JOIN m {f'USING ({by})' if by else 'ON true'} WHERE d IS NOT NULL GROUP BY {keys}typical_interval"""


@register("stats_sampling", _sampling_sql(""))
def stats_sampling(spark, sf):
    return stats.sampling(events(spark, sf))


@register("stats_sampling_by_sensor", _sampling_sql("sensor_id"))
def stats_sampling_by_sensor(spark, sf):
    return stats.sampling(events(spark, sf), by=["sensor_id"])


@register(
    "stats_all_columns",
    f"""{LONG_ITEMS}, q AS (SELECT "column", {QUARTS} FROM it GROUP BY "column"),
      b AS (SELECT "column", {BASIC} FROM it GROUP BY "column"),
      o AS (SELECT "column", count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM it JOIN q USING ("column") GROUP BY "column")
      SELECT b.*, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, outliers,
        round(100.0 * outliers / b.count, 6) AS outlier_percent FROM b JOIN q USING ("column") JOIN o USING ("column")""",
)
def stats_all_columns(spark, sf):
    return rounded(stats.value_summary(lineitem(spark, sf), ITEM_COLUMNS))


@register(
    "stats_deltas_all_columns",
    _changes_sql(LONG_ITEMS, '"column"', "l_orderkey, l_linenumber, l_partkey, l_suppkey", "it") + _changes_select('"column"', ""),
)
def stats_deltas_all_columns(spark, sf):
    return rounded(stats.changes(lineitem(spark, sf), ITEM_COLUMNS))


@register(
    "stats_full_by_sensor",
    f"""{ORD}, q AS (SELECT sensor, {QUARTS} FROM ord GROUP BY sensor), b AS (SELECT sensor, {BASIC} FROM ord GROUP BY sensor),
      o AS (SELECT sensor, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM ord JOIN q USING (sensor) GROUP BY sensor), z AS (SELECT sensor, value, lag(value) OVER (PARTITION BY sensor
        ORDER BY o_orderkey) AS before, o_orderkey FROM ord), c AS (SELECT *, abs(value - before) AS change FROM z),
      g AS (SELECT sensor, count(change) AS n_changes, min(change) AS change_min, max(change) AS change_max,
        avg(change) AS change_mean, stddev_samp(change) AS volatility, arg_min(before, (-change, o_orderkey)) AS jump_from,
        arg_min(value, (-change, o_orderkey)) AS jump_to FROM c WHERE change IS NOT NULL GROUP BY sensor)
      SELECT b.sensor, 'value' AS "column", b.* EXCLUDE (sensor), round(q1, 6) AS q1, round(median, 6) AS median,
        round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, outliers, round(100.0 * outliers / b.count, 6) AS outlier_percent,
        n_changes, round(change_min, 6) AS change_min, round(change_max, 6) AS change_max, round(change_mean, 6) AS change_mean,
        round(volatility, 6) AS volatility, round(change_max, 6) AS jump_size, round(jump_from, 6) AS jump_from,
        round(jump_to, 6) AS jump_to
      FROM b JOIN q USING (sensor) JOIN o USING (sensor) JOIN g USING (sensor)""",
)
def stats_full_by_sensor(spark, sf):
    return rounded(stats.stats(orders(spark, sf), by=["sensor"]))


# -- last rows, series -----------------------------------------------------------------------------------------


def _by_kind(r: Readings) -> Readings:
    """Events with their type as the source they came from."""
    return Readings.typed(r.df, {**r.columns, "source": "event_type"}, r.order)


@register(
    "tail_lines",
    f"""{EV} SELECT {ROWS} FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY event_id DESC) AS rn FROM ev)
      WHERE rn <= 20 AND k <> '0'""",
)
def tail_lines(spark, sf):
    return event_rows(apply_filter(tail.tail(_by_kind(events(spark, sf)), 20), FilterSpec().exclude_value("k", "0")))


@register(
    "tail_column_value",
    f"""{EV} SELECT {ROWS} FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY event_id DESC) AS rn FROM ev
      WHERE k = '7' AND timestamp >= {LOW}) WHERE rn <= 3""",
)
def tail_column_value(spark, sf):
    spec = FilterSpec().dates(low="2024-01-05")
    return event_rows(tail.tail_column_value(_by_kind(events(spark, sf)), "k", "7", 3, spec))


@register(
    "tail_column_value_unique",
    f"""{EV} SELECT * FROM (SELECT max(event_id) AS event_id, sensor_id, sensor, k FROM ev WHERE k = '7'
      GROUP BY sensor_id, sensor, k) ORDER BY event_id DESC LIMIT 12""",
)
def tail_column_value_unique(spark, sf):
    return tail.tail_column_value(_few_columns(events(spark, sf)), "k", "7", 12, FilterSpec().once()).df


IDS = ("7", "8", "46")
IDS_SQL = "('7', '8', '46')"


@register(
    "range_by_sensor",
    f"{EV} SELECT sensor_id, timestamp, value FROM ev WHERE sensor_id IN {IDS_SQL} AND timestamp BETWEEN {LOW} AND {HIGH}",
)
def range_by_sensor(spark, sf):
    return series.range_by_sensor(events(spark, sf), IDS, LOW, HIGH)


@register(
    "range_by_sensor_table",
    f"""{EV} SELECT sensor_id, timestamp, value FROM ev WHERE timestamp BETWEEN {LOW} AND {HIGH}
      AND sensor_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)""",
)
def range_by_sensor_table(spark, sf):
    wanted = table(spark, sf, "supplier").select("s_suppkey")
    return series.range_by_sensor(events(spark, sf), wanted, LOW, HIGH)


for _name, _way, _operator in (("tail", "DESC", series.tail_by_sensor), ("head", "ASC", series.head_by_sensor)):
    register(
        f"{_name}_by_sensor",
        f"""{EV} SELECT sensor_id, timestamp, value FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id
          ORDER BY timestamp {_way}, event_id {_way}) AS rn FROM ev) WHERE rn <= 4""",
    )(lambda spark, sf, _operator=_operator: _operator(events(spark, sf), None, 4))


@register("earliest_latest", f"{EV} SELECT min(timestamp) AS earliest, max(timestamp) AS latest FROM ev WHERE sensor_id IN {IDS_SQL}")
def earliest_latest(spark, sf):
    return series.earliest_latest(events(spark, sf), IDS)


def _downsample_sql(buckets: int, low: int, high: int, where: str = "") -> str:
    width = f"(({high} - {low})::DOUBLE / {buckets})"
    return f"""{EV}, b AS (SELECT i AS bucket, {low} + CAST(floor(i * {width}) AS BIGINT) AS bucket_start,
        {low} + CAST(floor((i + 1) * {width}) AS BIGINT) AS bucket_end FROM (SELECT unnest(range({buckets})) AS i)),
      p AS (SELECT sensor_id, CAST(bucket AS INTEGER) AS bucket, bucket_start, avg(value) AS value FROM ev
        JOIN b ON timestamp >= bucket_start AND timestamp < bucket_end {where} GROUP BY 1, 2, 3)"""


@register(
    "downsample",
    _downsample_sql(37, LOW, HIGH) + "SELECT sensor_id, bucket, bucket_start, round(value, 6) AS value FROM p",
)
def downsample(spark, sf):
    return rounded(series.downsample(events(spark, sf), None, LOW, HIGH, 37))


@register(
    "downsample_1000",
    _downsample_sql(1000, LOW, HIGH, f"WHERE sensor_id IN {IDS_SQL}") + "SELECT sensor_id, bucket, bucket_start, round(value, 6) AS value FROM p",
)
def downsample_1000(spark, sf):
    return rounded(series.downsample(events(spark, sf), IDS, LOW, HIGH, 1000))


@register(
    "update_unmapped_column",
    f"""{EV} SELECT event_id, sensor_id, sensor, CASE WHEN sensor = 'view' THEN '9' END AS patched, k FROM ev""",
)
def update_unmapped_column(spark, sf):
    """A new field with the name of a column that is mapped to none leaves that column, the order of events, alone."""
    r = apply_updates(events(spark, sf), [Update("sensor", "view", "event_id", "9")])
    return r.df.select("event_id", r.field("sensor_id").alias("sensor_id"), r.field("sensor").alias("sensor"), r.field("event_id").alias("patched"), r.field("k").alias("k"))


@register(
    "error_table",
    f"""{EV}, d AS (SELECT DISTINCT CAST(l_quantity AS INTEGER)::VARCHAR AS code FROM lineitem)
      SELECT event_id, sensor, k, concat('code ', k) AS description FROM ev WHERE sensor = 'view' AND k IN (SELECT code FROM d)""",
)
def error_table(spark, sf):
    """Error definitions that are a table, one for every row of ``lineitem``."""
    lines = table(spark, sf, "lineitem")
    code = F.col("l_quantity").cast("int").cast("string")
    codes = lines.select(
        F.lit("VIEW").alias("sensor"), F.lit("k").alias("field"), code.alias("value"), F.concat(F.lit("code "), code).alias("description"),
        F.col("l_orderkey").alias("rank"))
    r = events(spark, sf)
    marked = errors.with_error(r, codes).df.where(F.col("_error").isNotNull())
    return marked.select("event_id", r.field("sensor").alias("sensor"), r.field("k").alias("k"), F.col("_error").alias("description"))


VIEW_END = 1706659200
VIEW_START = VIEW_END - 7 * 86400


@register(
    "multi_series_view",
    _downsample_sql(400, VIEW_START, VIEW_END, f"WHERE sensor_id IN {IDS_SQL}")
    + """SELECT sensor_id, bucket, bucket_start, round(value, 6) AS value,
      round(min(value) OVER (PARTITION BY sensor_id), 6) AS min_value,
      round(max(value) OVER (PARTITION BY sensor_id), 6) AS max_value FROM p""",
)
def multi_series_view(spark, sf):
    start, end = series.view_window("week", VIEW_END)
    return rounded(series.multi_series_view(events(spark, sf), IDS, start, end))


# -- rendering -------------------------------------------------------------------------------------------------


@register(
    "json_render",
    f"""{EV} SELECT event_id, concat('[ {{ "k": ', k, ', "note": ', CASE WHEN k = '5' THEN 'null' ELSE concat('"', sensor, ' "', '' , '"') END,
      ', "sensor": "', sensor, '", "sensor_id": ', sensor_id, ', "timestamp": ', timestamp, ' }} ]') AS line FROM ev"""
    .replace("""concat('"', sensor, ' "', '' , '"')""", """concat('"', sensor, ' \\"x\\""')"""),
)
def json_render(spark, sf):
    r = events(spark, sf)
    note = F.when(F.col("k") == "5", F.lit("")).otherwise(F.concat("event_type", F.lit(' "x"')))
    df = r.df.select(
        "event_id", r.field("sensor_id").alias("sensor_id"), r.field("sensor").alias("sensor"),
        r.timestamp().alias("timestamp"), "k", note.alias("note"),
    )
    typed = Readings.typed(df, ["sensor_id", "sensor", "timestamp", "k", "note"], ["event_id"])
    return rendered_json(typed, keep=["event_id"])


@register(
    "csv_widen",
    f"""{EV} SELECT event_id, CASE WHEN sensor = 'view' THEN k END AS seen, CASE WHEN sensor = 'click' THEN k END AS clicked,
      sensor FROM ev""",
)
def csv_widen(spark, sf):
    r = events(spark, sf)
    fields = F.map_filter(
        F.create_map(
            F.lit("sensor"), F.col("event_type"), F.lit("seen"), F.when(F.col("event_type") == "view", F.col("k")),
            F.lit("clicked"), F.when(F.col("event_type") == "click", F.col("k")),
        ),
        lambda _, v: v.isNotNull(),
    )
    df = r.df.select(
        F.lit("events").alias("source"), F.lit(0).cast("bigint").alias("block"), F.col("event_id").alias("row"),
        F.lit(0).alias("pos"), fields.alias("fields"), "event_id",
    )
    return columns.widen(Readings(df), keep=["event_id"])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    clean_events = apply_filter(events(spark, sf), FilterSpec().dates("2024-01-01", "2024-12-31").without_errors(EVENT_ERRORS))
    return stats.stats(clean_events, by=["sensor"])
