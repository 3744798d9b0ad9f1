"""Time the headline queries on the tables in $BENCH_SF_DIR and print one line of JSON.

Each query is run once to warm up and then $BENCH_RUNS times (default 3); its time is the median.  A run computes
the full result and drops it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugeline.plans import catalogue  # noqa: E402

HEADLINE = (
    "filter_date_range", "allowed_values_semi", "remove_errors", "clean", "unique_rows", "list_rejects", "update_chain",
    "count_by_column", "count_by_day", "count_by_week", "distinct_counts", "latest", "list_errors", "summarise_errors",
    "stats_basic_by_sensor", "stats_quartiles_by_sensor", "stats_outliers_by_sensor", "stats_deltas", "stats_deltas_by_sensor",
    "stats_sampling_by_sensor", "stats_time_range_by_sensor", "stats_all_columns", "stats_deltas_all_columns",
    "tail_column_value", "range_by_sensor", "tail_by_sensor", "downsample", "multi_series_view", "json_render", "csv_widen",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        query, times = catalogue.QUERIES[name], []
        for run in range(runs + 1):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 4)
    spark.stop()
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
