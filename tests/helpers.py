"""Small frames and files for tests."""

from __future__ import annotations

import json

from gaugeline.model import Readings


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")
    return str(path)


def raw(spark, rows, source="mem"):
    """Readings from dicts, in this order."""
    data = [(source, 0, i, 0, {k: str(v) for k, v in row.items()}) for i, row in enumerate(rows)]
    df = spark.createDataFrame(data, "source string, block bigint, row bigint, pos int, fields map<string,string>")
    return Readings(df)


def values(rows, **more):
    return [{"sensor": "ds18b20", "value": v, **more} for v in rows]


def fields(r):
    """The maps of a raw frame in arrival order."""
    rows = r.df.orderBy(*r.order).select("fields").collect()
    return [dict(x["fields"]) for x in rows]


def json_lines(rows):
    return "".join(json.dumps(x) + "\n" for x in rows)


def pairs(df):
    return {row[0]: row[1] for row in df.collect()}
