"""Rules that patch fields, and the columns of a frame of maps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from ..model import Readings


@dataclass(frozen=True)
class Update:
    """Where ``match`` has the text ``equals``, set ``target`` to ``value``."""

    match: str
    equals: str
    target: str
    value: str
    only_when_empty: bool = False


def update_value(r: Readings, rule: Update) -> Readings:
    """Apply one rule; the target is created where it is missing."""
    hit = r.equals_any(rule.match, [rule.equals])
    if rule.only_when_empty:
        hit = hit & (F.coalesce(r.field(rule.target), F.lit("")) == "")
    if r.is_raw:
        others = F.map_filter("fields", lambda k, _: k != rule.target)
        patched = F.map_concat(others, F.create_map(F.lit(rule.target), F.lit(rule.value)))
        return r.with_df(r.df.withColumn("fields", F.when(hit, patched).otherwise(F.col("fields"))))
    # A column that holds another field or the order too, or one that is no field, is left alone.
    column = r.columns.get(rule.target)
    if column is None or column in r.order or list(r.columns.values()).count(column) > 1:
        column = f"_updated_{rule.target}" if rule.target in r.df.columns else rule.target
    patched = F.when(hit, F.lit(rule.value)).otherwise(r.field(rule.target))
    return r.with_df(r.df.withColumn(column, patched), {**r.columns, rule.target: column})


def update_where_empty(r: Readings, match: str, equals: str, target: str, value: str) -> Readings:
    return update_value(r, Update(match, equals, target, value, only_when_empty=True))


def apply_updates(r: Readings, rules: Sequence[Update]) -> Readings:
    """Rules in order; a later rule sees what earlier ones wrote."""
    return reduce(update_value, rules, r)
