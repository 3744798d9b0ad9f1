"""The fluent front: filter, patch, then ask.

``Query(readings).where(spec).update(rules).count_by("sensor_id")`` - each terminal method returns a DataFrame
and starts no job, except where an operator says otherwise.  Filters (and uniqueness) look at the readings as
they came in, updates are applied to what passes, and the terminal operator sees the updated readings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..model import Readings
from ..operators import columns, counts, errors, series, stats, tail
from ..operators.filters import FilterSpec, apply_filter, reject_reasons
from ..operators.updates import Update, apply_updates


@dataclass(frozen=True)
class Query:
    readings: Readings
    spec: FilterSpec = field(default_factory=FilterSpec)
    rules: tuple[Update, ...] = ()

    def where(self, spec: FilterSpec) -> Query:
        return replace(self, spec=spec)

    def update(self, *rules: Update) -> Query:
        return replace(self, rules=self.rules + rules)

    def tail(self, n: int) -> Query:
        """Restrict to the last n readings of each source, before filters."""
        return replace(self, readings=tail.tail(self.readings, n))

    def tail_column_value(self, name: str, value: str, n: int) -> Query:
        found = tail.tail_column_value(self.readings, name, value, n, self.spec)
        return replace(self, readings=found, spec=FilterSpec())

    def result(self) -> Readings:
        return apply_updates(apply_filter(self.readings, self.spec), self.rules)

    def rejected(self) -> Readings:
        return apply_updates(apply_filter(self.readings, self.spec.rejects()), self.rules)

    # -- commands --------------------------------------------------------------------------------------------

    def transform(self, names: Sequence[str] | None = None) -> DataFrame:
        """The passing readings, one column per field."""
        return columns.widen(self.result(), names)

    def list_rejects(self, names: Sequence[str] | None = None) -> DataFrame:
        return columns.widen(self.rejected(), names)

    def reject_reasons(self) -> DataFrame:
        return reject_reasons(self.readings, self.spec).df

    def count(self) -> DataFrame:
        return counts.count(self.result())

    def count_by(self, *fields: str, period: str | None = None) -> DataFrame:
        return counts.count_by(self.result(), *fields, period=period)

    def distinct(self, name: str) -> DataFrame:
        return counts.distinct(self.result(), name)

    def distinct_counts(self, name: str) -> DataFrame:
        return counts.distinct_counts(self.result(), name)

    def latest(self, limit: int = 0) -> DataFrame:
        return counts.latest(self.result(), limit)

    def list_errors(self) -> DataFrame:
        return errors.list_errors(self.result(), self.spec.errors)

    def summarise_errors(self) -> DataFrame:
        return errors.summarise_errors(self.result(), self.spec.errors)

    def stats(self, names: Sequence[str] | str = ("value",), by: Sequence[str] = (), **options) -> DataFrame:
        return stats.stats(self.result(), names, by, **options)

    def time_range(self, by: Sequence[str] = ()) -> DataFrame:
        return stats.time_range(self.result(), by)

    def sampling(self, by: Sequence[str] = ()) -> DataFrame:
        return stats.sampling(self.result(), by)

    def range(self, ids, start: int, end: int) -> DataFrame:
        return series.range_by_sensor(self.result(), ids, start, end)

    def head(self, ids, n: int) -> DataFrame:
        return series.head_by_sensor(self.result(), ids, n)

    def last(self, ids, n: int) -> DataFrame:
        return series.tail_by_sensor(self.result(), ids, n)

    def downsample(self, ids, start: int, end: int, buckets: int = series.BUCKETS) -> DataFrame:
        return series.downsample(self.result(), ids, start, end, buckets)
