"""SimHash fingerprints of documents, and the groups of those that differ in a few bits.

Method: pivot distance tables.  The Hamming distances of every distinct fingerprint to a fixed set of reference fingerprints (pivots) are
computed once and stored; a row of this table is the place of a fingerprint in pivot space.

* Pivot 0 is zero, every other pivot lies within one part of the 64 bits.  The distance to such a pivot less that to zero depends on the
  bits of its part alone.  Two fingerprints within ``BITS`` bits agree wholly in at least two of ``BITS + 2`` parts, thus in these
  columns of the table: each two parts give a key, and only fingerprints with an equal key meet.
* Of those that meet, pairs whose table rows differ by more than ``BITS`` in any column are discarded (triangle inequality), and the
  survivors are verified by their exact distance.

How it stays linear:

* Equal fingerprints are one row, found by a grouped minimum that folds before the shuffle.
* A key with at most ``CROWD`` fingerprints is compared within itself, and gives at most one link per fingerprint and group found: a
  forest with the same components.
* In a key with more of them (near copies by the thousand) almost all pairs are links, so listing pairs would be quadratic.  There,
  fingerprints meet at the fingerprints between them: two within two bits have a third at most one bit away from both, and any two that
  have it are within two bits.  A place has at most 65 fingerprints, however many documents are alike.  So this finds all links, exactly.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; a text with fewer words than a shingle
is one shingle; very long texts are hashed in slices, so memory is bounded by the text itself; rows that repeat a doc_id each have a result;
a null doc_id stays null and names no component unless nothing else is in it (then null); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .op3_jaccard import components
from .words import SLICE, groups_of, mix

WORDS = 3
SEED = 42
BITS = 2
PIVOTS_PER_PART = 12
CROWD = 32
_BLANK = re.compile(rb"[\t-\r ]")
_WEIGHT = np.uint64(0x9E3779B97F4A7C15)


def _slices(data: bytes):
    """Pieces of a text that end between words."""
    at = 0
    while at < len(data):
        end = at + SLICE
        found = _BLANK.search(data, end) if end < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def _hashes(words: list[bytes], n: int) -> list[int]:
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins = (ends - size).tolist()
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[n - 1:].tolist())]


def fingerprint(text: str, n: int = WORDS) -> int:
    """The SimHash of the n-word shingles of a text, repeats included."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for piece in _slices(text.encode().lower()):  # lower() of bytes changes A-Z alone
        words = carry + piece.split()
        if len(words) < n:
            carry = words
            continue
        h = np.array(_hashes(words, n), np.uint64)
        for a in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
        carry = words[len(words) - n + 1:]
    if not total and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number)."""

    def run(batches):
        for batch in batches:
            for first, texts in groups_of(batch.column(1)):
                fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(fp)], ["doc_id", "fp"])

    return common.texts(docs).mapInArrow(run, "doc_id long, fp long")


class PivotTable:
    """Distances of fingerprints to reference fingerprints, and the keys under which near ones meet."""

    def __init__(self, bits: int = BITS, per_part: int = PIVOTS_PER_PART, seed: int = 1):
        if not 1 <= bits <= 2:
            raise ValueError("fingerprints are linked at 1 or 2 differing bits")
        self.bits, self.parts, self.per_part = bits, bits + 2, per_part
        rng = np.random.default_rng(seed)
        edges = [64 * k // self.parts for k in range(self.parts + 1)]
        pivots = [0]
        for low, high in zip(edges, edges[1:]):
            pivots += [int(x) << low for x in rng.integers(1, 1 << (high - low), per_part, dtype=np.uint64)]
        self.pivots = np.array(pivots, np.uint64)
        self.weights = rng.integers(1, 1 << 63, per_part, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def rows(self, fp: np.ndarray) -> np.ndarray:
        """One row of distances per fingerprint."""
        return np.bitwise_count(fp[:, None] ^ self.pivots[None, :])

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """One column per choice of two parts; equal where the table is equal in both."""
        inside = (rows[:, 1:].astype(np.int64) - rows[:, :1]).view(np.uint64).reshape(len(rows), self.parts, self.per_part)
        part = mix((inside * self.weights).sum(axis=2, dtype=np.uint64) + np.arange(1, self.parts + 1, dtype=np.uint64) * _WEIGHT)
        return np.stack([mix(part[:, i] + part[:, j] * _WEIGHT) for i, j in combinations(range(self.parts), 2)], axis=1)

    def linked(self, fp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of linked pairs among fingerprints that share a key."""
        a, b = np.triu_indices(len(fp), 1)
        near = np.abs(rows[a].astype(np.int16) - rows[b]).max(axis=1) <= self.bits  # discarded by a coordinate
        a, b = a[near], b[near]
        exact = np.bitwise_count(fp[a] ^ fp[b]) <= self.bits
        return a[exact], b[exact]


def table_of(classes: DataFrame, pivots: PivotTable) -> DataFrame:
    """fp, row (distances to the pivots), keys."""

    def run(batches):
        for batch in batches:
            rows = pivots.rows(batch.column(0).to_numpy().view(np.uint64))
            keys = pivots.keys(rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))
            ], ["fp", "row", "keys"])

    return classes.select("fp").mapInArrow(run, "fp long, row binary, keys array<long>")


def forest(buckets: DataFrame, pivots: PivotTable) -> DataFrame:
    """a, b: links within buckets of a few fingerprints that connect all that is connected there."""

    def spanning(fp: np.ndarray, rows: np.ndarray):
        top = list(range(len(fp)))
        for i, j in zip(*pivots.linked(fp, rows)):
            x, y = int(i), int(j)
            while top[x] != x:
                x = top[x]
            while top[y] != y:
                y = top[y]
            if x != y:
                top[y] = x
                yield i, j

    def run(batches):
        for batch in batches:
            left, right = [], []
            for members in batch.column(0):
                fp = np.array([m["fp"].as_py() for m in members], np.int64)
                rows = np.frombuffer(b"".join(m["row"].as_py() for m in members), np.uint8).reshape(len(fp), -1)
                for i, j in spanning(fp.view(np.uint64), rows):
                    left.append(int(fp[i]))
                    right.append(int(fp[j]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def between(fingerprints_: DataFrame) -> DataFrame:
    """a, b: links among crowded fingerprints by the fingerprints at most one bit away from both."""
    fp = F.col("fp")
    places = F.array(fp, *[fp.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)])
    met = fingerprints_.select("fp", F.explode(places).alias("place")).groupBy("place").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    least = F.array_min("fps")
    return met.select(least.alias("a"), F.explode(F.array_remove("fps", least)).alias("b")).distinct()


def links(classes: DataFrame, pivots: PivotTable) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all that is connected."""
    table = common.saved(table_of(classes, pivots), "pivot-table")
    posted = table.select(F.explode("keys").alias("key"), "fp", "row")
    crowds = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = common.saved(posted.join(crowds, "key"), "met")
    buckets = met.where(F.col("n") <= CROWD).groupBy("key").agg(F.collect_list(F.struct("fp", "row")).alias("members")).select("members")
    crowded = met.where(F.col("n") > CROWD).select("fp").distinct()
    return forest(buckets, pivots).union(between(crowded))


def groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable, itself included)."""
    spark = docs.sparkSession
    common.ship(spark)
    with common.small_batches(spark):
        found = common.saved(fingerprints(docs), "fingerprints")
    classes = common.saved(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(links(classes, PivotTable(bits))).select(F.col("doc_id").alias("fp"), "component")
    known = classes.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = common.saved(known.join(least, "component").select("fp", "component_id"), "components")
    return found.join(named, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))
