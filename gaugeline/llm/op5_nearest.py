"""Approximate nearest neighbours.

Method: inverted multi-index.  Both halves of the normalised vectors are quantised separately; a cell is a pair of centroids.
A query visits cells in the order of its summed distance to both centroids, found with a heap, until they hold enough
vectors.  What is in these cells is ranked by the exact cosine in double precision.  How many vectors are enough is measured: for
``TRIALS`` vectors of the sample, the share of the sample that must be visited to meet ``RECALL`` of their exact neighbours.

The codebooks are fitted on ``SAMPLE`` vectors (those with the smallest hash of their id) and their size follows the number of
vectors up to ``MAX_CENTROIDS``; every vector is indexed.  Equal vectors are one class with its smallest ids, which is all that a
result can hold.  Neighbouring cells form buckets, and these are cut into blocks of bounded size, for vectors and for the queries that
visit them; a query gives a few rows per block it visits.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part; a vec_id that occurs twice counts as two candidates, none of which is a result of its own queries; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
MAX_CENTROIDS = 256
PER_CELL = 128
BLOCK = 4096
LEAST = 1000
RECALL = 0.97
TRIALS = 300
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & good)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's iterations from spread-out starts; deterministic for a given sample."""
    rng = np.random.default_rng(7)
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, centers).argmin(1)
        for j in range(len(centers)):
            own = x[near == j]
            if len(own):
                centers[j] = own.mean(0)
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None], 0)


def normal(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Books:
    """The two codebooks; an odd vector length gives the second half one component more."""

    def __init__(self, sample: np.ndarray, k: int):
        self.width = sample.shape[1]
        self.half = self.width // 2
        x = normal(sample)
        self.first, self.second = kmeans(x[:, :self.half], k), kmeans(x[:, self.half:], k)

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = normal(rows)
        return distances(x[:, :self.half], self.first), distances(x[:, self.half:], self.second)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.distances(rows)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
        """Cells of one query, nearest first, until they hold ``enough`` vectors."""
        i_of, j_of = a.argsort(kind="stable"), b.argsort(kind="stable")
        heap, seen, out, total = [(a[i_of[0]] + b[j_of[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and total < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(i_of[i]) * len(b) + int(j_of[j])
            if counts[cell]:
                out.append(cell)
                total += int(counts[cell])
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(a) and q < len(b) and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (a[i_of[p]] + b[j_of[q]], p, q))
        return out


def share_needed(books: Books, sample: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> float:
    """The share of all vectors to visit so that the exact ``k`` nearest of the trial vectors are met with ``recall``."""
    if len(sample) <= k + 1:
        return 1.0
    x, cells = normal(sample), books.cells(sample)
    counts = np.bincount(cells, minlength=len(books.first) * len(books.second))
    a, b = books.distances(sample[:trials])
    needed = []
    for n in range(len(a)):
        order = books.visits(a[n], b[n], counts, len(sample))
        met = np.zeros(len(counts))
        met[order] = np.cumsum(counts[order]) - counts[order]
        scores = x @ x[n]
        scores[n] = -2
        needed += (met[cells[np.argpartition(-scores, k)[:k]]] / len(sample)).tolist()
    return float(np.quantile(needed, recall))


def best(rep: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((rep[some], -score[some]))[:k]]


def nearest(df: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest other rows of every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    common.ship(spark)
    good = usable(df, id_col, vector_col)
    widths = good.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], RESULT)
    width = widths[0]["w"]
    good = good.where(F.size("v") == width)
    keep = k + 1
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    classes = common.saved(
        good.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= keep)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids"), "classes")
    total = classes.count()
    sample = [r["v"] for r in classes.select("v", F.xxhash64("rep").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    sample = np.array(sample, np.float32)
    books = Books(sample, int(min(MAX_CENTROIDS, max(2, round((total / PER_CELL) ** 0.5)))))
    enough = max(LEAST, math.ceil(share_needed(books, sample, k, recall) * total) + 1)
    n_cells = len(books.first) * len(books.second)

    def assign(batches):
        for batch in batches:
            cells = books.cells(matrix(batch.column(1), width)) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["rep", "v", "ids", "cell"])

    indexed = common.saved(classes.mapInArrow(assign, "rep long, v array<float>, ids array<long>, cell int"), "index")
    counts = np.zeros(n_cells, np.int64)  # bounded by the codebooks, whatever the number of vectors
    for r in indexed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    # Neighbouring cells share a bucket of about BLOCK vectors.
    bucket_of = (np.cumsum(counts) - counts) // BLOCK

    def traverse(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            reps, rows = batch.column(0).to_pylist(), matrix(batch.column(1), width)
            a, b = books.distances(rows)
            names, vectors, buckets, cells = [], [], [], []
            for n, rep in enumerate(reps):
                found = np.sort(books.visits(a[n], b[n], counts, enough))
                cut = np.flatnonzero(np.diff(bucket_of[found])) + 1
                for part in np.split(found, cut):
                    names.append(rep)
                    vectors.append(n)
                    buckets.append(bucket_of[part[0]])
                    cells.append(part.tolist())
            flat = pa.array(rows[vectors].ravel())
            offsets = pa.array(np.arange(len(vectors) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(buckets, pa.int64()), pa.array(cells, pa.list_(pa.int32()))],
                ["query", "v", "bucket", "cells"])

    asking = good.where(F.col("vec_id") % every == 0)
    members = asking.join(classes.select("rep", "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    query_classes = indexed.join(members.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select("rep", "v")
    visits = common.saved(query_classes.mapInArrow(traverse, "query long, v array<float>, bucket long, cells array<int>"), "visits")
    asked = {r["bucket"]: r["count"] for r in visits.groupBy("bucket").count().collect()}  # at most a row per cell
    held = np.bincount(bucket_of, weights=counts).astype(np.int64)
    blocks = spark.createDataFrame(
        [(int(b), int(-(-held[b] // (2 * BLOCK))), int(-(-n // BLOCK))) for b, n in asked.items()], "bucket long, nv int, nq int")
    places = spark.createDataFrame([(c, int(bucket_of[c])) for c in range(n_cells) if counts[c]], "cell int, bucket long")
    side = F.broadcast(blocks)  # both bounded by the codebooks
    left = visits.join(side, "bucket").withColumn("qb", F.pmod(F.hash("query"), "nq")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    right = indexed.join(F.broadcast(places), "cell").join(side, "bucket").withColumn("vb", F.pmod(F.hash("rep"), "nv")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))

    def rank(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found = ([], [], [])
        if len(queries) and len(vectors):
            v = np.stack(vectors["v"].to_numpy()).astype(np.float64)
            rep, norm = vectors["rep"].to_numpy(), np.linalg.norm(v, axis=1)
            cells, local = np.unique(vectors["cell"].to_numpy(), return_inverse=True)
            for begin in range(0, len(queries), 256):
                some = queries.iloc[begin:begin + 256]
                q = np.stack(some["v"].to_numpy()).astype(np.float64)
                scores = (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * norm[None])
                for name, visited, row in zip(some["query"].to_numpy(), some["cells"], scores, strict=True):
                    mine = np.flatnonzero(np.isin(cells, visited)[local])
                    top = mine[best(rep[mine], row[mine], keep)]
                    for out, x in zip(found, (np.full(len(top), name), rep[top], row[top]), strict=True):
                        out.append(x)
        kinds = (("query", np.int64), ("rep", np.int64), ("score", np.float64))
        return pd.DataFrame({n: np.concatenate(x) if x else np.empty(0, t) for (n, t), x in zip(kinds, found, strict=True)})

    keys = ["bucket", "vb", "qb"]
    ranked = (
        left.select(*keys, "query", "v", "cells").groupBy(*keys)
        .cogroup(right.select(*keys, "rep", "v", "cell").groupBy(*keys)).applyInPandas(rank, "query long, rep long, score double"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    few = ranked.withColumn("n", F.row_number().over(top)).where(F.col("n") <= keep)
    entry = F.transform("ids", lambda x: F.struct((-F.col("score")).alias("s"), x.alias("vec_id")))
    lists = few.join(indexed.select("rep", "ids"), "rep").groupBy("query").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(entry))), 1, keep).alias("found"))
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    return members.join(lists, "query").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("i", "x")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), every=50)
