"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample, halved again and again by two means and a
median, so lists are equally long.  They live in memory in every task, joined into a
graph that a best-first search walks.  A vector is written to its nearest list and,
when it lies on a boundary, to further lists that are almost as near and not hidden
behind a chosen one.  A query reads the lists whose distance is within a ratio of
the nearest one.  Scores are exact cosines in double precision.

Equal vectors: only the ``k + 1`` smallest ids of a vector can be in a result, so the
others leave before the lists are written; equal queries are searched once.  Lists
are cut into cells of bounded size on both sides.

Vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without an id and vectors of another length than most of the sample.  Rows
that repeat as a whole count once.  Fewer than ``k`` candidates: all of them.  An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedcore.llm.common import in_worker

#: Rows that the centroids are fitted on, at most.
SAMPLE = 20_000
LIST_SIZE = 200
CELL = 4000


class Centroids:
    """Unit centroids and the graph over them."""

    def __init__(self, points: np.ndarray, degree: int = 24) -> None:
        self.points = points
        n = len(points)
        near = np.empty((n, min(degree, max(n - 1, 0))), np.int64)
        for at in range(0, n, 1024):
            d = -(points[at : at + 1024] @ points.T)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 1024] = np.argsort(d, axis=1)[:, : near.shape[1]]
        # Links in both directions, and a ring, so that every list can be reached.
        links = [set(x.tolist()) | {(i + 1) % n, (i - 1) % n} for i, x in enumerate(near)]
        for i, x in enumerate(near):
            for j in x.tolist():
                links[j].add(i)
        self.links = [np.fromiter(sorted(x - {i}), np.int64) for i, x in enumerate(links)]
        rng = np.random.default_rng(7)
        self.entries = rng.permutation(n)[: max(1, min(n, int(np.sqrt(n)) + 1))]

    def search(self, vector: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists within ``ratio`` of the nearest distance (``least`` at least), nearest first, and distances."""
        n = len(self.points)
        distance = np.full(n, np.inf)
        opened = np.zeros(n, bool)
        new = self.entries
        while len(new):
            distance[new] = np.sqrt(np.maximum(2 - 2 * (self.points[new] @ vector), 0))
            seen = np.flatnonzero(distance < np.inf)
            limit = distance[seen].min() * ratio
            if len(seen) > least:
                limit = max(limit, np.partition(distance[seen], least - 1)[least - 1])
            else:
                limit = np.inf
            fresh = seen[(distance[seen] <= limit) & ~opened[seen]]
            opened[fresh] = True
            around = np.unique(np.concatenate([self.links[i] for i in fresh])) if len(fresh) else fresh
            new = around[distance[around] == np.inf]
        order = np.lexsort((np.arange(n), distance))
        order = order[distance[order] < np.inf]
        keep = (distance[order] <= distance[order[0]] * ratio) | (np.arange(len(order)) < least)
        return order[keep], distance[order[keep]]

    def homes(self, vector: np.ndarray, ratio: float, most: int) -> list[int]:
        """The nearest list, and further ones for a vector on their boundary."""
        lists, distances = self.search(vector, ratio, 1)
        chosen: list[int] = []
        for i, d in zip(lists.tolist(), distances):
            if len(chosen) == most:
                break
            # A list behind a chosen one, seen from the vector, adds nothing.
            if all(np.sqrt(max(2 - 2 * float(self.points[i] @ self.points[j]), 0)) > 0.5 * d for j in chosen):
                chosen.append(i)
        return chosen


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def balanced(points: np.ndarray, leaves: int, seed: int = 3) -> np.ndarray:
    """Centroids of ``leaves`` groups of equal size (about)."""
    rng = np.random.default_rng(seed)
    groups, out = [(points, leaves)], []
    while groups:
        own, n = groups.pop()
        if n <= 1 or len(own) < 2:
            out.append(own.mean(0))
            continue
        two = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = (own @ (two[0] - two[1])) > 0
            if side.all() or not side.any():
                break
            two = unit(np.stack([own[side].mean(0), own[~side].mean(0)]))
        left = n // 2
        order = np.argsort(own @ (two[0] - two[1]), kind="stable")
        cut = len(own) * left // n
        groups += [(own[order[:cut]], left), (own[order[cut:]], n - left)]
    return unit(np.array(out))


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _twin_keys(vector: str) -> list[Column]:
    """128 bits of a vector."""
    return [F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit(77), vector).alias("k2")]


def graph_of(points: np.ndarray) -> Centroids:
    """The graph over the centroids, built once a worker."""
    return in_worker(("centroids", points.shape, hash(points.tobytes())), lambda: Centroids(points))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key).alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)
    )


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
    list_size: int = LIST_SIZE,
    probe_ratio: float = 1.24,
    copy_ratio: float = 1.12,
    copies: int = 8,
    least_lists: int = 16,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``is_query`` is a condition on ``id``."""
    spark = rows.sparkSession
    every = usable(rows, key, vector)
    drawn = [r.v for r in every.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()]
    result = "query_id long, rank int, vec_id long, score double"
    if not drawn:
        return spark.createDataFrame([], result)
    lengths = [len(v) for v in drawn]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    every = every.where(F.size("v") == width)
    total = every.count()
    leaves = max(1, min(-(-total // list_size), sample // 16))
    points = unit(np.array([v for v in drawn if len(v) == width]))
    # Plain numbers are broadcast, as a class of this package could not be found by name everywhere.
    centroids = spark.sparkContext.broadcast(balanced(points, leaves))  # at most sample / 16 points

    keyed = every.select("id", "v", *_twin_keys("v"))
    place = W.partitionBy("k1", "k2").orderBy("id")
    distinct = keyed.dropDuplicates(["id", "k1", "k2"])
    few = distinct.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1).drop("n")
    asked = keyed.where(is_query).select("id", "k1", "k2").distinct()
    questions = keyed.where(is_query).dropDuplicates(["k1", "k2"]).select("k1", "k2", "v")

    cuts = max(1, -(-total * copies // (leaves * CELL)))
    query_cuts = max(1, -(-questions.count() // CELL))

    def write(batches):
        own = graph_of(centroids.value)
        for batch in batches:
            homes = [own.homes(v, copy_ratio, copies) for v in unit(matrix(batch.column("v")))] if batch.num_rows else []
            take = pa.array(np.repeat(np.arange(len(homes)), [len(h) for h in homes]))
            yield pa.record_batch([batch.column("id").take(take), batch.column("v").take(take), pa.array([i for h in homes for i in h], pa.int32())], ["id", "v", "list"])

    def ask(batches):
        own = graph_of(centroids.value)
        for batch in batches:
            lists = [own.search(v, probe_ratio, least_lists)[0] for v in unit(matrix(batch.column("v")))] if batch.num_rows else []
            take = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.record_batch([*(batch.column(c).take(take) for c in ("k1", "k2", "v")), pa.array(flat.astype(np.int32))], ["k1", "k2", "v", "list"])

    lists = few.select("id", "v").mapInArrow(write, "id long, v array<double>, list int")
    lists = lists.withColumn("cut", F.pmod(F.xxhash64("id"), F.lit(cuts)))
    lists = lists.withColumn("query_cut", F.explode(F.sequence(F.lit(0), F.lit(query_cuts - 1))))
    asks = questions.mapInArrow(ask, "k1 long, k2 long, v array<double>, list int")
    asks = asks.withColumn("query_cut", F.pmod(F.col("k1"), F.lit(query_cuts)).cast("int"))
    asks = asks.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cuts - 1).cast("long"))))

    def score(cell: pa.Table, questions_: pa.Table) -> pa.Table:
        out = {"k1": [], "k2": [], "id": [], "score": []}
        if cell.num_rows and questions_.num_rows:
            x, ids = matrix(cell.column("v")), np.array(cell.column("id").to_pylist(), np.int64)
            y = matrix(questions_.column("v"))
            nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            k1, k2 = questions_.column("k1").to_pylist(), questions_.column("k2").to_pylist()
            rough = (y / ny[:, None]) @ (x / nx[:, None]).T
            for i, line in enumerate(rough):
                # The product may round equal vectors apart: what is close is scored again, row by row.
                floor = np.partition(line, -(k + 1))[-(k + 1)] - 1e-9 if len(line) > k + 1 else -np.inf
                near = np.flatnonzero(line >= floor)
                exact = (x[near] * y[i]).sum(1) / (nx[near] * ny[i])
                best = np.lexsort((ids[near], -exact))[: k + 1]
                out["id"] += ids[near[best]].tolist()
                out["score"] += exact[best].tolist()
                out["k1"] += [k1[i]] * len(best)
                out["k2"] += [k2[i]] * len(best)
        kinds = {"k1": pa.int64(), "k2": pa.int64(), "id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})

    cell = ["list", "cut", "query_cut"]
    found = lists.groupBy(*cell).cogroup(asks.groupBy(*cell)).applyInArrow(score, "k1 long, k2 long, id long, score double")
    found = found.groupBy("k1", "k2", "id").agg(F.max("score").alias("score"))
    best = W.partitionBy("k1", "k2").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    told = asked.withColumnRenamed("id", "query_id").join(found, ["k1", "k2"]).where("id <> query_id")
    order = W.partitionBy("query_id", "k1", "k2").orderBy(F.desc("score"), "id")
    return (
        told.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
