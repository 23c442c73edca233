"""Exact cosine search with pruning. Vectors are stored by the nearest of some centres, with their angle to it. By the
triangle inequality of angles no vector of a cluster is closer to a query than the cluster's least and greatest angle allow,
so a query first reads the clusters nearest to it and then only those that can still beat its k-th score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.bm25 import top_k
from quarry.operators.vectors import BLOCK, _rows, _turns, _unit, best_of
from quarry.storage import written

#: The cluster of vectors without a direction; every query reads it.
ZERO = -1
#: Above what rounding does to cosines of angles.
SLACK = 1e-7


@dataclass(frozen=True)
class Clusters:
    """points: cluster, angle, chunk_id, embedding, in a folder for each cluster; centres, and of each cluster the least and
    greatest angle and the number of its vectors."""

    points: DataFrame
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray


@dataclass(frozen=True)
class Work:
    """What a search did: pairs of a query and a cluster with vectors, those read, and the vectors that were compared."""

    pairs: int
    read: int
    compared: int


def build(vectors: DataFrame, clusters: int = 64, sample: int = 20_000, rounds: int = 8) -> Clusters:
    """Clusters of vectors (chunk_id of any type, embedding of one length); null embeddings are left out. The centres are
    fitted on the `sample` rows of least hash, a bound on what the driver holds; every row is stored. Centres change what is
    skipped, never what is found. Rows of a large cluster are written by several tasks."""
    known = vectors.filter("embedding IS NOT NULL").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).collect()
    fitted = _unit(np.array([r["embedding"] for r in drawn], np.float64)) if drawn else np.zeros((0, 0))
    centres = _fit(fitted[np.linalg.norm(fitted, axis=1) > 0], clusters, rounds)
    kind = f"chunk_id {known.schema['chunk_id'].dataType.simpleString()}, embedding array<double>, cluster int, angle double"
    placed = known.mapInArrow(_placed(centres), kind)
    points = written(placed.repartition("cluster", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).sortWithinPartitions("cluster", "angle"), "clusters", "cluster")
    low, high, n = np.zeros(len(centres) + 1), np.full(len(centres) + 1, np.pi), np.zeros(len(centres) + 1, np.int64)
    for r in points.groupBy("cluster").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect():
        low[r["cluster"]], high[r["cluster"]], n[r["cluster"]] = r["low"], r["high"], r["n"]
    return Clusters(points, centres, low, high, n)


def _fit(rows: np.ndarray, clusters: int, rounds: int) -> np.ndarray:
    centres = rows[:clusters]
    for _ in range(rounds if len(rows) else 0):
        near = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _placed(centres: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_rows(batch.column(1)))
            alive = np.linalg.norm(unit, axis=1) > 0
            near, angle = np.full(len(unit), ZERO, np.int32), np.zeros(len(unit))
            if len(centres):
                cosine = unit @ centres.T
                best = np.argmax(cosine, axis=1)
                near = np.where(alive, best, ZERO).astype(np.int32)
                angle = np.where(alive, np.arccos(np.clip(cosine[np.arange(len(unit)), best], -1, 1)), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(angle)], ["chunk_id", "embedding", "cluster", "angle"])

    return run


def _bounds(index: Clusters, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The angles between queries and centres, and the greatest cosine that each cluster allows (its last column: vectors
    without a direction)."""
    angle = np.arccos(np.clip(unit @ index.centres.T, -1, 1)) if len(index.centres) else np.zeros((len(unit), 0))
    apart = np.maximum(0, np.maximum(angle - index.high[:-1], index.low[:-1] - angle))
    bound = np.c_[np.cos(apart), np.full(len(unit), np.inf)]
    bound[np.linalg.norm(unit, axis=1) == 0] = np.inf
    bound[:, index.n == 0] = -np.inf
    return np.c_[angle, np.full(len(unit), np.inf)], bound


def _scored(index: Clusters, turn: tuple, wanted: np.ndarray, k: int) -> DataFrame:
    """The best k of each query in each task among the clusters that the query wants; only wanted folders are read."""
    read = [int(c) if c < wanted.shape[1] - 1 else ZERO for c in np.flatnonzero(wanted.any(axis=0))]
    ids, _, unit, kind = turn
    sent = index.points.sparkSession.sparkContext.broadcast((ids, wanted, unit))
    rows = index.points.filter(F.col("cluster").isin(read)).select("chunk_id", "embedding", "cluster")
    return rows.mapInArrow(best_of(sent, k, _pairs), f"query_id {kind}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, score double")


def _pairs(sent: tuple, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
    wanted, own = sent[1], batch.column(2).to_numpy()
    for c in np.unique(own):
        asking, at = np.flatnonzero(wanted[:, c]), np.flatnonzero(own == c)
        for a in range(0, len(asking), BLOCK):
            yield asking[a : a + BLOCK], at, None


def search(index: Clusters, queries: DataFrame, k: int, most_bytes: int = 64 << 20) -> tuple[DataFrame, Work]:
    """query_id, rank, chunk_id, score, the same as vectors.search finds over all vectors, and the work done. queries:
    query_id of any type (unique), embedding. They are sent in turns of most_bytes; of a turn one score a query comes back."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark, kind = index.points.sparkSession, queries.schema["query_id"].dataType.simpleString()
    found, pairs, read, compared = None, 0, 0, 0
    for ids, sets, unit in _turns(queries, most_bytes):
        turn, alive = (ids, sets, unit, kind), index.n > 0
        angle, bound = _bounds(index, unit)
        order = np.argsort(angle, axis=1)
        before = np.cumsum(index.n[order], axis=1) - index.n[order]
        first = np.zeros(angle.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first[:, ZERO] = True
        first &= alive
        probed = written(top_k(_scored(index, turn, first, k), k).drop("rank"), "probed")
        least = {r["query_id"]: r["least"] for r in probed.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).collect() if r["n"] == k}
        rest = ~first & alive & (bound >= np.array([least.get(q, -np.inf) for q in ids])[:, None] - SLACK)
        both = probed.select("query_id", "chunk_id", "score")
        if rest.any():
            both = both.unionAll(_scored(index, turn, rest, k).select("query_id", "chunk_id", "score"))
        found = both if found is None else found.unionAll(both)
        pairs, read, compared = pairs + len(ids) * int(alive.sum()), read + int((first | rest).sum()), compared + int(((first | rest) * index.n).sum())
    if found is None:
        found = spark.createDataFrame([], f"query_id {kind}, chunk_id {index.points.schema['chunk_id'].dataType.simpleString()}, score double")
    return top_k(found, k), Work(pairs, read, compared)
