"""Exact cosine search: query vectors go to every task, which multiplies them with its vectors and keeps the best k of each
query over all its rows; a window picks the best of those."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.bm25 import top_k

BLOCK = 128


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search(vectors: DataFrame, queries: DataFrame, k: int, most_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, chunk_id, score. vectors: chunk_id, embedding; queries: query_id, embedding (ids of any type that sorts)
    and perhaps `filter_set`: rows of vectors are then found only if their array `passed` has it (-1: all rows). Queries are given vectors, sent to the tasks in turns of most_bytes (with
    what a task keeps of a query) and multiplied in blocks of BLOCK, so the table is read once a turn and a task's memory does not grow with the number of queries. A task keeps
    the best k of each query over all its batches, and nothing else moves."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark, found = vectors.sparkSession, None
    ids, asks = (df.schema[c].dataType.simpleString() for df, c in ((vectors, "chunk_id"), (queries, "query_id")))
    kind = f"query_id {asks}, chunk_id {ids}, score double"
    none = F.array().cast("array<long>")
    passed = F.coalesce(F.col("passed").cast("array<long>"), none) if "passed" in vectors.columns else none
    rows = vectors.select("chunk_id", "embedding", passed.alias("passed")).filter("embedding IS NOT NULL")
    for turn in _turns(queries, most_bytes, 80 * k):
        sent = spark.sparkContext.broadcast(turn)
        part = rows.mapInArrow(best_of(sent, k, _blocks), kind)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], f"{kind}, rank int")
    return top_k(found, k)


def _turns(queries: DataFrame, most_bytes: int, kept_bytes: int = 0) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """ids, filter sets and unit vectors of the queries, so many at a time; kept_bytes: what a task keeps of each."""
    wanted = queries if "filter_set" in queries.columns else queries.withColumn("filter_set", F.lit(-1))
    held: list = []

    def emit():  # noqa: ANN202
        return [r[0] for r in held], np.array([r[1] for r in held], np.int64), _unit(np.array([r[2] for r in held], np.float64))

    for row in wanted.filter("embedding IS NOT NULL").select("query_id", "filter_set", "embedding").toLocalIterator():
        held.append(row)
        if len(held) * (len(row[2]) * 8 + kept_bytes) >= most_bytes:
            yield emit()
            held = []
    if held:
        yield emit()


def _first(rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of each query, by score (to nine digits) and id."""
    rows = rows.append_column("by", pa.array(-np.round(rows.column("score").to_numpy(), 9)))
    rows = rows.sort_by([("q", "ascending"), ("by", "ascending"), ("chunk_id", "ascending")])
    q = rows.column("q").to_numpy()
    begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
    return rows.filter(pa.array(nth < k)).drop_columns(["by"])


def _blocks(sent: tuple, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of queries, all rows, and which rows each query may have."""
    sets, lists, every = sent[1], batch.column(2), np.arange(batch.num_rows)
    passed, of_row = lists.flatten().to_numpy(), np.repeat(every, np.diff(lists.offsets.to_numpy()))
    for a in range(0, len(sets), BLOCK):
        asked, which = np.unique(sets[a : a + BLOCK], return_inverse=True)
        if asked[-1] < 0:
            yield np.arange(a, a + len(which)), every, None
            continue
        allowed = np.repeat((asked < 0)[:, None], batch.num_rows, axis=1)
        place = np.minimum(np.searchsorted(asked, passed), len(asked) - 1)
        allowed[place[asked[place] == passed], of_row[asked[place] == passed]] = True
        yield np.arange(a, a + len(which)), every, allowed[which]


def best_of(sent, k: int, parts):  # noqa: ANN001, ANN201
    """The best k rows of each query in a task. sent: a broadcast tuple of query ids, what parts needs, and unit vectors;
    parts yields queries, rows and a mask (None: all) to compare. Rows below the k-th score that a query has so far are not
    looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, unit = sent.value
        held, least = None, np.full(len(ids), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, met = _unit(_rows(batch.column(1))), [] if held is None else [held]
            for asked, rows, allowed in parts(sent.value, batch):
                score = unit[asked] @ own[rows].T
                if allowed is not None:
                    score = np.where(allowed, score, -np.inf)
                n = min(k, score.shape[1])
                kept = np.maximum(np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n] if n == k else -np.inf, least[asked])
                q, at = np.nonzero((score >= kept[:, None] - 1e-9) & np.isfinite(score))
                met.append(pa.table([pa.array(asked[q]), batch.column(0).take(pa.array(rows[at])), pa.array(score[q, at])], ["q", "chunk_id", "score"]))
            if not met:
                continue
            held = _first(pa.concat_tables(met), k).combine_chunks()
            q, counts = np.unique(held.column("q").to_numpy(), return_counts=True)
            ends = np.cumsum(counts) - 1
            least[q[counts == k]] = held.column("score").to_numpy()[ends[counts == k]]
        if held is not None and held.num_rows:
            own_ids = pa.array(ids).take(held.column("q").combine_chunks())
            yield from pa.table([own_ids, held.column("chunk_id"), held.column("score")], ["query_id", "chunk_id", "score"]).to_batches(max_chunksize=10_000)

    return run


def filter_only(points: DataFrame, k: int, key: str = "point_id") -> DataFrame:
    """The first k points by key with score 0, for a request without a vector."""
    return points.orderBy(key).limit(k).withColumn("score", F.lit(0.0))
