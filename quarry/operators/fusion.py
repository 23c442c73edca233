"""Fusion and reranking of ranked lists (query_id, strategy, rank, chunk_id, ...), all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import tokenize
from quarry.storage import written


def concatenated(lists: DataFrame) -> DataFrame:
    """The lists one after the other."""
    return lists.withColumn("fused_rank", F.row_number().over(W.partitionBy("query_id").orderBy("strategy", "rank")))


def reciprocal_rank(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, fused_rank; ties keep the order of first sight (strategy, then rank)."""
    if k <= 0:
        raise ValueError("k must be positive")
    merged = lists.groupBy("query_id", "chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("strategy", "rank")).alias("seen"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen")
    return merged.select("query_id", "chunk_id", "score", F.row_number().over(order).alias("fused_rank"))


def beside(found: DataFrame, rows: DataFrame, key: str = "chunk_id", broadcast_rows: int = 200_000) -> DataFrame:
    """The found rows with the row of each key. What was found is computed once and, if it is few, sent to the rows, so that
    texts nobody found do not move."""
    found = written(found, "found")
    return (F.broadcast(found) if found.count() <= broadcast_rows else found).join(rows, key)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has: the stand-in for a model."""
    asked = F.array_distinct(tokenize(query))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, tokenize(text))) / F.size(asked))


def rerank(candidates: DataFrame, score: Column, pool: int = 25, top_n: int | None = 5) -> DataFrame:
    """The first `pool` candidates (rank) by a new score, stable; score may be a model's pandas UDF, which then sees no
    other rows."""
    scored = candidates.filter(F.col("rank") <= pool).withColumn("score", score)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    out = scored.withColumn("new_rank", F.row_number().over(order))
    return out if top_n is None else out.filter(F.col("new_rank") <= top_n)
