"""Documents as a stream: each micro-batch is planned against what is stored, chunked and embedded, and put into the points
and the lexical index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators import sync
from quarry.storage import written


def changes(batch: DataFrame, stored: DataFrame, encode: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """The new points of a batch of documents (id, title, content, last_edited_time, and properties and semantic if they are
    there) and the document_ids whose points go. Unchanged documents are in neither. Of a document that comes twice in a
    batch the latest counts, of equal times the one with the greater title and content."""
    last = W.partitionBy("id").orderBy(F.desc("last_edited_time"), F.desc("title"), F.desc("content"))
    docs = batch.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")
    todo = sync.plan(docs.select(F.col("id").alias("document_id"), "last_edited_time"), stored.select("document_id", "last_edited_time").distinct()).filter("action <> 'unchanged'")
    fresh = docs.join(todo.select(F.col("document_id").alias("id")), "id", "left_semi")
    return sync.points_of(fresh, encode), todo.select("document_id")


def apply_batch(batch: DataFrame, path: str, encode: Callable | None = None) -> int:
    """Puts a batch into the points and the index under path, by appending. Running a batch again changes nothing, as its
    documents are then unchanged or replaced by the same points."""
    spark = batch.sparkSession
    points, todo = changes(written(batch, "batch"), sync.ensure_table(spark, f"{path}/points"), encode)
    return sync.apply(spark, path, written(points, "batch-points"), written(todo, "batch-todo"))


def start(documents: DataFrame, path: str, checkpoint: str, encode: Callable | None = None):  # noqa: ANN201
    """Runs apply_batch on a stream."""
    return documents.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, path, encode)).option("checkpointLocation", checkpoint).start()
