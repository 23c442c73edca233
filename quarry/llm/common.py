"""What the training-data operators share: table access, row identity and batch sizes. Lineage is cut by tables written
into the cluster's shared folder (quarry.storage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import settled, written

#: ASCII white space, the separators of words.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the bytes of a batch that goes to a Python worker, whatever the length of texts (a row at least). Sets the
    session's spark.sql.execution.arrow.maxBytesPerBatch where it is larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").strip().lower()
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
    digits = "".join(c for c in now if c.isdigit() or c == "-")
    if not 0 < int(digits or 0) * unit <= most:
        spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def identified(docs: DataFrame) -> DataFrame:
    """uid and the whole row. uid is doc_id; where that repeats or is null, a number in the order of doc_id and text."""
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        docs = docs.select(F.struct("*").alias("row")).orderBy("row.doc_id", F.xxhash64("row.text"), "row.text")
        return written(docs.select(F.monotonically_increasing_id().alias("uid"), "row"), "uid")
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("uid"), F.struct("*").alias("row"))


def without(rows: DataFrame, gone: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """All columns of the rows (uid, row) whose uid is not in gone, a written table."""
    few = gone.count() <= broadcast_rows  # 8 bytes each
    return rows.join(F.broadcast(gone) if few else gone.hint("merge"), "uid", "left_anti").select("row.*")
