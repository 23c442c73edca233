"""op1: repeated 100-byte strings removed from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.llm.suffix_dedup import remove_repeats


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id", "cut.n_bytes", F.aggregate("cut.spans", F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias("n_removed"),
        F.size("cut.spans").cast("long").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
