"""op7: fingerprints of all documents, of their edited texts and of the next documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import table
from quarry.llm.order_minhash import fingerprint_documents


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_order_minhash": op7_order_minhash}
ORACLES: dict[str, str] = {}
