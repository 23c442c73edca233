"""op2: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.llm.simhash import group_near_duplicates


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
ORACLES: dict[str, str] = {}
