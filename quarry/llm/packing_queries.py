"""op9: all documents packed into sequences of 1024 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import table
from quarry.llm.packing import pack


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
