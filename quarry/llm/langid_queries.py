"""op6: the language of all documents, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import table
from quarry.llm.langid import held_out, predict, train


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
