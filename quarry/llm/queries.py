"""The queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe_queries, chat_queries, divergence_queries, html_queries, importance_queries, langid_queries, minhash_queries, packing_queries, quality_queries, simhash_queries, suffix_queries, toxicity_queries, url_queries

MODULES = (chat_queries, url_queries, quality_queries, minhash_queries, suffix_queries, simhash_queries, bpe_queries, packing_queries, langid_queries, html_queries, divergence_queries, importance_queries, toxicity_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: run for m in MODULES for name, run in m.QUERIES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
