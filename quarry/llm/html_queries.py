"""op4: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import table
from quarry.llm.html_extract import extract_pages


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extract": op4_html_extract}
ORACLES: dict[str, str] = {}
