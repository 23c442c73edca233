"""The corpus as documents with typed properties.

A property value is a tagged union: kind (string, number, boolean or list), text (as a program would print it), num, flag
and items. It stays inside generated code and Parquet, and every predicate knows what type was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "struct<kind: string, text: string, num: double, flag: boolean, items: array<string>>"


def _value(kind: str, text: Column | None = None, num: Column | None = None, flag: Column | None = None, items: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"), (none if text is None else text).cast("string").alias("text"), (none if num is None else num).cast("double").alias("num"),
        (none if flag is None else flag).cast("boolean").alias("flag"), (none if items is None else items).cast("array<string>").alias("items"),
    )


def string_value(c: Column) -> Column:
    return F.when(c.isNotNull(), _value("string", text=c))


def whole_value(c: Column) -> Column:
    return F.when(c.isNotNull(), _value("number", text=c.cast("long"), num=c))


def number_value(c: Column) -> Column:
    return F.when(c.isNotNull(), _value("number", text=c.cast("double"), num=c))


def flag_value(c: Column) -> Column:
    return F.when(c.isNotNull(), _value("boolean", text=F.initcap(c.cast("string")), flag=c))


def list_value(c: Column) -> Column:
    return F.when(c.isNotNull(), _value("list", items=c))


def properties(**values: Column) -> Column:
    """A map of the values that are not null."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, content, last_edited_time, properties of the documents table and its labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    c = F.col
    return docs.join(labels, "doc_id", "left").select(
        c("doc_id").cast("string").alias("id"), F.concat_ws("/", "source", c("doc_id").cast("string")).alias("title"), c("text").alias("content"),
        F.date_format(F.timestamp_seconds(1_700_000_000 + c("doc_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_edited_time"),
        properties(
            lang=string_value(c("lang")), source=string_value(c("source")), nChars=whole_value(c("n_chars")), tags=list_value(F.array("lang", "source")),
            quality=whole_value(c("quality")), toxic=flag_value(c("toxic") == 1),
        ).alias("properties"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows with properties: strings, numbers, dates, a flag and a list."""
    c = F.col
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        c("o_orderkey"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("last_edited_time"),
        properties(
            status=string_value(c("o_orderstatus")), priority=string_value(c("o_orderpriority")), price=number_value(c("o_totalprice")), customer=whole_value(c("o_custkey")),
            orderDate=string_value(F.date_format("o_orderdate", "yyyy-MM-dd")), open=flag_value(c("o_orderstatus") == "O"), tags=list_value(F.array("o_orderstatus", "o_orderpriority")),
        ).alias("properties"),
    )


def property_rows(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each property: the keys, name, kind, text, num, flag, items."""
    return df.select(*keys, F.explode("properties").alias("name", "value")).select(*keys, "name", "value.*")
