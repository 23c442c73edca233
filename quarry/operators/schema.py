"""Metadata schema: inferred from the values that documents carry, and used to validate proposed filters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.dates import clamp_year, is_iso_date, iso_date
from quarry.functions.text import decamel, strip
from quarry.sources.corpus import property_rows

# Operators of each field type, in order.
ORDERED = ("=", "<", ">", "<=", ">=", "between")
OPERATOR_NAMES = {"=": "equals", "contains": "contains", "<": "lt", ">": "gt", "<=": "lte", ">=": "gte", "between": "between"}
BY_TYPE = {"date": ORDERED, "number": ORDERED, "boolean": ("=",), "string": ("=", "contains")}
INDEX_KIND = {"date": "datetime", "number": "float", "boolean": "bool", "string": "keyword"}


def by_type(kind: Column, table: dict) -> Column:
    out = F
    for k, v in table.items():
        value = F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
        out = out.when(kind == k, value)
    return out


def seen(documents: DataFrame) -> DataFrame:
    """name and how many values of each kind it has: list, plain (texts that are no dates), dated, flag, number. Counts add up
    over batches and, taken negative, undo what is deleted, so a schema needs only the batches."""
    text = F.col("kind") == "string"
    kinds = {"list": F.col("kind") == "list", "plain": text & ~is_iso_date(F.col("text")), "dated": text & is_iso_date(F.col("text")), "flag": F.col("kind") == "boolean", "number": F.col("kind") == "number"}
    return property_rows(documents).groupBy("name").agg(*(F.count_if(c).alias(k) for k, c in kinds.items()))


def merged(parts: DataFrame) -> DataFrame:
    """Counts of kinds added up; names without any value left are gone."""
    kinds = ("list", "plain", "dated", "flag", "number")
    return parts.groupBy("name").agg(*(F.sum(k).alias(k) for k in kinds)).filter(" OR ".join(f"{k} > 0" for k in kinds))


def of_seen(counts: DataFrame) -> DataFrame:
    """name, type, multi, operators. A list anywhere makes a multiple string; then a plain string a string; then a date,
    or "date" in the name, a date; then booleans, numbers."""
    there = lambda k: F.col(k) > 0
    found = F.when(there("list") | there("plain"), "string").when(there("dated") | F.contains(F.lower("name"), F.lit("date")), "date").when(there("flag"), "boolean").when(there("number"), "number").otherwise("string")
    return counts.select("name", found.alias("type"), there("list").alias("multi")).withColumn("operators", by_type(F.col("type"), BY_TYPE))


def infer_schema(documents: DataFrame) -> DataFrame:
    """The schema of documents' properties. Partial aggregation, one row a name."""
    return of_seen(seen(documents))


def schema_of_fields(fields: DataFrame) -> DataFrame:
    """The schema when only names (and whether a list was seen) are known; the first of equal names stays."""
    first = fields.withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("pos"))).filter("n = 1")
    kind = F.when(F.col("multi"), "string").when(F.contains(F.lower("name"), F.lit("date")), "date").otherwise("string")
    return first.select("name", kind.alias("type"), "multi").withColumn("operators", by_type(F.col("type"), BY_TYPE))


def discover_fields(points: DataFrame, key: str, most: int = 256) -> DataFrame:
    """Names of the first points' properties, and whether one was a list."""
    return property_rows(points.orderBy(key).limit(most)).groupBy("name").agg(F.bool_or(F.col("kind") == "list").alias("multi"))


def index_plan(schema: DataFrame, existing: DataFrame) -> DataFrame:
    """Typed columns still to provide: those of the schema and the two system times that are not there."""
    wanted = schema.select(F.concat(F.lit("properties."), "name").alias("key"), by_type(F.col("type"), INDEX_KIND).alias("index_kind"))
    system = schema.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(F.lit("last_edited_time"), F.lit("created_time"))).alias("key"), F.lit("datetime").alias("index_kind"))
    return wanted.unionByName(system).join(existing, "key", "left_anti")


def schema_json(schema: DataFrame) -> DataFrame:
    """name and its JSON; multi only where true."""
    return schema.select("name", F.to_json(F.struct("name", "type", "operators", F.when(F.col("multi"), True).alias("multi"))).alias("json"))


def registry(fields: DataFrame) -> DataFrame:
    """canonical, surface, kind, multi: the ways to write each field's name (camel case and words)."""
    spoken = decamel(F.col("name"))
    kind = F.when(F.contains(spoken, F.lit("date")), "date").otherwise("text")
    return fields.select(F.col("name").alias("canonical"), F.explode(F.array_distinct(F.array(spoken, F.lower("name")))).alias("surface"), kind.alias("kind"), "multi")


def validate_filters(proposed: DataFrame, schema: DataFrame, today: Column) -> DataFrame:
    """proposed: id, field, operator, values (array of texts), keep_year. Only filters on known fields, with an operator
    that the field has and values of its type, come through, as texts of the typed values. Dates without a year in the
    question move to their latest occurrence."""
    token = F.lower(strip(F.col("operator")))
    known = proposed.join(schema.withColumnRenamed("name", "field"), "field").filter(F.array_contains(F.col("operators"), token))
    flag = lambda v: F.when(F.lower(strip(v)).isin("true", "yes", "1"), "true").when(F.lower(strip(v)).isin("false", "no", "0"), "false")
    day = lambda v: F.when(F.col("keep_year"), iso_date(v)).otherwise(clamp_year(iso_date(v), today)).cast("string")
    number = lambda v: F.when(strip(v).try_cast("double").isNotNull(), strip(v))
    typed = lambda v: F.when(F.col("type") == "boolean", flag(v)).when(F.col("type") == "date", day(v)).when(F.col("type") == "number", number(v)).otherwise(F.nullif(strip(v), F.lit("")))
    known = known.withColumn("typed", F.transform("values", typed))
    good = F.filter("typed", lambda v: v.isNotNull())
    known = known.withColumn("typed", F.when(token != "between", good).when((F.size("typed") == 2) & (F.size(good) == 2), F.col("typed")))
    return known.filter(F.size("typed") > 0).select("id", "field", by_type(token, OPERATOR_NAMES).alias("operator"), F.col("typed").alias("values"))


def field(schema: DataFrame, name: str) -> DataFrame:
    """The field of that name, or no row."""
    return schema.filter(F.col("name") == name).limit(1)


def supports(schema: DataFrame, name: str, operator: str) -> bool:
    return not field(schema, name).filter(F.array_contains("operators", operator)).isEmpty()


SCHEMA = "struct<fields: array<struct<name: string, type: string, operators: array<string>, multi: boolean, description: string>>>"


def write_schema(schema: DataFrame, path: str) -> None:
    """One JSON object with the fields in order of their names; what is empty is left out. A schema is a few rows."""
    one = F.struct("name", "type", "operators", F.when(F.col("multi"), True).alias("multi"), *([F.nullif("description", F.lit("")).alias("description")] if "description" in schema.columns else []))
    whole = schema.agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("fields"))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def read_schema(spark: SparkSession, path: str) -> DataFrame | None:
    """name, type, multi, operators, description; None if there is nothing that can be read. Fields without a name are left
    out, an unknown type is a string, and missing operators are those of the type; of repeated names the first stays."""
    try:
        said = spark.read.option("wholetext", True).text(path).select(F.from_json("value", SCHEMA).alias("s")).filter("s.fields IS NOT NULL")
        if said.isEmpty():
            return None
    except AnalysisException:
        return None
    rows = said.select(F.posexplode("s.fields").alias("pos", "f")).select("pos", "f.*").filter("name <> ''")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("pos"))).filter("n = 1")
    kind = F.when(F.col("type").isin(*BY_TYPE), F.col("type")).otherwise("string")
    return rows.select("name", kind.alias("type"), F.coalesce("multi", F.lit(False)).alias("multi"), F.when(F.size("operators") > 0, F.col("operators")).otherwise(by_type(kind, BY_TYPE)).alias("operators"), "description")
