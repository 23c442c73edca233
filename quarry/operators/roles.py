"""Property values and roles: which properties filter, which are read as text, which are dropped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import camel_case, strip, words
from quarry.sources.corpus import flag_value, list_value, number_value, string_value, whole_value

# The role of each native property type.
TYPE_ROLES = {
    "filterable": "date checkbox select multi_select status relation people number url email phone_number",
    "semantic": "title rich_text",
    "ignore": "created_time last_edited_time created_by last_edited_by formula rollup files",
}
PROSE_CHARS, PROSE_WORDS = 80, 12


def normalized(kind: Column, text: Column, number: Column, flag: Column, items: Column) -> Column:
    """The tagged value of a native property: a missing checkbox is false; empty lists and texts are null; whole numbers
    print without a point; a date keeps its start."""
    listed = F.filter(items, lambda x: F.coalesce(x != "", F.lit(False)))
    return (
        F.when(kind == "checkbox", flag_value(F.coalesce(flag, F.lit(False))))
        .when(kind.isin("select", "status", "url", "email", "phone_number", "date"), string_value(text))
        .when(kind.isin("multi_select", "people", "relation"), list_value(F.when(F.size(listed) > 0, listed)))
        .when(kind == "rich_text", string_value(F.nullif(strip(text), F.lit(""))))
        .when(kind == "number", F.when(number == F.floor(number), whole_value(number)).otherwise(number_value(number)))
    )


def parse_role(text: Column) -> Column:
    known = F.lower(F.trim(text))
    return F.when(known.isin("filterable", "semantic", "ignore"), known)


def classify(name: Column, native_type: Column, value: Column, overrides: dict[str, str] | None = None, default: str = "filterable") -> Column:
    """Override by name, else role of the type, else what the value looks like."""
    given = F.lit(None).cast("string")
    for raw, role in (overrides or {}).items():
        same = (camel_case(name) == camel_case(F.lit(raw))) | (F.lower(F.trim(name)) == raw.strip().lower())
        given = F.coalesce(given, F.when(same, parse_role(F.lit(role))))
    by_type = F.lit(None).cast("string")
    for role, kinds in TYPE_ROLES.items():
        by_type = F.coalesce(by_type, F.when(F.lower(F.trim(native_type)).isin(*kinds.split()), role))
    text = strip(value["text"])
    looks = (
        F.when(value.isNull(), default)
        .when(value["kind"] != "string", "filterable")
        .when(text == "", default)
        .when((F.length(text) >= PROSE_CHARS) | (F.size(words(text)) >= PROSE_WORDS), "semantic")
        .otherwise("filterable")
    )
    return F.coalesce(given, by_type, looks)


def as_text(value: Column) -> Column:
    listed = F.array_join(F.filter(F.transform(value["items"], lambda x: strip(x)), lambda x: x != ""), ", ")
    return F.when(value["kind"] == "list", listed).otherwise(strip(value["text"]))


def split_roles(rows: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """rows: page_id, pos, name, type, value. Returns page_id, filterable (map by camel case), semantic (array of label
    and text in order). Titles, names without letters or digits, ignored and null values are left out."""
    kept = rows.filter((F.col("type") != "title") & (camel_case(F.col("name")) != "") & F.col("value").isNotNull())
    kept = kept.withColumn("role", classify(F.col("name"), F.col("type"), F.col("value"), overrides))
    entry = F.struct("pos", camel_case(F.col("name")).alias("key"), "value")
    label = F.struct("pos", F.col("name").alias("label"), as_text(F.col("value")).alias("text"))
    ordered = lambda c: F.sort_array(F.collect_list(c))
    out = kept.groupBy("page_id").agg(F.collect_list(F.when(F.col("role") == "filterable", entry)).alias("f"), ordered(F.when((F.col("role") == "semantic") & (as_text(F.col("value")) != ""), label)).alias("s"))
    last = F.array_sort("f", lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1))
    merged = F.aggregate(last, F.create_map().cast("map<string,struct<kind:string,text:string,num:double,flag:boolean,items:array<string>>>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_entries(F.array(F.struct(e["key"], e["value"])))))
    return out.select("page_id", merged.alias("filterable"), F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"))).alias("semantic"))


def merge_semantic(content: Column, semantic: Column, as_given: bool = False) -> Column:
    """The body with a section for each semantic property: texts are stripped, blank ones and a blank body left out. as_given:
    all are taken as they are, and a null makes the whole null."""
    if as_given:
        return F.aggregate(semantic, content, lambda whole, x: F.concat(whole, F.lit("\n\n## "), x["label"], F.lit("\n\n"), x["text"]))
    said = F.filter(semantic, lambda x: strip(x["text"]) != "")
    sections = F.array_join(F.transform(said, lambda x: F.concat(F.lit("## "), x["label"], F.lit("\n\n"), strip(x["text"]))), "\n\n")
    return F.when(F.size(said) == 0, content).when(strip(content) == "", sections).otherwise(F.concat_ws("\n\n", content, sections))


def read_overrides(spark: SparkSession, path: str) -> dict[str, str]:
    """Roles by property name from a JSON object (or its `roles`); a file that is missing or malformed gives none."""
    try:
        rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,string>").alias("all"), F.from_json(F.get_json_object("value", "$.roles"), "map<string,string>").alias("roles")).collect()
    except AnalysisException:
        return {}
    found = next(((r["roles"] or r["all"]) for r in rows if r["roles"] or r["all"]), None) or {}
    return {k: v for k, v in found.items() if k and isinstance(v, str)}
